import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from starweave.llm import exact_dedup, packing, parity_join, pii, queries, repeats, sentence_pieces, shared, token_output, toxicity
from tokenizers import Tokenizer


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_are_the_library_s(spark, sf_dir, docs_rows, pieces):
    got = rows(queries.op1_token_counts(spark, sf_dir), "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = [len(pieces.encode(t or "")) for _, t in docs_rows]
    assert got == sorted((i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(docs_rows, n))


def test_exact_groups(spark, sf_dir, docs_rows):
    assert rows(queries.op2_exact_dedup(spark, sf_dir), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.keepers(docs_rows)


def test_exact_groups_survive_colliding_digests(spark, docs_rows):
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    weak = exact_dedup.groups(df, digest=lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1)))
    assert rows(weak, "doc_id", "keep_id", "group_size", "kept") == [r[:4] for r in brute.keepers(docs_rows)]
    least = {r.doc_id for r in exact_dedup.groups(df, keep="min").where("kept").collect()}
    assert 4 in least and 6 not in least


def test_index_grows_by_flushes(spark, docs_rows):
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    index = exact_dedup.MergeIndex(spark)
    index.add(df.where("doc_id < 30")), index.add(df.where("doc_id >= 30"))
    merged = index.compact()
    assert index.flushed == 32 and index.runs(1).select("run").distinct().count() == 4 and index.runs(2).select("run").distinct().count() == 1
    want = {(r[4], r[1], r[2]) for r in brute.keepers(docs_rows)}
    assert {(r.digest.hex(), r.largest, r.n) for r in merged.collect()} == want
    one = index.runs().where("doc_id = 4").first().digest
    assert {r.doc_id for r in index.lookup([bytes(one)]).collect()} == {4, 6}


def test_a_second_batch_is_probed_against_compacted_runs(spark, docs_rows):
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    index = exact_dedup.MergeIndex(spark)
    index.add(df.where("doc_id < 30"))
    bitmap, size = shared.filter_of(index.compact())
    late = df.where("doc_id >= 30").select("doc_id", exact_dedup.sha256(F.coalesce("text", F.lit(""))).alias("digest"))
    held = {(t or "") for i, t in docs_rows if i < 30}
    known = {i for i, t in docs_rows if i >= 30 and (t or "") in held}
    passed = {r.doc_id for r in shared.probed(late, bitmap, size).collect()}
    assert known <= passed and len(passed - known) < 5
    many = spark.range(200_000).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"), "id")
    bitmap, size = shared.filter_of(many.where("id < 100000"))
    assert shared.probed(many, bitmap, size).where("id < 100000").count() == 100_000
    assert shared.probed(many, bitmap, size).where("id >= 100000").count() < 10_000


def test_one_row_of_each_text_stays(spark, docs_rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(docs_rows)], "doc_id long, text string, more long")
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    want = {(t or ""): max(i for i, x in docs_rows if (x or "") == (t or "")) for _, t in docs_rows}
    assert sorted((r.text or "", r.doc_id) for r in got.collect()) == sorted(want.items())


def test_pieces_are_the_library_s_and_come_back(spark, sf_dir, docs_rows, pieces):
    got = rows(queries.op3_sentence_pieces(spark, sf_dir), "doc_id", "n_ids", "ids_crc32", "round_trip")
    ids = [pieces.encode(t or "") for _, t in docs_rows]
    want = sorted((i, len(x), crc(x), True) for (i, t), x in zip(docs_rows, ids))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] for g in got)
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    back = sentence_pieces.decode(sentence_pieces.encode(df, path), path)
    assert rows(back, "doc_id", "text") == sorted((i, (t or "").replace("▁", " ")) for i, t in docs_rows)


def test_unigram_scores_are_the_best(pieces):
    model = sentence_pieces.Model(public_tokenizers.path("piece_bpe_32k.model"), "unigram")
    words = ["▁the", "▁thermal", "▁there", "▁xqz", "▁é"]
    got = model.encode_words(words)

    def best(w):
        s = [0.0] + [-1e18] * len(w)
        for k in range(1, len(w) + 1):
            for j in range(k):
                p = w[j:k]
                v = model.score.get(p, model.least if k - j == 1 else None)
                if v is not None:
                    s[k] = max(s[k], s[j] + v)
        return s[-1]

    for w in words:
        ids = np.frombuffer(got[w], dtype="<u4").tolist()
        parts = [model.pieces[i] for i in ids if i not in model.of_byte]
        assert sum(model.score[p] for p in parts) + model.least * (len(w) - sum(map(len, parts))) == pytest.approx(best(w))


def test_repeats_go(spark, sf_dir, docs_rows, monkeypatch):
    want = brute.removed(docs_rows, 400)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(queries.op4_repeats(spark, sf_dir), *cols) == want
    assert sum(r[2] for r in want) > 0
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "HOT", 2)  # most minimizers go string by string
    assert rows(repeats.remove_repeats(df, 60), *cols) == brute.removed(docs_rows, 60)


def sharing(rows_, words):
    """Whether a run of words occurs in another text, or in a copy."""
    split = [(t or "").encode().split() for _, t in rows_]
    where = defaultdict(set)
    for (_, t), w in zip(rows_, split):
        for k in range(len(w) - words + 1):
            where[tuple(w[k : k + words])].add(t)
    same = Counter(t or "" for _, t in rows_)
    return sorted((i, any(len(where[tuple(w[k : k + words])]) > 1 or same[t or ""] > 1 for k in range(len(w) - words + 1))) for (i, t), w in zip(rows_, split))


@pytest.mark.parametrize("words", [51, 9])
def test_shared_passages_are_told(spark, docs_rows, words):
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    want = sharing(docs_rows, words)
    assert rows(repeats.remove_repeats(df, 400, words), "doc_id", "shares_passage") == want
    assert 10 < sum(x for _, x in want) < len(want)


def test_shared_passages_of_any_place_and_length(spark):
    """Runs one word short of the limit are left alone, runs of just the limit are caught, wherever they lie."""
    rng = np.random.default_rng(9)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    data = []
    for k in range(120):
        run = some(50 + k % 3)
        data += [(2 * k, " ".join(some(int(rng.integers(0, 90))) + run + some(int(rng.integers(0, 90))))), (2 * k + 1, "\n".join(some(int(rng.integers(0, 90))) + run + some(int(rng.integers(0, 90)))))]
    got = dict(rows(repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), 400), "doc_id", "shares_passage"))
    assert [got[i] for i, _ in data] == [(i // 2) % 3 > 0 for i, _ in data]


def test_repeats_in_texts_cut_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    part = "".join(rng.choice(list("abcdef"), 3000))
    data = [(1, part + "x" + part), (2, "".join(rng.choice(list("abcdef"), 5000)) + part[:500])]
    monkeypatch.setattr(repeats, "PIECE", 900)
    df = spark.createDataFrame(data, "doc_id long, text string")
    buf = np.frombuffer(data[0][1].encode(), dtype=np.uint8)
    whole = repeats.segments(buf, np.array([len(buf)]), 100)
    assert (np.diff(whole[0]) > 0).all() and whole[1][-1] == len(buf)
    assert rows(repeats.remove_repeats(df, 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.removed(data, 100)


def test_near_copies_link(spark, sf_dir, docs_rows):
    want = brute.links(docs_rows)
    assert rows(queries.op5_jaccard_join(spark, sf_dir), "doc_id", "n_shingles", "component_id") == want
    assert len({w[2] for w in want}) < len(want)


@pytest.mark.parametrize("part", [4096, 50])
def test_large_circles_of_near_copies(spark, monkeypatch, part):
    """A few thousand near copies, many of them near the threshold, equal brute force, also where circles are cut in parts."""
    monkeypatch.setattr(parity_join, "PART", part)
    rng = np.random.default_rng(8)
    base, data = [f"w{k}" for k in range(90)], []
    for k in range(2400 if part > 1000 else 500):
        own = list(base)
        for x in rng.choice(90, int(rng.integers(1, 5)), replace=False):
            own[x] = f"v{rng.integers(0, 40)}"
        data.append((k, " ".join(own)))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in data]
    code = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(data), len(code)), dtype=np.float32)
    for k, s in enumerate(sets):
        held[k, [code[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(1)
    link = 100 * both >= 80 * (size[:, None] + size[None] - both)
    component = np.arange(len(data))
    while True:
        new = np.where(link, component[None], len(data)).min(1)
        if (new == component).all():
            break
        component = new
    assert len(set(component)) > 20 and np.bincount(component).max() > 100
    got = rows(parity_join.components(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == [(k, len(sets[k]), int(component[k])) for k in range(len(data))]


def test_tasks_hold_every_pair_across_components(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "PART", 7)
    inside = [(1, b, 100 if b < 40 else b % 9) for b in range(60)] + [(2, b, b) for b in range(5)] + [(3, b, 8) for b in range(30)]
    got = defaultdict(list)
    for r in parity_join.tasks(spark.createDataFrame(inside, "a long, b long, component long")).collect():
        got[r.task].append((r.node, r.component))
    met = {frozenset((x, y)) for t in got.values() for x, c in t for y, d in t if c != d}
    want = {frozenset((x, y)) for a, x, c in inside for b, y, d in inside if a == b and c != d}
    assert met == want and not any(len({c for _, c in t}) == 1 and len(t) > 30 for t in got.values())


def test_blocks_lose_no_link():
    """Sets at the very threshold share a key, whatever their sizes."""
    rng = np.random.default_rng(4)
    bands = parity_join.Bands(parity_join.Fraction(4, 5))
    for n in [*range(1, 60), 75, 99, 130, 200, 333, 512, 800]:
        a = np.unique(rng.integers(0, 1 << 52, n, dtype=np.uint64))
        for m in {int(n * 0.8) + (n * 4 % 5 > 0), int(n * 0.9), n}:
            # Change as many as the threshold allows.
            common = -(-4 * (len(a) + m) // 9)
            if common > min(len(a), m) or m < 1:
                continue
            b = np.unique(np.concatenate([rng.permutation(a)[:common], rng.integers(0, 1 << 52, m - common, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (len(a) + len(b) - both):
                continue
            keys, of = parity_join.keys_of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()), (n, m)
            assert parity_join.may_link(len(a), parity_join.sketch(a), len(b), parity_join.sketch(b), bands.least)


def test_base_spans(spark, sf_dir, docs_rows):
    got = rows(queries.op6_pii(spark, sf_dir), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    want = []
    for i, t in docs_rows:
        n, digest, joined = brute.personal(t)
        want.append((i, *n, digest, joined))
    assert [g[:6] for g in got] == [w[:6] for w in sorted(want)]
    for g, w in zip(got, sorted(want)):
        assert set(filter(None, w[6].split(","))) <= set(filter(None, g[6].split(",")))


def test_patterns_of_long_texts_stay_linear(spark):
    data = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 " * 30_000), (4, "a.b" * 60_000 + "@x.yy"), (5, "+1" * 100_000)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[4].n_email == 1 and got[1].spans == "" and got[2].n_card == 0 and got[3].n_card == 0


def test_context_finds_unseen_identifiers(spark):
    data = [(k, f"please reach user{k}@mail.example.com today for {k}") for k in range(20)]
    data += [(100, "please reach me.at.home77 today"), (101, "nothing 12345 here")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[100] == "email:13:25" and got[101] == ""
    red = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert red[100] == "please reach [EMAIL] today" and red[3] == "please reach [EMAIL] today for 3" and red[101] == data[-1][1]


def test_cues_on_one_side_find_planted_identifiers(spark):
    """Of planted contexts every unseen identifier is found, and no token elsewhere."""
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "ru", "se") for b in ("nor", "vel", "dan", "pik", "sut")]
    some = lambda n: " ".join(rng.choice(words, n))
    data, planted = [], {}
    for k in range(60):
        data.append((k, f"{some(4)} write to: person{k}@mail{k % 7}.example.com {some(5)} dial number +1 415 555 {1000 + k} {some(3)} lot {k}x {some(2)}"))
    for k in range(60, 75):
        text = f"{some(3)} write to: box{k}.at.home {some(4)} dial number 0800-{k}-CALL {some(2)} lot {k}y {some(2)}"
        data.append((k, text))
        planted[k] = {f"{kind}:{text.index(t)}:{text.index(t) + len(t)}" for kind, t in (("email", f"box{k}.at.home"), ("phone", f"0800-{k}-CALL"))}
    data.append((80, 'key = "' + "0a1b" * 10 + '" here'))
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = {k: set(got[k].spans.split(",")) for k in planted}
    assert found == planted
    assert all(got[k].n_spans == 2 and got[k].n_email == got[k].n_phone == 1 for k in range(60))
    assert got[80].spans == "secret:7:47" and got[80].n_secret == 1 and got[80].base_sha256 == brute.personal("")[1]


def test_scores_of_patterns_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows_ = []
    for _ in range(3000):
        t = int(rng.integers(0, 250))
        kind = ["email", "phone", None][t % 3 if t < 150 else 2]
        rows_.append((kind, f"t{t}", "left", f"w{int(rng.integers(0, 6)) * 3 + (t % 3 if rng.random() < 0.97 else int(rng.integers(0, 3)))}"))
    edges = {(w, t): kind for kind, t, _, w in rows_}
    seeds = {(t, kind): 1.0 for (_, t), kind in edges.items() if kind}
    size = Counter(w for w, _ in edges)
    scored, last = dict(seeds), None
    for _ in range(10):
        held, support = defaultdict(float), Counter()
        for (w, t), _ in edges.items():
            for kind in ("email", "phone"):
                if (t, kind) in scored:
                    held[w, kind] += scored[t, kind]
                    support[w, kind] += scored[t, kind] >= 1
        patterns = {(w, kind): v / (size[w] + 1) for (w, kind), v in held.items() if support[w, kind] >= 5}
        good = {x for x, v in patterns.items() if v >= 0.5}
        if good == last:
            break
        last, wrong = good, defaultdict(lambda: 1.0)
        for (w, t), kind in edges.items():
            for (p, k), v in patterns.items():
                if p == w and not kind:
                    wrong[t, k] *= max(1e-6, 1 - v)
        scored = seeds | {x: 1 - v for x, v in wrong.items()}
    got = {(r.words, r.kind): r.score for r in pii.confident(spark.createDataFrame(rows_, "kind string, t string, form string, words string"), 10, 0.5, 5).collect()}
    best = {}
    for w, kind in good:
        best[w] = max(best.get(w, (0, "")), (patterns[w, kind], kind))
    assert len(best) > 2 and got == pytest.approx({(w, kind): v for w, (v, kind) in best.items()})


def test_packing_is_whole_and_tight(spark, sf_dir, docs_rows, bpe):
    got = queries.op7_packing(spark, sf_dir).collect()
    want = Counter()
    for i, t in docs_rows:
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_plan_places_every_piece():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 500, 20_000):
        hist = np.bincount(np.minimum(64, 1 + rng.geometric(0.07, n)), minlength=65)
        runs = packing.plan(hist)
        filled = Counter()
        for length, lo, hi, seq, _ in runs.tolist():
            for k in range(hi - lo):
                filled[seq + k] += length
        assert sum(filled.values()) == int((hist * np.arange(65)).sum()) and max(filled.values(), default=0) <= 64
        assert np.array_equal(np.bincount(runs[:, 0], weights=runs[:, 2] - runs[:, 1], minlength=65), hist)


def test_token_files(spark, sf_dir, docs_rows, bpe, tmp_path):
    got = rows(queries.op8_token_output(spark, sf_dir), "start", "doc_id", "n_tokens", "ids_crc32")
    want, at = [], 0
    for i, t in sorted(docs_rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    path = str(tmp_path / "orc")
    token_output.write_tokens(spark.createDataFrame(docs_rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), 2, path)
    assert token_output.read_tokens(spark, path).where("doc_id = 4").first().ids == [*bpe.encode("one two", add_special_tokens=False).ids, 2]


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(["an", "er", "th", "on", "re", "ti", "es"], rng.integers(1, 4))) for _ in range(200)]
    data, lab = [], []
    for k in range(1500):
        toxic = k % 8 == 0
        own = list(rng.choice(words, 60))
        for _ in range(4 if toxic else 0):
            own[int(rng.integers(0, 60))] = "vequ" + str(rng.choice(["an", "er", "th", "on", "re", "ti"])) + str(rng.choice(["s", "x", "y", "o"]))
        data.append((k, " ".join(own))), lab.append((k, int(toxic)))
    data += [(5000, None), (5001, ""), (5001, "")]
    docs, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert got[5000].predicted == 0 and 0 <= got[5001].score < 0.3
    held = [k for k, _ in lab if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in got if got[k].held_out and k < 5000} == set(held)
    right = [got[k].predicted == dict(lab)[k] for k in held]
    assert np.mean(right) > 0.97
    kept = toxicity.keep_clean(docs.withColumns({"score": F.lit(1), "strongest": F.lit("x")}), labels)
    assert kept.columns == ["doc_id", "text", "score", "strongest"]
    assert {r.doc_id for r in kept.collect()} == {k for k in got if not got[k].predicted}


def test_toxicity_without_usable_labels(spark, sf_dir, docs_rows):
    got = queries.op9_toxicity(spark, sf_dir)
    assert got.count() == len(docs_rows) and got.where("score < 0 or score > 1 or score is null").count() == 0
    none = toxicity.score(spark.createDataFrame(docs_rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("score <> 0 or predicted <> 0").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    df = queries.QUERIES[name](spark, empty_dir)
    assert df.collect() == [] and df.columns
