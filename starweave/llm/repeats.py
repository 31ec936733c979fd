"""Repeated passages by column-wise construction over many documents.

Every string of `length` bytes is known by its minimizer, the 16 bytes in it whose hash is smallest; equal
strings have equal minimizers at equal places. A document is cut into segments, runs of strings that share
one occurrence of a minimizer. A minimizer that occurs once cannot repeat, and only segments of the others
go on; equal segments are counted where they lie and kept once.

The segments of a bucket of minimizers, aligned at these, are then inserted column by column: each round
takes one symbol from every segment and updates the positional Burrows-Wheeler order of the collection
(all segments sorted by what they have read so far, backwards) and the common prefixes of neighbours.
A string ending in a column repeats exactly if the common part with a neighbour reaches back `length`
symbols. Work is linear in the bytes; no pairs are formed. Rounds go through shuffle files in order of
bucket, so a task holds one bucket, of bounded size; a minimizer with more than HOT different segments is
taken string by string through a combinable count of their 128-bit digests instead.

Passages shorter than `length` that different documents share are not removed, but told: shared_passages() finds
the texts that share a run of `words` words with another document. Windows of so many words are known by the least
hash of WORDS words in them; where one occurs in different texts, windows are compared by 128-bit digests: first
those that begin or end with it, then all windows of the minimizers of texts that are not caught yet.

Strings are judged on the input; every covered byte goes. Null and empty texts, and texts shorter than
`length`, lose nothing. Rows that repeat doc_id and text are occurrences of their own and get equal
results. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parity_join import ODD, mix
from .shared import drop_path, filter_of, lean, materialize, probed, settled, shared_path, slices, texts

GRAM = 16
HOT = 20_000
BUCKET_BYTES = 8 << 20
#: Bits of a place in a buffer; texts longer than PIECE are cut with overlap.
PLACE = 26
PIECE = 32 << 20


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    n = len(buf) - GRAM + 1
    raw = np.ascontiguousarray(buf)
    a = np.ndarray((n,), "<u8", raw, 0, (1,)).copy()
    b = np.ndarray((n,), "<u8", raw, 8, (1,)).copy()
    a *= np.uint64(0x9E3779B97F4A7C15)
    b *= np.uint64(0xC2B2AE3D27D4EB4F)
    a ^= (b >> np.uint64(31)) | (b << np.uint64(33))
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    return a


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(values)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = values
    block = full.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts in buf, which end at `ends`: first byte, end, place of the minimizer, its hash."""
    if len(buf) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) + (np.zeros(0, dtype=np.uint64),)
    h = gram_hashes(buf)
    low = np.uint64((1 << PLACE) - 1)
    least = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    valid = np.ones(len(least) + 1, dtype=bool)
    valid[-1] = False
    bad = np.zeros(len(least) + 1, dtype=np.int32)  # strings that would cross the end of a text
    inner = ends[ends < len(buf)]
    np.add.at(bad, np.clip(inner - length + 1, 0, len(least)), 1)
    np.add.at(bad, np.clip(inner, 0, len(least)), -1)
    valid[:-1] = np.cumsum(bad)[:-1] == 0
    start = valid[:-1].copy()
    start[1:] &= ~valid[:-2] | (least[1:] != least[:-1])
    first = np.flatnonzero(start)
    stop = np.flatnonzero(start | ~valid[:-1])
    stop = np.append(stop, len(least))
    last = stop[np.searchsorted(stop, first, side="right")]
    return first, last + length - 1, least[first], h[least[first]]


def cut(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, h, start, len, at, mh, sh for every segment."""

    def run(batches):
        for b in slices(batches, limit=2 << 20):  # some hundred bytes of working memory for each byte
            col = b.column(1)
            off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            todo = [(data, off[1:], off[:-1], 0)]
            if len(data) > PIECE:
                todo = [(data[x:y][s : s + PIECE + length - 1], np.zeros(0, dtype=np.int64), np.array([x]), s) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for s in range(0, max(1, y - x - length + 1), PIECE)]
            for buf, ends, begins, shift in todo:
                first, last, at, mh = segments(buf, ends, length)
                if not len(first):
                    continue
                if len(ends):
                    row = np.searchsorted(begins, first, side="right") - 1
                    start = first - begins[row]
                else:
                    row = np.full(len(first), int(np.searchsorted(off, begins[0], side="right")) - 1)
                    start = first + shift
                raw = buf.tobytes()
                sh = [hashlib.blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(2).take(take), pa.array(start), pa.array((last - first).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(mh.view(np.int64)), pa.array(np.frombuffer(b"".join(sh), dtype="<i8"))],
                    names=["doc_id", "h", "start", "len", "at", "mh", "sh"],
                )

    return docs.select("doc_id", "text", "h").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, start long, len int, at int, mh long, sh long")


def repeated(parts: list[bytes], at: np.ndarray, length: int) -> list[np.ndarray]:
    """For segments aligned at their minimizers: the starts of strings that another segment holds too."""
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    left = int(at.max())
    begin = left - at
    columns = int((begin + size).max())
    none = np.uint16(256)  # no symbol: a string that reaches it lies in no segment
    table = np.full((len(parts), columns), none, dtype=np.uint16)
    for k, p in enumerate(parts):
        table[k, begin[k] : begin[k] + size[k]] = np.frombuffer(p, dtype=np.uint8)
    table = np.ascontiguousarray(table.T)
    n = len(parts)
    order, since = np.arange(n), np.zeros(n + 1, dtype=np.int32)  # since: the column where the common part with the neighbour before begins
    since[0] = 1
    found = np.zeros((n, columns - length + 1), dtype=bool)
    for k in range(columns):
        symbol = table[k][order]
        perm = np.argsort(symbol, kind="stable")
        symbol = symbol[perm]
        same = symbol[1:] == symbol[:-1]
        new = np.full(n + 1, k + 1, dtype=np.int32)
        p, q = perm[:-1][same], perm[1:][same]
        most = since[q]
        gap = np.flatnonzero(q != p + 1)
        if len(gap):
            most[gap] = np.maximum.reduceat(since, np.stack([p[gap] + 1, q[gap] + 1], 1).ravel())[::2]
        new[1:n][same] = most
        order, since = order[perm], new
        if k >= length - 1:
            hit = np.flatnonzero(since[1:n] <= k - length + 1)
            if len(hit):
                w = k - length + 1
                found[order[hit + 1], w] = True
                found[order[hit], w] = True
    return [np.flatnonzero(found[k, begin[k] : begin[k] + size[k] - length + 1]) for k in range(n)]


def covered(starts: np.ndarray, length: int) -> list[dict]:
    """Ranges of bytes that strings of `length` at these ascending starts cover."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    return [{"s": int(s), "e": int(e) + length} for s, e in zip(starts[np.concatenate(([0], breaks + 1))], starts[np.append(breaks, len(starts) - 1)], strict=True)]


RANGES = "array<struct<s: int, e: int>>"
_RANGES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def spans(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, start, ranges) of segments with repeated strings, and the texts (doc_id, h, text) they lie in."""
    spark = docs.sparkSession
    held = shared_path(spark, "segments")
    cut(docs, length).write.parquet(held)
    every = spark.read.parquet(held)
    twice = every.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mh")
    # Written first, so that the join below stands alone over its exchanges and a hot minimizer's rows can be split.
    live = materialize(every.join(materialize(twice, "twice"), "mh", "left_semi"), "live")
    drop_path(spark, held)
    kinds = live.groupBy("mh", "sh").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "h", "start", "len", "at")).alias("one"))
    kinds = materialize(kinds, "kinds")
    spread = kinds.groupBy("mh").agg(F.count(F.lit(1)).alias("different"), F.sum(F.col("one.len").cast("long")).alias("bytes"))
    spread = materialize(spread, "bytes")
    kinds = materialize(kinds.join(spread, "mh"), "spread")
    whole = kinds.where("n > 1").select("mh", "sh", F.expr(f"cast(array(struct(0 as s, one.len as e)) as {RANGES})").alias("ranges"))
    # Texts with live segments, and which segments are to be read out of each.
    asked = kinds.where("different > 1").groupBy("one.doc_id", "one.h").agg(F.collect_list(F.struct("mh", "sh", "n", "different", F.col("one.start").alias("start"), F.col("one.len").alias("len"), F.col("one.at").alias("at"))).alias("asked"))
    owners = live.select("doc_id", "h").distinct().join(asked, ["doc_id", "h"], "left")
    owned = materialize(docs.join(owners, ["doc_id", "h"]), "owned")

    def read(batches):
        for b in slices(batches):
            rows = []
            for text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                rows += [{**w, "part": raw[w["start"] : w["start"] + w["len"]]} for w in want]
            for k in range(0, len(rows), 4000):
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("mh", "sh", "n", "different", "at", "part")} for r in rows[k : k + 4000]], schema=pa.schema([("mh", pa.int64()), ("sh", pa.int64()), ("n", pa.int64()), ("different", pa.int64()), ("at", pa.int32()), ("part", pa.binary())]))

    parts = owned.where("asked is not null").select("text", "asked").mapInArrow(read, "mh long, sh long, n long, different long, at int, part binary")
    total = spread.where(f"different > 1 and different <= {HOT}").agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def insert(table: pa.Table) -> pa.Table:
        seen = np.asarray(table.column("mh").combine_chunks()), np.asarray(table.column("sh").combine_chunks())
        _, one = np.unique(np.stack(seen, 1), axis=0, return_index=True)  # rows that repeat a document send its segments twice
        table = table.take(pa.array(one))
        starts = repeated(table.column("part").to_pylist(), np.asarray(table.column("at").combine_chunks()).astype(np.int64), length)
        keep = [k for k, s in enumerate(starts) if len(s)]
        return pa.table({"mh": table.column("mh").take(pa.array(keep, type=pa.int64())), "sh": table.column("sh").take(pa.array(keep, type=pa.int64())), "ranges": pa.array([covered(starts[k], length) for k in keep], type=_RANGES)})

    def strings(batches):
        for b in batches:
            for mh, sh, n, part in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                at = range(len(part) - length + 1)
                yield pa.RecordBatch.from_arrays([pa.array([mh] * len(at), type=pa.int64()), pa.array([sh] * len(at), type=pa.int64()), pa.array([n] * len(at), type=pa.int64()), pa.array(at, type=pa.int32()), pa.array([hashlib.blake2b(part[i : i + length], digest_size=16).digest() for i in at], type=pa.binary())], names=["mh", "sh", "n", "i", "digest"])

    few = parts.where(f"different <= {HOT}").withColumn("bucket", F.expr(f"pmod(xxhash64(mh), {buckets}L)")).groupBy("bucket").applyInArrow(lambda t: insert(t), f"mh long, sh long, ranges {RANGES}")
    found = whole.unionByName(few)
    if spread.where(f"different > {HOT}").limit(1).count():
        hot = materialize(parts.where(f"different > {HOT}").select("mh", "sh", "n", "part").mapInArrow(strings, "mh long, sh long, n long, i int, digest binary").distinct(), "strings")
        again = hot.groupBy("digest").agg(F.sum("n").alias("all")).where("all > 1").select("digest")
        runs = hot.join(again, "digest").groupBy("mh", "sh").agg(F.sort_array(F.collect_set("i")).alias("i"))  # a segment's own strings
        found = found.unionByName(runs.select("mh", "sh", F.expr(f"transform(i, x -> struct(x as s, x + {length} as e))").alias("ranges")))
    return live.join(materialize(found, "found"), ["mh", "sh"]).select("doc_id", "h", "start", "ranges"), owned


#: Words whose hash makes a minimizer of a window of words.
WORDS = 8
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0, 1, ... (or of its inverse) modulo 2 ** 64; base is odd."""
    if len(found := _powers.get((base, inverse), ())) < n:
        step = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        step[0] = 1
        found = np.multiply.accumulate(step)
        if n <= 4 << 20:  # those of very long texts are not kept
            _powers[base, inverse] = found
    return found[:n]


def runs_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[first:last] for each pair, which does not depend on where it lies."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * powers(base, len(values)), dtype=np.uint64)))
    return mix((sums[last] - sums[first]) * powers(base, len(values) + 1, True)[first])


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word (bytes between white space) of the texts that lie in data between `off`."""
    inner = (data != 32) & ((data < 9) | (data > 13))
    begin, end = inner.copy(), inner.copy()
    begin[1:] &= ~inner[:-1]
    end[:-1] &= ~inner[1:]
    cut = off[(off > 0) & (off < len(data))]
    begin[cut] = inner[cut]
    end[cut - 1] = inner[cut - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    value = runs_hash(data.astype(np.uint64) + np.uint64(1), first, last, int(ODD[0])) + (last - first).astype(np.uint64) * ODD[1]
    return mix(value), np.searchsorted(off, first, side="right") - 1


def windows(b: pa.RecordBatch, words: int):
    """Of the texts in a batch's second column: each window's text, first word, place and hash of its minimizer, and the words' hashes."""
    col = b.column(1)
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    h, doc = word_hashes(data, off - off[0])
    if len(h) < words:
        return *(np.zeros(0, dtype=np.int64) for _ in range(3)), h[:0], h
    at = np.arange(len(h) - WORDS + 1)
    gram = runs_hash(h, at, at + WORDS, int(ODD[2]))
    low = np.uint64((1 << PLACE) - 1)
    least = (sliding_least((gram & ~low) | at.astype(np.uint64), words - WORDS + 1) & low).astype(np.int64)
    first = np.flatnonzero(doc[: len(least)] == doc[words - 1 :])
    return doc[first], first, least[first], gram[least[first]], h


def shared_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """The texts (h) of docs(h, text) that share a run of `words` words with another text, or have that many and a copy."""
    whole = docs.select("h", "text")

    @lean
    def minimizers(batches):
        for b in slices(batches, limit=2 << 20):
            doc, _, at, mh, _ = windows(b, words)
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))) if len(doc) else doc
            new = new[np.lexsort((mh[new], doc[new]))]
            new = new[np.concatenate(([True], (doc[new[1:]] != doc[new[:-1]]) | (mh[new[1:]] != mh[new[:-1]])))] if len(new) else new
            yield pa.RecordBatch.from_arrays([pa.array(mh[new].view(np.int64)), b.column(0).take(pa.array(doc[new]))], names=["mh", "h"])

    @lean
    def digests(batches, ends: bool):
        """Digests of the windows of each text's listed minimizers; ends: of those that begin or end with them."""
        for b in slices(batches, limit=2 << 20):
            doc, first, place, mh, h = windows(b, words)
            begin = np.searchsorted(doc, np.arange(b.num_rows + 1))
            keep = [np.arange(x, y)[np.isin(mh[x:y].view(np.int64), np.asarray(b.column(2)[k].values))] for k, (x, y) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))]
            keep = np.concatenate(keep)
            if ends:
                keep = keep[(first[keep] == place[keep]) | (first[keep] + words == place[keep] + WORDS)]
            at = first[keep]
            one, two = (runs_hash(h, at, at + words, int(ODD[k])).view(np.int64) for k in (3, 4))
            for x in range(0, len(at), 100_000):
                s = slice(x, x + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(one[s]), pa.array(two[s]), b.column(0).take(pa.array(doc[keep[s]]))], names=["one", "two", "h"])

    def met(asked: DataFrame, ends: bool, tag: str) -> DataFrame:
        """The texts of which a window occurs in another text."""
        rows = materialize(asked.select("h", "text", "live").mapInArrow(lambda batches: digests(batches, ends), "one long, two long, h long"), tag)
        again = rows.groupBy("one", "two").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("one", "two")
        return rows.join(materialize(again, "again"), ["one", "two"], "left_semi").select("h").distinct()

    def found() -> DataFrame:
        held = materialize(whole.mapInArrow(minimizers, "mh long, h long"), "minimizers")
        live = held.groupBy("mh").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("mh")
        # Written first, so that the join stands alone over its exchanges and a hot minimizer's rows can be split.
        pairs = materialize(held.join(materialize(live, "live"), "mh").distinct(), "pairs")
        of_text = lambda p: p.groupBy("h").agg(F.collect_list("mh").alias("live"))
        named = probed(whole, *filter_of(pairs.select("h").distinct(), "h"), "h").join(of_text(pairs), "h").dropDuplicates(["h"])
        named = materialize(named, "named")
        caught = materialize(met(named, True, "ends"), "caught")
        left = materialize(pairs.join(caught, "h", "left_anti").select("mh").distinct(), "left")
        late = met(named.drop("live").join(of_text(pairs.join(left, "mh")), "h"), False, "windows")
        copies = docs.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(held.select("h").distinct(), "h").select("h")
        return caught.union(late).union(copies).distinct()

    return settled(found, "passages")


def remove_repeats(docs: DataFrame, length: int = 400, words: int = 51) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage (a run of `words` words occurs in another row too), spans (arrays of s, e in bytes)."""
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    ids = docs.schema["doc_id"].dataType.simpleString()

    def strip(batches):
        for b in slices(batches):
            out = []
            for text, pieces in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw, spans_, kept, at = text.encode(), [], [], 0
                for p in pieces:
                    if spans_ and p["s"] <= spans_[-1]["e"]:
                        spans_[-1]["e"] = max(spans_[-1]["e"], p["e"])
                    else:
                        spans_.append(dict(p))
                for s in spans_:
                    kept.append(raw[at : s["s"]])
                    at = s["e"]
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw) - len(left), len(spans_), hashlib.sha256(left).hexdigest(), spans_))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[k] for o in out], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))))], names=["doc_id", "h", "n_removed", "n_spans", "kept_sha256", "spans"])

    def stripped() -> DataFrame:
        found, owned = spans(rows, length)
        each = found.groupBy("doc_id", "h").agg(F.collect_list(F.expr("transform(ranges, x -> struct(start + x.s as s, start + x.e as e))")).alias("pieces"))  # of one text
        each = each.select("doc_id", "h", F.sort_array(F.flatten("pieces")).alias("pieces"))
        lost = owned.select("doc_id", "h", "text").join(each, ["doc_id", "h"])
        return lost.mapInArrow(strip, f"doc_id {ids}, h long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s: long, e: long>>").dropDuplicates(["doc_id", "h"])

    lost = settled(stripped, "stripped")
    narrow = rows.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    out = narrow.join(lost, ["doc_id", "h"], "left").join(shared_passages(rows, words).withColumn("shares_passage", F.lit(True)), "h", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"), F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"), F.coalesce("spans", F.expr("cast(array() as array<struct<s: long, e: long>>)")).alias("spans"))
