"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles. For each band of set sizes the hashes are dealt
to blocks and a block's shingles are XORed: a parity sketch, in which every shingle that only one of two
sets holds changes at most one block, so the number of differing blocks bounds the symmetric difference
from below. Sets of similarity t or more differ in at most (1 - t) / (1 + t) of their total size; with
more blocks than that, and some to spare for blocks that are empty, at least one block that is not empty
must be equal (pigeonhole). A set small enough that blocks would hold single shingles sends its first ones
in hash order instead, as many as differ at most and one; so does a set with more empty blocks than spared.

Equal sets are one node from the start, and copies never multiply. All nodes that share a block point at the
smallest of them, so what leaves a block grows with its nodes and not with their pairs. The nodes that point
at one node, and that node, are its circle: two nodes with an equal block always share a circle. A task takes
one circle, or two parts of one that is larger than PART, and compares sizes and one-bit parity sketches
(Hamming distance). Only nodes that may link with one of another component go on; their whole sets are
brought to the same task, which verifies pairs that no link has joined yet and gives a forest of links.
So neither step gives more rows than it takes, no link between components is left out, and pairs within a
component are not expanded. A circle larger than PART is compared with its smallest node first: nodes
that are linked through it are not compared with each other again.

Blocks travel packed, by ranges of their hash; the number of ranges follows the number of shingles.

Null and empty texts, and texts without words, have no shingles and link with nothing; texts of one to four
words have one shingle, the whole sequence. Repeated rows are documents of their own (with one doc_id they
are one in the components). An empty table gives no rows. A document without doc_id has no
component of its own to name and verifies no links. Only doc_id and text are read. Hashes of shingles have
52 bits within a document.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .shared import connected, if_few, lean, materialize, parts, release, settled, slices, texts

WORDS = 5
#: Ratio of neighbouring bands of set sizes.
BAND = 1.3
#: Sets below this size send single shingles.
SMALL = 40
#: Nodes of one part of a circle; a task compares two parts at most.
PART = 4096
#: Bytes of packed blocks in one range of their hash, about.
RANGE = 16 << 20
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def times(n: int, k: int) -> np.uint64:
    return np.uint64(n * int(ODD[k]) % (1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (52-bit hashes, ascending within a document) of up to 4096 texts, and each text's first."""
    hashes, count, short = [], np.zeros(len(raw), dtype=np.int64), {}
    for k, text in enumerate(raw):
        words = text.lower().split()
        if len(words) >= WORDS:
            hashes.extend(map(xxh3_64_intdigest, words))
            count[k] = len(words)
        elif words:
            short[k] = xxh3_64_intdigest(b"few " + b" ".join(words)) >> 12
    w = np.fromiter(hashes, dtype=np.uint64, count=len(hashes))
    if len(w):
        n = len(w) - WORDS + 1
        h = np.zeros(n, dtype=np.uint64)
        for k in range(WORDS):
            h += mix(w[k : k + n] + ODD[k]) * ODD[k]
        h = mix(h)
        doc = np.repeat(np.arange(len(raw)), count)
        ok = doc[:n] == doc[WORDS - 1 :]
        key = (doc[:n][ok].astype(np.uint64) << np.uint64(52)) | (h[ok] >> np.uint64(12))
    else:
        key = np.zeros(0, dtype=np.uint64)
    if short:
        key = np.concatenate([key, np.array([(k << 52) | v for k, v in short.items()], dtype=np.uint64)])
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    doc = (key >> np.uint64(52)).astype(np.int64)
    off = np.searchsorted(doc, np.arange(len(raw) + 1))
    return key & np.uint64((1 << 52) - 1), off


class Bands:
    """Bands of set sizes from SMALL up: the largest size, most differences, blocks, and empty blocks spared."""

    def __init__(self, least: Fraction):
        self.least = least
        self.part = (1 - least) / (1 + least)
        self.tops = [SMALL - 1]

    def upto(self, size: int) -> None:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND)))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        if len(sizes):
            self.upto(int(sizes.max() / self.least) + 2)
        return np.searchsorted(np.array(self.tops), sizes)  # 0: small

    def blocks(self, band: int) -> tuple[int, int]:
        """How many blocks, and how many of them a set may leave empty."""
        self.upto(self.tops[-1] + 1) if band >= len(self.tops) else None
        top, low = self.tops[band], self.tops[band - 1] + 1
        differ = math.floor(self.part * 2 * top)
        spared = 0
        for _ in range(8):
            n = differ + 1 + spared
            empty = n * math.exp(-float(self.least) * low / n)
            spared = math.ceil(empty + 5 * math.sqrt(empty) + 2)
        return differ + 1 + spared, spared

    def first(self, sizes: np.ndarray) -> np.ndarray:
        """Shingles in hash order of which two similar sets share one."""
        need = np.array([math.ceil(self.least * int(n)) for n in sizes], dtype=np.int64)
        return sizes - need + 1


def keys_of(sets: np.ndarray, off: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the sets and the set each belongs to."""
    size = np.diff(off)
    keys, rows = [], []
    home = bands.of(size)
    guest = bands.of(np.floor(size / float(bands.least)).astype(np.int64) + 1)
    single = np.zeros(len(size), dtype=bool)
    single[(size > 0) & (size * bands.least < SMALL)] = True  # may meet a small set
    over: list[tuple[np.ndarray, int]] = []
    for band in range(1, int(guest.max(initial=0)) + 1):
        at = np.flatnonzero((home <= band) & (guest >= band) & (size >= SMALL))
        if not len(at):
            continue
        n, spared = bands.blocks(band)
        pick = np.concatenate([np.arange(off[k], off[k + 1]) for k in at])
        doc = np.repeat(at, size[at])
        h = sets[pick]
        block = ((h >> np.uint64(20)) * np.uint64(n)) >> np.uint64(32)
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])))
        start = np.flatnonzero(new)
        parity = np.bitwise_xor.reduceat(mix(h), start)
        keys.append(mix(parity + mix(block[start] * ODD[1] + times(band, 2))))
        rows.append(doc[start])
        full = np.bincount(doc[start], minlength=len(size))[at]
        late = at[n - full > spared]
        if len(late):
            over.append((late, band))
    for at, space in [(np.flatnonzero(single), 0), *over]:
        if len(at):
            most = bands.first(size[at])
            pick = np.concatenate([np.arange(off[k], off[k] + m) for k, m in zip(at, most, strict=True)])
            keys.append(mix(sets[pick] * ODD[3] + times(space, 4)))
            rows.append(np.repeat(at, most))
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def sketch(hashes: np.ndarray) -> bytes:
    """One-bit parity sketch, of four to eight bits for each shingle (a power of two), so that few differences fall together."""
    bits = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch_: np.ndarray, size: int) -> np.ndarray:
    while len(sketch_) > size:
        sketch_ = sketch_[: len(sketch_) // 2] ^ sketch_[len(sketch_) // 2 :]
    return sketch_


def near(part: np.ndarray, n: np.ndarray, sketches: list[bytes], least: Fraction):
    """For nodes of a circle: a row, and the rows in other parts that sizes and Hamming distances let it link with, nearest first; a pair once.

    Rows of the most frequent part are not taken as the first of a pair, so two large parts are not needed to
    find what a few other nodes link with. Sizes of similar sets differ by less than two, so sketches are folded once at most.
    """
    kinds, of = np.unique(part, return_inverse=True)
    if len(kinds) < 2:
        return
    main = int(np.argmax(np.bincount(of)))
    length = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
    order = np.argsort(n, kind="stable")
    up = n[order]
    place, table, half = np.zeros(len(n), dtype=np.int64), {}, {}
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        place[rows] = np.arange(len(rows))
        raw = np.frombuffer(b"".join(sketches[k] for k in rows.tolist()), dtype=np.uint64).reshape(len(rows), -1)
        table[size] = raw
        raw = raw.view(np.uint8)
        half[size] = np.ascontiguousarray(raw[:, : size // 2] ^ raw[:, size // 2 :])
    for i in order[of[order] != main].tolist():
        low = np.searchsorted(up, -(-int(n[i]) * least.numerator // least.denominator))
        high = np.searchsorted(up, int(n[i]) * least.denominator // least.numerator, side="right")
        js = order[low:high]
        js = js[(of[js] != of[i]) & ((of[js] == main) | (n[js] > n[i]) | ((n[js] == n[i]) & (js > i)))]
        own, hits, fars = int(length[i]), [], []
        step = max(1, (4 << 20) // own)
        for x in range(0, len(js), step):
            some = js[x : x + step]
            for size in (own // 2, own, 2 * own):
                rows = some[length[some] == size]
                if not len(rows):
                    continue
                sheet = half[size][place[rows]] if size > own else table[size][place[rows]].view(np.uint8)
                mine = half[own][place[i]] if size < own else table[own][place[i]].view(np.uint8)
                wide = np.uint64 if len(mine) % 8 == 0 else np.uint32
                far = np.bitwise_count(sheet.view(wide) ^ mine.view(wide)).sum(1, dtype=np.int64)
                ok = far * (least.denominator + least.numerator) <= (n[i] + n[rows]) * (least.denominator - least.numerator)
                hits.append(rows[ok]), fars.append(far[ok])
        if hits and len(js := np.concatenate(hits)):
            yield i, js[np.argsort(np.concatenate(fars), kind="stable")].tolist()


def may_link(na: int, a: bytes, nb: int, b: bytes, least: Fraction) -> bool:
    """Whether sizes and the Hamming distance of sketches leave a link possible."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    both = min(len(x), len(y))
    far = int(np.bitwise_count(folded(x, both) ^ folded(y, both)).sum())
    return far * (least.denominator + least.numerator) <= (na + nb) * (least.denominator - least.numerator)


def _split(batches):
    """Slices of at most 4096 rows, their texts as bytes."""
    for b in slices(batches, limit=2 << 20):
        for k in range(0, b.num_rows, 4000):
            s = b.slice(k, 4000)
            yield s, s.column(1).cast(pa.binary()).to_pylist()


def components(docs: DataFrame, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = texts(docs)
    ids = docs.schema["doc_id"].dataType.simpleString()

    @lean
    def describe(batches):
        """doc_id, node, n, sketch of each document."""
        schema = None
        for b, raw in _split(batches):
            sets, off = shingle_sets(raw)
            schema = schema or pa.schema([("doc_id", b.column(0).type), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node_ids(sets, off)), pa.array(np.diff(off)), pa.array([sketch(sets[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], type=pa.binary())], schema=schema)

    @lean
    def spread(batches):
        """The keys of a batch, packed for each bucket: nodes, how many keys each has there, and the keys.

        40 bits of a key travel; with the bucket they tell keys apart well enough for candidates.
        """
        bands = Bands(least)
        for _, raw in _split(batches):
            sets, off = shingle_sets(raw)
            key, of = keys_of(sets, off, bands)
            if not len(key):
                continue
            node = node_ids(sets, off)
            bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.lexsort((of, bucket))
            key, of, bucket = key[order], of[order], bucket[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            out = []
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own = of[x:y]
                begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                out.append(np.array([len(begin)], dtype="<u4").tobytes() + node[own[begin]].astype("<i8").tobytes() + np.diff(np.append(begin, y - x)).astype("<u4").tobytes() + np.ascontiguousarray(key[x:y].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(out, type=pa.binary())], names=["bucket", "data"])

    # Shingles are hashed once more for the keys: cheaper than writing these down.
    listed = materialize(rows.mapInArrow(describe, f"doc_id {ids}, node long, n long, sketch binary"), "listed")
    shingles = listed.agg(F.sum("n")).first()[0] or 0
    buckets = max(parts(spark, 8), -(-8 * shingles // RANGE))  # about a block of 5 bytes, and its node, for each shingle

    def meet(table: pa.Table) -> pa.Table:
        """(a, b): of the nodes that share a key, each but the smallest with the smallest; a pair once."""
        nodes, keys = [], []
        for data in table.column("data").to_pylist():
            m = int(np.frombuffer(data, "<u4", 1)[0])
            each = np.frombuffer(data, "<u4", m, 4 + 8 * m)
            nodes.append(np.repeat(np.frombuffer(data, "<i8", m, 4), each))
            wide = np.zeros((int(each.sum()), 8), dtype=np.uint8)
            wide[:, :5] = np.frombuffer(data, np.uint8, offset=4 + 12 * m).reshape(-1, 5)
            keys.append(wide.view("<u8").ravel())
        node, key = np.concatenate(nodes), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        node, key = node[order], key[order]
        again = np.zeros(len(key), dtype=bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:].copy()
        node, key = node[again], key[again]
        order = np.lexsort((node, key))
        node, key = node[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else again[:0]
        first = node[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else node
        both = np.unique(np.stack([first, node], 1)[first != node], axis=0)
        del nodes, keys, node, key, first, order, again
        release()
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    def parted() -> DataFrame:
        """(node, component) of all nodes with links."""
        star = rows.mapInArrow(spread, "bucket int, data binary").groupBy("bucket").applyInArrow(lambda t: meet(t), "a long, b long").distinct()
        star = materialize(star, "star")
        marks = listed.groupBy("node").agg(F.max(F.struct("n", "sketch")).alias("x")).select("node", "x.n", "x.sketch")
        large = star.groupBy("a").agg(F.count(F.lit(1)).alias("held")).where(f"held >= {PART}")
        large = materialize(large, "large")
        if large.isEmpty():
            part = None
            inside = star.withColumn("component", F.col("b")).unionByName(star.select("a", F.col("a").alias("b"), F.col("a").alias("component")).distinct())
        else:
            part = connected(verify(docs, listed, materialize(thinned(star.join(large.select("a"), "a", "left_semi"), marks, least), "thinned"), least))
            part = materialize(part, "part")
            inside = star.select("a", "b").union(star.select("a", F.col("a").alias("b")).distinct())
            inside = inside.join(part.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
        rest = materialize(tasks(inside).join(marks, "node").select("task", "node", "component", "n", "sketch"), "rest")
        suspects = materialize(by_task(rest, "n", "sketch").mapInArrow(lambda batches: suspected(batches, least), "task long, node long, component long"), "suspects")
        whole = sets_of(docs, listed, suspects.select("node").distinct())
        links = by_task(suspects.join(whole, "node"), "hashes").mapInArrow(lambda batches: forest(batches, least), "a long, b long")  # of components
        joined = connected(materialize(links, "links"))
        if part is None:
            part = joined
        else:
            ends = part.join(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
            part = ends.unionByName(joined.join(part.select("node"), "node", "left_anti"))
        return part

    part = settled(parted, "part")
    least_of = listed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = part.join(least_of, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = part.join(named, "component").select("node", "component_id")
    nodes = least_of.join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("of_node"))
    out = listed.join(nodes, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("of_node")).otherwise(F.col("doc_id")).alias("component_id"))


def node_ids(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    raw = sets.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[8 * x : 8 * y], digest_size=8).digest(), "little", signed=True) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], dtype=np.int64)


def thinned(pairs: DataFrame, marks: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""
    one, two = (marks.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    sizes = pairs.join(one.drop("s_a"), "a").join(two.drop("s_b"), "b").where(F.least("n_a", "n_b") * least.denominator >= F.greatest("n_a", "n_b") * least.numerator)
    both = sizes.select("a", "b").join(one, "a").join(two, "b")

    def keep(batches):
        for b in batches:
            ok = [may_link(*x, least) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, type=pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(keep, "a long, b long")


def tasks(inside: DataFrame) -> DataFrame:
    """(task, node, component): every two nodes of a circle that are of different components are in a task together.

    inside: a (names the circle), b (a node in it) and its component. Components of more than PART nodes are
    cut in parts of their own, so two parts of one component are never compared.
    """
    own = inside.groupBy("a", "component").agg(F.count(F.lit(1)).alias("held"))
    small = own.groupBy("a").agg(F.sum(F.expr(f"case when held > {PART} then 0 else held end")).alias("small"), F.sum("held").alias("held_all"))
    # A circle that fits is one part; most are.
    sized = own.join(small, "a")
    cut = materialize(sized.where(f"held_all > {PART}").select("a", "component", "held", "small"), "cut")
    fits = inside.join(cut.select("a").distinct(), "a", "left_anti").select(F.col("a").alias("task"), F.col("b").alias("node"), "component")
    if cut.isEmpty():
        return fits
    place = F.expr(f"""case when held > {PART} then xxhash64(component, pmod(xxhash64(b, 3), cast(ceil(held / {PART}D) as long)))
        else xxhash64('small', pmod(xxhash64(component, 3), cast(ceil(small / {PART}D) as long))) end""")
    placed = materialize(inside.join(cut, ["a", "component"]).select("a", "b", "component", place.alias("part"), F.expr(f"held > {PART}").alias("one")), "placed")
    parts_ = placed.groupBy("a", "part").agg(F.max(F.expr("case when one then component end")).alias("one"))  # a row for each PART nodes, about
    x, y = (parts_.select("a", F.col("part").alias(f"part_{k}"), F.col("one").alias(f"one_{k}")) for k in (1, 2))
    pairs = x.join(y, "a").where("part_1 <= part_2 and not coalesce(one_1 = one_2, false)")
    pairs = pairs.select("a", F.array_distinct(F.array("part_1", "part_2")).alias("both"), F.xxhash64("a", "part_1", "part_2").alias("task"))
    dealt = placed.join(pairs.select("a", "task", F.explode("both").alias("part")), ["a", "part"])
    return fits.unionByName(dealt.select("task", F.col("b").alias("node"), "component"))


def by_task(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a task together, in order of node."""
    return rows.select("task", "node", "component", *more).repartition(parts(rows.sparkSession, 8), "task").sortWithinPartitions("task", "node")


def each_task(batches):
    """Tables of the rows of one task."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        g = np.asarray(b.column(0))
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))).tolist() if len(g) else []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            if held and g[x] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = g[x]
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def distinct_nodes(table: pa.Table) -> pa.Table:
    node = np.asarray(table.column("node").combine_chunks())
    return table.filter(pa.array(np.concatenate(([True], node[1:] != node[:-1]))))


@lean
def suspected(batches, least: Fraction):
    """The nodes of each task that may link with one of another component."""
    for table in map(distinct_nodes, each_task(batches)):
        part, n = (np.asarray(table.column(c).combine_chunks()) for c in ("component", "n"))
        hit = np.zeros(len(n), dtype=bool)
        for i, js in near(part, n, table.column("sketch").to_pylist(), least):
            hit[i] = hit[js] = True
        if hit.any():
            yield from table.select(["task", "node", "component"]).filter(pa.array(hit)).to_batches()


@lean
def forest(batches, least: Fraction):
    """Links (of components) found by whole sets, of which each joins what the task's links have not joined yet."""
    for table in map(distinct_nodes, each_task(batches)):
        part = np.asarray(table.column("component").combine_chunks())
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        above: dict[int, int] = {}

        def top(x: int, above: dict[int, int] = above) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        new = []
        for i, js in near(part, n, [sketch(x) for x in sets], least):
            for j in js:
                if (x := top(int(part[i]))) != (y := top(int(part[j]))) and similar(sets[i], sets[j], least):
                    above[max(x, y)] = min(x, y)
                    new.append((int(part[i]), int(part[j])))
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*new, strict=True)], names=["a", "b"])


def similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(x) + len(y) - both)


def sets_of(docs: DataFrame, listed: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, hashes) of the asked nodes, each read from one document."""
    source = listed.groupBy("node").agg(F.max("doc_id").alias("doc_id")).join(asked, "node").select("doc_id").distinct()

    @lean
    def sets(batches):
        for b, raw in _split(batches):
            got, off = shingle_sets(raw)
            yield pa.RecordBatch.from_arrays([pa.array(node_ids(got, off)), pa.array([got[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], type=pa.binary())], names=["node", "hashes"])

    # Rows that repeat a doc_id may give a set twice.
    return materialize(texts(docs).join(if_few(materialize(source, "sources")), "doc_id").mapInArrow(sets, "node long, hashes binary"), "sets")


def verify(docs: DataFrame, listed: DataFrame, pairs: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by their whole sets."""
    whole = sets_of(docs, listed, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())

    @lean
    def check(batches):
        for b in batches:
            keep = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, type=pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    sided = pairs.join(whole.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return sided.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def one_of_each(docs: DataFrame, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs less those whose component holds a smaller doc_id."""
    gone = settled(lambda: components(docs, least).where("doc_id <> component_id").select(F.col("doc_id").alias("near_id")).distinct(), "near")
    gone = if_few(gone)
    return docs.join(gone, F.col("doc_id") == F.col("near_id"), "left_anti")
