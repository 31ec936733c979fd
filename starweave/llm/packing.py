"""Best-fit packing by patterns.

The lengths of all pieces make a histogram of at most `capacity` bins. Patterns of two or three pieces that
fill a sequence exactly are enumerated, non-negative least squares fits how often each is repeated, the
counts are rounded down to what the histogram holds, and the residual is packed best-fit, longest first,
many equal bins at a time. The driver sees the histogram and the resulting runs only, both bounded by the
capacity, never by the data. A piece finds its place from its length and its rank among pieces of that
length; ranks are counted within each task and made global by one row for each task and length.

Null and empty texts are one piece holding the end id. Repeated rows are packed each on its own; an empty
table gives no piece. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined, lean, materialize, slices, texts
from .words import byte_bpe, packed

#: Partners tried for each length when triples are enumerated.
TRIPLES = 24
ROUNDS = 150


def patterns(hist: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence exactly, of lengths that occur."""
    cap = len(hist) - 1
    there = np.flatnonzero(hist[1:]) + 1
    rows = [np.stack([there, cap - there, 0 * there], 1)[(cap - there >= there) & (hist[cap - there] > 0) & (there < cap)]]
    if hist[cap]:
        rows.append(np.array([[cap, 0, 0]]))
    common = there[np.argsort(-hist[there], kind="stable")]
    for a in there:
        b = common[(common <= a) & (common < cap - a)]
        c = cap - a - b
        ok = (c <= b) & (hist[c] > 0)
        b, c = b[ok][:TRIPLES], c[ok][:TRIPLES]
        if len(b):
            rows.append(np.stack([np.full(len(b), a), b, c], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)


def fitted(hist: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - hist|, by multiplicative updates (they keep x non-negative)."""
    n = len(hist)
    weight = 1.0 / np.maximum(hist, 1.0)  # relative error: rare lengths count as well
    x = np.ones(len(rows))
    used = rows > 0
    target = np.where(used, (hist * weight)[rows], 0).sum(1)
    for _ in range(ROUNDS):
        made = np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=n)
        made[0] = 0
        x *= target / np.maximum(np.where(used, (made * weight)[rows], 0).sum(1), 1e-12)
    return x


def plan(hist: np.ndarray) -> np.ndarray:
    """Runs (length, first rank, end rank, first sequence, offset) that place every piece of the histogram."""
    cap, left = len(hist) - 1, hist.astype(np.int64).copy()
    taken = np.zeros(cap + 1, dtype=np.int64)
    classes: list[tuple[int, list[tuple[int, int]]]] = []  # bins alike: how many, slots of (length, first rank)
    rows = patterns(hist)
    x = fitted(hist, rows)
    for k in np.argsort(-x, kind="stable"):
        need: dict[int, int] = {}
        for length in rows[k].tolist():
            if length:
                need[length] = need.get(length, 0) + 1
        n = min(int(x[k]), *(int(left[length]) // m for length, m in need.items()))
        if n:
            slots = []
            for length, m in need.items():
                for _ in range(m):
                    slots.append((length, int(taken[length])))
                    taken[length] += n
                left[length] -= m * n
            classes.append((n, slots))
    room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(cap + 1)]  # open bins by what they still hold
    for length in np.flatnonzero(left)[::-1].tolist():
        count, r = int(left[length]), length
        while count:
            while r <= cap and not room[r]:
                r += 1
            n, slots = room[r].pop() if r <= cap else (count, [])
            hold = r if r <= cap else cap
            each = min(hold // length, count)
            full = min(n, count // each)
            if slots and full < n:
                room[hold].append((n - full, [(a, b + full) for a, b in slots]))
            own = list(slots)
            for _ in range(each):
                own.append((length, int(taken[length])))
                taken[length] += full
            count -= each * full
            room[hold - each * length].append((full, own))
            r = length
    out, sequence = [], 0
    for n, slots in [*classes, *(c for bins in room for c in bins)]:
        at = 0
        for length, rank in slots:
            out.append((length, rank, rank + n, sequence, at))
            at += length
        sequence += n
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and rank among the task's pieces of its length."""

    @lean
    def run(batches):
        own, end, where, seen = byte_bpe(vocabulary), packed([end_id]), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64).tolist()
        schema = None
        for b in slices(batches, limit=1 << 20):
            rows = []
            for k, ids in enumerate(own.batch(b.column(1))):
                ids += end
                n, start, piece = len(ids) >> 2, 0, 0
                while start < n:
                    size = capacity if piece or n % capacity == 0 else n % capacity
                    rows.append((k, piece, start, size, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)]), where, seen[size]))
                    seen[size] += 1
                    start, piece = start + size, piece + 1
            of, *cols = np.array(rows, dtype=np.int64).T
            schema = schema or pa.schema([("doc_id", b.column(0).type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
            yield joined(schema, [b.column(0).take(pa.array(of)), *(pa.array(c).cast(f.type) for c, f in zip(cols, list(schema)[1:], strict=True))])
        own.forget()  # a worker that waits holds no words

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, vocabulary, end_id, capacity), "pieces")
    each = cut.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    each = materialize(each, "lengths")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    runs = plan(hist)
    base = each.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    keys = (runs[:, 0] << 44) | runs[:, 1]

    def place(batches):
        for b in batches:
            col = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            length, rank = np.asarray(col["length"]), np.asarray(col["rank"])
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            new = [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays([*(col[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")), *new], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
