"""Token ids as ORC files.

Documents are dealt by ranges of doc_id and sorted within, so file after file holds them in ascending
order; a task encodes its range and Spark's ORC writer lays the ids out in stripes with integer
run-length encoding, row indexes, and Bloom filters and statistics on doc_id, by which a reader prunes
stripes. Every row carries its range and its place within the range; what all earlier ranges hold is
added on reading, from one small row for each range, so no file has to wait for another.

Null and empty texts hold the end id alone. Rows of equal doc_id are ordered by text; a null doc_id comes
first. An empty table gives files without rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import joined, parts, shared_path, slices, texts
from .words import byte_bpe, packed

ORC = {"compression": "zstd", "orc.stripe.size": str(32 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Writes ORC files of (doc_id, ids, first: ids before it in its range, range: the range's rank)."""

    def run(batches):
        own, end, at, where = byte_bpe(vocabulary), packed([end_id]), 0, TaskContext.get().partitionId()
        schema = None
        for b in slices(batches, trim=False):
            out = [x + end for x in own.batch(b.column(1))]
            size = np.fromiter(map(len, out), dtype=np.int64, count=len(out)) >> 2
            ends = np.concatenate(([0], np.cumsum(size)))
            ids = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(out))]))
            schema = schema or pa.schema([("doc_id", b.column(0).type), ("ids", ids.type), ("first", pa.int64()), ("range", pa.int32())])
            yield joined(schema, [b.column(0), ids, pa.array(at + ends[:-1]), pa.array(np.full(len(out), where, dtype=np.int32))])
            at += int(ends[-1])

    dealt = texts(docs).repartitionByRange(parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, first long, range int").write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`: ids of all documents before; filters on doc_id reach the stripes."""
    rows = spark.read.orc(path)
    held = rows.groupBy("range").agg(F.sum(F.size("ids").cast("long")).alias("held"))  # a row for each range
    before = held.select("range", (F.sum("held").over(Window.orderBy("range")) - F.col("held")).alias("before"))
    return rows.join(F.broadcast(before), "range").select("doc_id", "ids", (F.col("before") + F.col("first")).alias("start"))


def token_digests(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, vocabulary, end_id, path)

    def run(batches):
        schema = None
        for b in batches:
            ids = b.column(1)
            off = np.asarray(ids.offsets).astype(np.int64)
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B")
            schema = schema or pa.schema([("doc_id", b.column(0).type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
            yield joined(schema, [b.column(0), b.column(2), off[1:] - off[:-1], [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]])

    return read_tokens(spark, path).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
