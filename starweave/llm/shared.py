"""Plumbing shared by the text operators: texts, batches, broadcasts of a checked size."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected
from ..session import ship
from ..storage import drop_path, drop_since, materialize, settled, shared_dir, shared_path, written

__all__ = ["connected", "drop_path", "drop_since", "filter_of", "if_few", "joined", "lean", "materialize", "parts", "probed", "release", "settled", "shared_dir", "shared_path", "slices", "texts", "written"]

#: Rows up to which a narrow table (some hundred bytes a row at most) is broadcast.
FEW = 200_000
#: Bits of a filter for each key, and bits in one row of it (what Spark's bitmaps hold).
BITS = 16
ROW = 32768
#: Rows of a filter (4 KB each) up to which it is broadcast; a larger one is joined by a shuffle.
FEW_ROWS = 8192
#: Bytes of texts after which a worker gives freed memory back.
RELEASED = 4 << 20


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df to be broadcast if it has few rows, which is counted; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cell(key: str, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size))


def filter_of(keys: DataFrame, key: str = "digest") -> tuple[DataFrame, int]:
    """Rows (at, bits) of a bitmap over the places of all keys, and how many places there are."""
    size = max(ROW, BITS * keys.count())
    rows = keys.select(cell(key, size).alias("x")).select(F.expr(f"x div {ROW}").alias("at"), F.expr(f"x % {ROW}").alias("x"))
    return materialize(rows.groupBy("at").agg(F.bitmap_construct_agg("x").alias("bits")), "filter"), size


def probed(rows: DataFrame, bitmap: DataFrame, size: int, key: str = "digest") -> DataFrame:
    """The rows whose key the filter may hold: all that it holds, and about one in BITS of the others."""
    bitmap = if_few(bitmap, FEW_ROWS)
    named = rows.withColumn("place", cell(key, size)).withColumn("at", F.expr(f"place div {ROW}"))
    held = F.expr(f"(shiftright(cast(conv(hex(substring(bits, cast((place % {ROW}) div 8 + 1 as int), 1)), 16, 10) as int), cast(place % 8 as int)) & 1) = 1")
    return named.join(bitmap, "at").where(held).select(rows.columns)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null counts as empty), with nothing else that documents may carry."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batches, column: str = "text", limit: int = 8 << 20, trim: bool = True):
    """Record batches cut so that `column` holds about `limit` bytes at most; a longer single value stays whole.

    With trim, memory freed meanwhile goes back to the system every RELEASED bytes.
    """
    since = 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        start = 0
        while start < len(col):
            n = len(col) - start
            while n > 1 and col.slice(start, n).nbytes > limit:
                n = max(1, n // 2)
            yield batch.slice(start, n)
            since += col.slice(start, n).nbytes
            start += n
            if trim and since >= RELEASED:
                since = 0
                release()


def joined(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def release() -> None:
    """Gives freed memory back to the system: workers are used again, and what one step has freed counts in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run):
    """run(batches, ...), a generator over a task's batches, with its freed memory given back when the task ends."""

    @wraps(run)
    def own(batches, *more):
        release()  # what tasks of other steps have left
        try:
            yield from run(batches, *more)
        finally:
            gc.collect()
            release()

    return own
