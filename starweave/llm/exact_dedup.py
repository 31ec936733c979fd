"""Exact deduplication by a log-structured merge index.

Rows are dealt to memtables of about FLUSH rows by doc_id, so copies spread over all of them. A memtable is flushed
as one sorted run: digests in ascending order, Parquet with a Bloom filter and statistics on the digest. Compaction
merges FAN runs of a level into one run of the next, level by level, until one is left: a row for each digest with the smallest and the
largest identifier and the number of rows. It is a combinable aggregate, so a digest of very many copies is
pre-aggregated where it lies. A run has a filter besides: a bitmap of the places that its digests hash to, in
rows of fixed size. Digests met more than once are hits; texts are probed with the filter of the hits, and only
those that pass go on to byte verification, where the smallest and the largest text under a digest are compared.
If they differ, the digest is torn and its rows are grouped anew by the text itself.

Null texts count as empty. Of equal texts the row with the largest (or smallest) doc_id stays; rows that
repeat that doc_id with the same text all say kept, and deduplicate() gives one of them. A null doc_id stays only
where its group has no other. An empty table gives no rows. Only doc_id and text are read. No Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_path, filter_of, if_few, materialize, parts, probed, settled, shared_path, texts

#: Rows of a memtable, the fewest memtables of one call of add(), and runs that a compaction merges.
FLUSH = 1 << 20
LEAST = 16
FAN = 8

def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class MergeIndex:
    """Runs below `path`: add() flushes, compact() merges level by level, lookup() and probed() ask."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha256, kind: str = "bigint"):
        self.spark, self.path, self.digest, self.kind, self.flushed, self.rows = spark, path or shared_path(spark, "runs"), digest, kind, 0, 0

    def add(self, docs: DataFrame) -> None:
        """Flushes the rows as runs of (digest, doc_id) of level 0."""
        rows = materialize(texts(docs).select(self.digest(F.col("text")).alias("digest"), "doc_id"), "digests")
        self.rows += (n := rows.count())
        flushes = max(LEAST, -(-n // FLUSH))
        rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(flushes)) + self.flushed)
        self._write(rows.repartition(flushes, "run"), 0, n // flushes, "doc_id")
        self.flushed += flushes

    def _write(self, rows: DataFrame, level: int, each: int, *order: str) -> None:
        """Sorted runs; each: digests in a file, about, for which its Bloom filter is laid out."""
        how = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(max(1000, each)), "compression": "zstd"}
        rows.sortWithinPartitions("run", "digest", *order).write.options(**how).partitionBy("run").mode("append").parquet(f"{self.path}/level={level}")

    def runs(self, level: int = 0) -> DataFrame:
        if level:
            kinds = "digest binary, smallest {0}, largest {0}, n long, run long"
        else:
            kinds = "digest binary, doc_id {0}, run long"
        return self.spark.read.schema(kinds.format(self.kind)).parquet(f"{self.path}/level={level}")

    def compact(self) -> DataFrame:
        """One run with a row for each digest: digest, smallest, largest, n."""
        level, left = 0, self.flushed
        while True:
            own = self.runs(level)
            own = own.select("run", "digest", F.col("doc_id").alias("smallest"), F.col("doc_id").alias("largest"), F.lit(1).cast("long").alias("n")) if not level else own
            merged = own.groupBy(F.expr(f"run div {FAN}").alias("run"), "digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
            level, left = level + 1, -(-left // FAN)
            drop_path(self.spark, f"{self.path}/level={level}")
            self._write(merged, level, self.rows // parts(self.spark))
            if left <= 1:
                return self.runs(level).drop("run")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Rows of the flushed runs with these digests; Bloom filters and statistics prune files and row groups."""
        return self.runs().where(F.col("digest").isin([bytearray(d) for d in digests]))


def groups(docs: DataFrame, keep: str = "max", digest=sha256) -> DataFrame:
    """Per row of docs: doc_id, digest, keep_id, group_size, kept."""
    index = MergeIndex(docs.sparkSession, digest=digest, kind=docs.schema["doc_id"].dataType.simpleString())
    index.add(docs)
    merged = index.compact().select("digest", F.col("largest" if keep == "max" else "smallest").alias("keep_id"), F.col("n").alias("group_size"))
    rows = texts(docs).select(digest(F.col("text")).alias("digest"), "doc_id", "text")
    hits = merged.where("group_size > 1").select("digest")

    def torn_digests() -> DataFrame:
        same = probed(rows.select("digest", "text"), *filter_of(hits))
        return same.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest")

    torn = settled(torn_digests, "torn")
    found = index.runs().drop("run").join(merged, "digest")
    if not torn.isEmpty():  # one digest, several texts
        own = materialize(rows.join(torn, "digest", "left_semi"), "own")
        pick = F.max("doc_id") if keep == "max" else F.min("doc_id")
        each = own.groupBy("digest", "text").agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        parted = own.join(each, ["digest", "text"])
        found = found.join(torn, "digest", "left_anti").unionByName(parted.select("digest", "doc_id", "keep_id", "group_size"))
    return found.select("doc_id", "digest", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"))


def deduplicate(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, one for each text, with their columns."""

    def told() -> DataFrame:  # a row that repeats its doc_id with another text is told apart by the text's digest
        found = groups(docs, keep).where("group_size > 1").groupBy("doc_id", "digest").agg(F.first("kept").alias("stays"), F.count(F.lit(1)).alias("times"))
        return found.where("not stays or times > 1").select(F.col("doc_id").alias("told_id"), F.col("digest").alias("told_digest"), "stays")

    found = settled(told, "told")
    own = sha256(F.coalesce(F.col("text").cast("string"), F.lit("")))
    here = F.col("doc_id").eqNullSafe(F.col("told_id")) & (own == F.col("told_digest"))
    out = docs.join(if_few(found), here, "left_anti")
    again = found.where("stays")
    if not again.isEmpty():  # rows that repeat doc_id and text
        out = out.unionByName(docs.join(if_few(again), here, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out
