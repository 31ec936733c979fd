"""A corpus cleaned and packed: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written
as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starweave.llm import exact_dedup, packing, parity_join, pii, toxicity
from starweave.llm.shared import materialize
from starweave.llm.words import vocabulary_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic by models of the labelled rows."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs, keep="max")


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id."""
    return parity_join.one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("jaccard_join", dissimilar), ("pii", redacted), ("packing", packed)]

#: Scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
