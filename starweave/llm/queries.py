"""The registered queries of these operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cover_tree, exact_dedup, packing, parity_join, pii, repeats, sentence_pieces, token_counts, token_output, toxicity
from .words import vocabulary_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_docs(spark, sf_dir)).selectExpr("doc_id", "keep_id", "group_size", "kept", "lower(hex(digest)) AS text_sha256")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoding_digests(_docs(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_docs(spark, sf_dir), length=400).drop("spans")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components(_docs(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_docs(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digests(_docs(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), end_id=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_sentence_pieces, op4_repeats, op5_jaccard_join, op6_pii, op7_packing, op8_token_output, op9_toxicity, op10_cover_tree)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_cover_tree": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
        FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN part p ON p.a = e.vec_id""",
}
