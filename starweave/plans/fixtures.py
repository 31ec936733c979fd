"""The driver's tables in the roles of catalogues, with the same bindings in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour counts of (targetid, randiter) from order lines."""
    n = F.col("l_returnflag") == "N"
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("targetid"), F.col("l_linenumber").alias("randiter")).agg(F.count_if(n).alias("ndata"), F.count_if(~n).alias("nrand"), F.min("l_suppkey").alias("suppkey"))


COUNTS = "counts AS (SELECT l_partkey AS targetid, l_linenumber AS randiter, count(*) FILTER (l_returnflag = 'N') AS ndata, count(*) FILTER (l_returnflag <> 'N') AS nrand, min(l_suppkey) AS suppkey FROM lineitem GROUP BY ALL)"
R = "(CASE WHEN ndata + nrand > 0 THEN (ndata - nrand)::DOUBLE / (ndata + nrand) END)"
TYPE = "CASE WHEN r < -0.9 THEN 'void' WHEN r < 0 THEN 'sheet' WHEN r < 0.9 THEN 'filament' WHEN r IS NOT NULL THEN 'knot' END"
TYPED = f"{COUNTS}, ratios AS (SELECT *, {R} AS r FROM counts), typed AS (SELECT *, {TYPE} AS webtype FROM ratios)"
PROBS = f"{TYPED}, probs AS (SELECT targetid, " + ", ".join(f"coalesce(sum(CASE WHEN webtype = '{t}' THEN 1.0::DOUBLE ELSE 0 END) / nullif(count(webtype), 0), 0)::DOUBLE AS p{t}" for t in ("void", "sheet", "filament", "knot")) + " FROM typed GROUP BY targetid)"


def zoned(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    """With the supplier's nation as zone."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("zone"))
    return df.join(s, "suppkey")


ZONED = "zoned AS (SELECT typed.*, s_nationkey AS zone FROM typed JOIN supplier ON s_suppkey = suppkey)"


def sky(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of real objects from customers."""
    k = F.col("c_custkey").cast("double")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("targetid"), (k * 137.508 % 360.0).alias("ra"), (k * 61.8 % 120.0 - 60.0).alias("dec"), ((F.col("c_acctbal") + 1000.0) / 11000.0 * 2.0).alias("z"), F.col("c_mktsegment").alias("tracer"), F.col("c_nationkey").alias("zone"))


SKY = "sky AS (SELECT c_custkey AS targetid, (c_custkey::DOUBLE * 137.508::DOUBLE) % 360.0::DOUBLE AS ra, (c_custkey::DOUBLE * 61.8::DOUBLE) % 120.0::DOUBLE - 60.0::DOUBLE AS dec, (c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE * 2.0::DOUBLE AS z, c_mktsegment AS tracer, c_nationkey AS zone FROM customer)"


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Random points from orders, in 18 files; tracer and zone are the customer's."""
    k = F.col("o_orderkey").cast("double")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("targetid"), (F.col("o_orderkey") % 18).cast("int").alias("file_idx"), (k * 97.31 % 360.0).alias("ra"), (k * 43.7 % 120.0 - 60.0).alias("dec"), (F.col("o_totalprice") % 11000.0 / 11000.0 * 2.0).alias("z"), "o_custkey")
    return o.join(sky(spark, d).select(F.col("targetid").alias("o_custkey"), "tracer", "zone"), "o_custkey").drop("o_custkey")


POOL = f"{SKY}, pool AS (SELECT o_orderkey AS targetid, (o_orderkey % 18)::INT AS file_idx, (o_orderkey::DOUBLE * 97.31::DOUBLE) % 360.0::DOUBLE AS ra, (o_orderkey::DOUBLE * 43.7::DOUBLE) % 120.0::DOUBLE - 60.0::DOUBLE AS dec, o_totalprice % 11000.0::DOUBLE / 11000.0::DOUBLE * 2.0::DOUBLE AS z, tracer, zone FROM orders JOIN sky ON o_custkey = sky.targetid)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """A cloud from the first three components of vectors, a block for each label."""
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    return rows.select(F.col("vec_id").alias("pid"), F.col("label").alias("tracer"), *(e[k].cast("double").alias(c) for k, c in enumerate("xyz")), (F.col("vec_id") % 2 == 0).alias("isdata"))


POINTS = "points AS (SELECT vec_id AS pid, label AS tracer, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, vec_id % 2 = 0 AS isdata FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts and suppliers, an iteration for each line number."""
    return table(spark, d, "lineitem").select(F.lit("all").alias("tracer"), F.col("l_linenumber").alias("randiter"), F.col("l_partkey").alias("id1"), (F.col("l_suppkey") + 1_000_000).alias("id2")).distinct()


EDGES = "edges AS (SELECT DISTINCT 'all' AS tracer, l_linenumber AS randiter, l_partkey AS id1, l_suppkey + 1000000 AS id2 FROM lineitem)"


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Tracers' labels: the parts' types with a suffix, and edge cases."""
    p = table(spark, d, "part")
    made = p.select(F.concat(F.regexp_replace("p_type", " ", "_"), F.element_at(F.array(F.lit("_DATA"), F.lit("_rand"), F.lit(""), F.lit("_Data")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("label"))
    return made.union(p.sparkSession.createDataFrame([("BGS_ANY_DATA",), ("ELG_LOPnotqso_RAND",), ("LRG_data",), ("QSO",), ("",), (None,)], "label string"))


LABELS = "labels AS (SELECT replace(p_type, ' ', '_') || ['_DATA', '_rand', '', '_Data'][p_partkey % 4 + 1] AS label FROM part UNION ALL VALUES ('BGS_ANY_DATA'), ('ELG_LOPnotqso_RAND'), ('LRG_data'), ('QSO'), (''), (NULL))"
