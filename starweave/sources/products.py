"""Products on disk: Parquet folders partitioned by zone, tracer and iteration, built once, combined, listed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists

PRODUCTS = ("raw", "pairs", "classification", "probability", "groups")
PARTITIONS = {"raw": ["zone"], "pairs": ["zone", "tracer", "randiter"], "classification": ["zone", "tracer", "randiter"], "probability": ["zone", "tracer"], "groups": ["zone", "webtype"]}


def write_product(df: DataFrame, root: str, product: str, tag: str = "", keys: list[str] | None = None) -> str:
    """Below root/product[_tag]; replaces only the partitions that df holds, when its files are committed."""
    path = f"{root}/{product}{'_' + tag if tag else ''}"
    keys = [k for k in (PARTITIONS.get(product, []) if keys is None else keys) if k in df.columns]
    # Rows of a partition go to few files; a large one is still split by size.
    df = df.hint("rebalance", *keys) if keys else df
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return path


def read_product(spark: SparkSession, root: str, product: str, tag: str = "", columns: list[str] | None = None) -> DataFrame:
    """The tagged product, else the untagged one; columns that are there among those asked for, at least one."""
    paths = [p for p in ([f"{root}/{product}_{tag}"] if tag else []) + [f"{root}/{product}"] if exists(spark, p)]
    if not paths:
        raise FileNotFoundError(f"{product} below {root}")
    df = spark.read.parquet(paths[0])
    return pick(df, columns) if columns else df


def pick(df: DataFrame, columns: list[str]) -> DataFrame:
    there = [c for c in columns if c in df.columns]
    if not there:
        raise KeyError(f"none of {columns}")
    return df.select(there)


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What is at the path, built and written first if nothing is."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def combined(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def manifest(products: dict[str, DataFrame]) -> DataFrame:
    """product, zone, rows."""
    return combined([df.groupBy(F.col("zone").cast("string").alias("zone")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("product"), "zone", "rows") for name, df in products.items()])


def iteration_tag(c):
    """Names of an iteration's files: iterdata for real data, iterNNN, iterm00N for other negative numbers."""
    return F.when(c == -1, "iterdata").when(c < 0, F.concat(F.lit("iterm"), F.lpad((-c).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("iter"), F.lpad(c.cast("string"), 3, "0")))


def zones(df: DataFrame) -> DataFrame:
    """Distinct zones, numbers first."""
    z = F.col("zone").cast("string")
    return df.select(z.alias("zone")).distinct().orderBy(F.expr("try_cast(zone AS bigint) IS NULL"), F.expr("try_cast(zone AS bigint)"), "zone")
