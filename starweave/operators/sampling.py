"""Random draws: files in rotation, as many points as the real catalogue has, by ranks of hashes or as numpy draws."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rotation(files: int, iterations: int) -> list[int]:
    """The file of each iteration: chosen by Random(j) among those unused, which are all again when none is left."""
    unused: list[int] = []
    out = []
    for j in range(iterations):
        if not unused:
            unused = list(range(files))
        pick = random.Random(j).choice(unused)
        unused.remove(pick)
        out.append(pick)
    return out


def rotation_table(spark: SparkSession, files: int, iterations: int) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rotation(files, iterations))), "randiter int, file_idx int")


def rank_hash(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in cols)))


def draw(pool: DataFrame, iterations: DataFrame, sizes: DataFrame, key: list[str], by_file: bool = False) -> DataFrame:
    """For each iteration, as many points of the pool as sizes(key, n_real) asks for.

    iterations(randiter [, file_idx]) and sizes are small dimension tables. Points are ranked by the hash of
    iteration and id, so draws repeat, whatever the partitions are. Only hashes low enough to be drawn, but for
    one case in a billion, are sorted; keys and iterations that this leaves short are ranked whole.
    """
    held = [*key, "file_idx"] if by_file else key
    asked = pool.groupBy(*held).agg(F.count(F.lit(1)).alias("n_pool")).join(sizes, key)  # a row for each key and file
    share = F.expr("(n_real + 6 * sqrt(n_real) + 10) / n_pool")
    asked = asked.withColumn("_below", F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex((share * 2**32).cast("long")), 8, "0"))))  # g is above all hex digits
    every = lambda df: df.join(F.broadcast(iterations), "file_idx") if by_file else df.crossJoin(F.broadcast(iterations.select("randiter")))
    rows = every(pool.join(asked, held)).withColumn("_hash", rank_hash(F.col("randiter"), F.col("targetid")))
    low = F.col("_hash") < F.col("_below")
    some = rows.where(low)
    met = some.groupBy(*key, "randiter").agg(F.count(F.lit(1)).alias("_met"))
    short = every(asked).join(met, [*key, "randiter"], "left").where("coalesce(_met, 0) < least(n_real, n_pool)")
    rest = rows.where(~low).join(short.select(*key, "randiter"), [*key, "randiter"], "left_semi").select(rows.columns)
    w = Window.partitionBy(*key, "randiter").orderBy("_hash", "targetid")
    drawn = some.union(rest).withColumn("_rank", F.row_number().over(w)).where("_rank <= n_real")
    return drawn.drop("_rank", "_hash", "_below", "n_real", "n_pool")


def short_pools(pool: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose pool is smaller than what is asked for; a draw from them cannot be made."""
    have = pool.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pool"))
    return sizes.join(have, key, "left").where("coalesce(n_pool, 0) < n_real")


def numpy_draw(pool: DataFrame, j: int, n: int, order: list[str]) -> DataFrame:
    """The rows that default_rng(j).choice(len(pool), n, replace=False) picks of the pool in this order."""
    total = pool.count()
    if total < n:
        raise ValueError(f"{n} of {total} rows asked for")
    spark = pool.sparkSession
    picked = spark.createDataFrame([(int(i),) for i in np.random.default_rng(j).choice(total, size=n, replace=False)], "_row long")
    rows = pool.withColumn("_row", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    return rows.join(picked, "_row").drop("_row")


def subsample(df: DataFrame, most: int, key: list[str], ident: str = "targetid", seed: int = 123) -> DataFrame:
    """At most so many rows of each key, by rank of hash (a feature of the views)."""
    w = Window.partitionBy(*key).orderBy(rank_hash(F.lit(seed), F.col(ident)), ident)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def block(df: DataFrame, rows: int, order: list[str], start: int = 0) -> DataFrame:
    """`rows` rows in a row from `start` on."""
    return df.withColumn("_row", F.row_number().over(Window.orderBy(*order))).where((F.col("_row") > start) & (F.col("_row") <= start + rows)).drop("_row")


def block_start(path: str, total: int, rows: int, seed: int = 0) -> int:
    """Where a block of `rows` of `total` rows of a file begins: a draw that its path and a seed fix."""
    own = int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "little")
    return int(np.random.default_rng((own + seed) % 2**32).integers(0, max(0, total - rows) + 1))


def expand(data: DataFrame, randoms: DataFrame, iterations: DataFrame) -> DataFrame:
    """Every data row in every iteration, beside the iteration's random points."""
    every = data.drop("randiter").crossJoin(F.broadcast(iterations.select("randiter"))).withColumn("isdata", F.lit(True))
    return every.unionByName(randoms.withColumn("isdata", F.lit(False)), allowMissingColumns=True)


def size_check(data: DataFrame, randoms: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Sizes of a zone's products: the class rows hold each data row in each iteration and each random row once."""
    n = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    out = n(data, "n_data").join(n(randoms, "n_rand"), key, "full").join(n(classes, "n_class"), key, "full").na.fill(0)
    return out.withColumn("effective_random", F.try_divide(F.col("n_class") - F.col("n_rand"), F.col("n_data")))
