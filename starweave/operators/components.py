"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_since, materialize, written


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Large-star and small-star rounds in turn, each written to the shared folder, until no edge changes; a
    round's table is dropped when the next one stands. A star points every neighbour at the smallest one, so
    rows never outnumber edges and nodes, and the minimum per node is a combinable aggregate: a hub is no hot task.
    """

    def settled(df: DataFrame, drop: bool = True) -> tuple[DataFrame, tuple]:
        mark = written()
        df = materialize(df, "edges")
        if drop:
            drop_since(mark - 1, keep=1)
        return df, tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, mark = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), drop=False)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(low, "a")
        small = kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now, new = settled(small)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return ends.groupBy("node").agg(F.min("component").alias("component"))
