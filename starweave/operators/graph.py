"""Graphs of points: Delaunay edges, neighbour counts, radius pairs, and filters on edges; nearest neighbours are in nearest.py."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..storage import materialize
from . import delaunay
from .nearest import nearest  # noqa: F401


def spread_blocks(df: DataFrame, block: list[str]) -> DataFrame:
    """Blocks in many partitions: a block takes seconds but has few bytes, by which partitions would be put together."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *block)


def delaunay_edges(points: DataFrame, block: list[str], on_degenerate: str = "empty") -> DataFrame:
    """block..., id1 < id2 for each edge of each block's triangulation.

    points: block columns, pid (unique within a block), x, y, z. A block is one unit of geometry and one
    group; of points that coincide the smallest pid stands for all, and points without a place have no edges. Blocks without a triangulation have no
    edges, or raise with on_degenerate='raise'.
    """
    ship(points.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def run(table: pa.Table) -> pa.Table:
        pid = np.asarray(table.column("pid").combine_chunks())
        at = np.stack([np.asarray(table.column(c).combine_chunks()).astype(float) for c in "xyz"], 1)
        order = np.argsort(pid, kind="stable")
        pid, at = pid[order], at[order]
        _, one = np.unique(at, axis=0, return_index=True)
        one = np.sort(one[np.isfinite(at[one]).all(1)])
        try:
            found = delaunay.edges(at[one])
        except delaunay.DegenerateError:
            if on_degenerate == "raise":
                raise
            found = np.zeros((0, 2), dtype=int)
        ends = np.sort(pid[one][found], 1) if len(found) else np.zeros((0, 2), dtype=pid.dtype)
        first = table.slice(0, 1)
        cols = {c: pa.array([first.column(c)[0].as_py()] * len(ends), type=table.schema.field(c).type) for c in block}
        return pa.table({**cols, "id1": pa.array(ends[:, 0]), "id2": pa.array(ends[:, 1])})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in block), f"id1 {kinds['pid']}", f"id2 {kinds['pid']}"])
    return spread_blocks(points.select(*block, "pid", "x", "y", "z"), block).groupBy(*block).applyInArrow(lambda t: run(t), schema)


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("id1", "id2")]
    there = edges.select(*rest, F.col("id1").alias("pid"), F.col("id2").alias("other"))
    return there.union(edges.select(*rest, F.col("id2").alias("pid"), F.col("id1").alias("other")))


def neighbour_counts(points: DataFrame, edges: DataFrame, block: list[str]) -> DataFrame:
    """points(block, pid, isdata) with ndata and nrand, the neighbours of either kind; 0 for isolated points."""
    kind = points.select(*block, F.col("pid").alias("other"), F.col("isdata").alias("other_isdata"))
    n = both_ways(edges).join(kind, [*block, "other"]).groupBy(*block, "pid").agg(F.count_if("other_isdata").alias("ndata"), F.count_if(~F.col("other_isdata")).alias("nrand"))
    return points.join(n, [*block, "pid"], "left").na.fill(0, ["ndata", "nrand"])


def classes_of_pairs(pairs: DataFrame, ids: DataFrame, iterations: DataFrame) -> DataFrame:
    """Class rows made anew from stored pairs(tracer, randiter, id1, id2).

    ids(tracer, pid, randiter): -1 for data. Every data id has a row in each iteration, every random id in
    its own; counts are 0 where no pair names it.
    """
    data = ids.where("randiter = -1").select("tracer", "pid").crossJoin(F.broadcast(iterations.select("randiter"))).withColumn("isdata", F.lit(True))
    points = data.unionByName(ids.where("randiter <> -1").withColumn("isdata", F.lit(False)))
    return neighbour_counts(points, pairs, ["tracer", "randiter"])


def radius_pairs(points: DataFrame, block: list[str], eps: float) -> DataFrame:
    """block..., id1 < id2, distance of all pairs of a block at most eps apart, by cells of side eps: an equi-join, not a theta-join.

    Of two neighbouring cells only one looks into the other, so a pair meets once.
    """
    cell = [F.floor(F.col(c) / eps).alias(f"c{c}") for c in "xyz"]
    half = [(i, j, k) for i in (0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in half))
    left = points.select(*block, F.col("pid").alias("id1"), *(F.col(c).alias(f"{c}1") for c in "xyz"), *cell, F.explode(offsets).alias("o"))
    left = left.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j"), "cz": F.col("cz") + F.col("o.k"), "other": (F.col("o.i") != 0) | (F.col("o.j") != 0) | (F.col("o.k") != 0)}).drop("o")
    right = points.select(*block, F.col("pid").alias("id2"), *(F.col(c).alias(f"{c}2") for c in "xyz"), *cell)
    d2 = reduce(lambda a, b: a + b, ((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"))
    # Cells have few bytes and many pairs, as blocks of geometry do.
    left = spread_blocks(left, [*block, "cx", "cy", "cz"])
    found = left.join(right, [*block, "cx", "cy", "cz"]).where("id1 < id2 OR (other AND id1 > id2)").where(F.sqrt(d2) <= eps)
    return found.select(*block, F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), F.sqrt(d2).alias("distance"))


def quantiles(edges: DataFrame, block: list[str], shares: list[float], bins: int = 8192) -> DataFrame:
    """block..., q0, q1, ...: exact quantiles of distance, between two values in proportion; NULL ones do not count.

    Distances are counted in bins, so many to a doubling, then those of the few bins that hold a quantile by value:
    what is held in memory or shuffled grows with the bins, not with the edges. edges is read twice.
    """
    value = F.col("distance")
    # Of equal order as the distance; what has no logarithm comes first, NaN last as in ORDER BY.
    bin_ = F.when(F.isnan(value), 2**31 - 1).when(value == float("inf"), 2**31 - 2).when(value <= 0, -(2**31)).otherwise(F.floor(F.log2(value) * bins).cast("int"))
    rows = edges.where(value.isNotNull()).select(*block, value, bin_.alias("_bin"))
    upto = lambda by: Window.partitionBy(*block).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = materialize(rows.groupBy(*block, "_bin").agg(F.count(F.lit(1)).alias("_m")), "bins")
    places = counts.groupBy(*block).agg(F.sum("_m").alias("_n"))
    at = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    holds = lambda place: (place >= F.col("_end") - F.col("_m")) & (place < F.col("_end"))
    ends = counts.withColumn("_end", F.sum("_m").over(upto("_bin"))).join(places, block)
    wanted = ends.where(reduce(lambda a, b: a | b, (holds(f(p)) for p in at for f in (F.floor, F.ceil))))
    wanted = materialize(wanted.select(*block, "_bin", "_n", (F.col("_end") - F.col("_m")).alias("_before")), "wanted")
    values = materialize(rows.join(wanted.select(*block, "_bin"), [*block, "_bin"]).groupBy(*block, "_bin", "distance").agg(F.count(F.lit(1)).alias("_m")), "values")
    values = values.withColumn("_end", F.sum("_m").over(Window.partitionBy(*block, "_bin").orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    values = values.join(wanted, [*block, "_bin"]).withColumn("_end", F.col("_end") + F.col("_before"))
    sides = [F.max(F.when(holds(f(p)), value)) for p in at for f in (F.floor, F.ceil)]
    found = values.groupBy(*block, "_n").agg(*(s.alias(f"_s{n}") for n, s in enumerate(sides)))
    low, high = ([F.col(f"_s{2 * n + k}") for n in range(len(shares))] for k in (0, 1))
    # As DuckDB has it; equal ones may be infinite.
    between = [F.when((F.ceil(p) == F.floor(p)) | (a == b), a).otherwise(a + (p - F.floor(p)) * (b - a)) for p, a, b in zip(at, low, high, strict=True)]
    return found.select(*block, *(b.alias(f"q{n}") for n, b in enumerate(between)))


def within_length(edges: DataFrame, block: list[str], limit: float | None = None) -> DataFrame:
    """Edges no longer than the limit, or than the larger of the 95th percentile and 2.5 medians of their block.

    The edges are made anew for each reading, as they may be far more than the points and are neither kept nor shuffled.
    """
    if limit is not None:
        return edges.where(F.col("distance") <= limit)
    q = materialize(quantiles(edges, block, [0.95, 0.5]).select(*block, F.greatest("q0", 2.5 * F.col("q1")).alias("most")), "limits")
    return edges.join(q, block).where("distance <= most").drop("most")


def within_groups(pairs: DataFrame, members: DataFrame, block: list[str], across: bool = False) -> DataFrame:
    """Undirected edges once, of different points that are both members(block, pid, groupid), of one group unless `across`."""
    one = pairs.where("id1 <> id2").select(*block, F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()
    m1 = members.select(*block, F.col("pid").alias("id1"), F.col("groupid").alias("g1"))
    m2 = members.select(*block, F.col("pid").alias("id2"), F.col("groupid").alias("g2"))
    found = one.join(m1, [*block, "id1"]).join(m2, [*block, "id2"])
    return (found if across else found.where("g1 = g2")).select(*block, "id1", "id2", F.col("g1").alias("groupid"))
