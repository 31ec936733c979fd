"""Nearest neighbours by leaves of a few hundred points: each point asks only the leaves that its k-th distance reaches.

Points are sorted along a curve through their block's box and cut into leaves in one pass over each partition. Within
its leaf a point has a k-th distance, which bounds its search in the other leaves. Only the first k + 1 ids of one
place can be anyone's nearest, so copies of a place answer nothing. Work and storage grow with the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..storage import materialize

#: Points of a leaf at most, and points that are cut into leaves together; any give the same result.
LEAF, CHUNK = 256, 65_536
#: Bits of each coordinate along the curve.
BITS = 20
#: Boxes count as nearer by this share, more than rounding makes of their distances.
SLACK = 1 - 1e-9


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (p * p for p in parts)))


def _leaves(at: np.ndarray, most: int) -> Iterator[np.ndarray]:
    todo = [np.arange(len(at))]
    while todo:
        some = todo.pop()
        if len(some) <= most:
            yield some
            continue
        axis = int((at[some].max(0) - at[some].min(0)).argmax())
        todo += np.split(some[np.argpartition(at[some, axis], len(some) // 2)], [len(some) // 2])


def _place(run: pa.Table, k: int, leaf: int) -> pa.Table:
    """Sorted points of one block with their leaf, the distance in it that holds k others, and whether they can be others' nearest."""
    n, pid = len(run), np.asarray(run.column("pid").combine_chunks())
    at = np.stack([np.asarray(run.column(c).combine_chunks()) for c in "xyz"], 1)
    new = np.append(True, (at[1:] != at[:-1]).any(1))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ids = np.cumsum(new | np.append(True, pid[1:] != pid[:-1]))
    lead = ids - ids[first] <= k
    leads = np.flatnonzero(lead)
    of, reach = np.zeros(n, dtype=np.int64), np.zeros(n)
    with np.errstate(over="ignore"):
        for some in _leaves(at[leads], leaf):
            some = leads[some]
            of[some], reach[some] = some.min(), np.inf
            if len(some) > k:
                d = [at[some, None, c] - at[None, some, c] for c in range(3)]
                d = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
                d[pid[some, None] == pid[None, some]] = np.inf
                reach[some] = np.partition(d, k - 1, axis=1)[:, k - 1]
    of[~lead] = of[first[~lead]]
    more = {"_leaf": run.column("pid").take(pa.array(of)), "_chunk": run.column("pid").take(pa.array(np.zeros(n, dtype=np.int64))), "_reach": pa.array(reach), "_lead": pa.array(lead)}
    return pa.table({**{c: run.column(c) for c in run.column_names}, **more})


def _placed(rows: DataFrame, block: list[str], k: int) -> DataFrame:
    """rows(block..., pid, x, y, z, lo, hi) with what _place() adds."""
    share = lambda c: F.coalesce(F.nanvl(F.try_divide(F.col(c) - F.col("lo")[c], F.col("hi")[c] - F.col("lo")[c]), F.lit(0.0)), F.lit(0.0))
    # Binary digits read as octal ones leave room for those of the other coordinates.
    spread = [F.conv(F.bin(F.floor(share(c) * (2**BITS - 1)).cast("long")), 8, 10).cast("long") for c in "xyz"]
    order = [*block, "_code", *"xyz", "pid"]
    rows = rows.withColumn("_code", spread[0] * 4 + spread[1] * 2 + spread[2]).select(*order).repartitionByRange(*order).sortWithinPartitions(*order).drop("_code")
    leaf = max(LEAF, 4 * (k + 1))

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ends = np.zeros(len(table) - 1, dtype=bool)
        for c in block:
            col = table.column(c).combine_chunks()
            ends |= np.asarray(pc.not_equal(col[1:], col[:-1]))
        at = [0, *(np.flatnonzero(ends) + 1).tolist(), len(table)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield from _place(table.slice(a, b - a).combine_chunks(), k, leaf).to_batches()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK:
                yield from cut(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from cut(pa.Table.from_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), f"_leaf {kinds['pid']}", f"_chunk {kinds['pid']}", "_reach double", "_lead boolean"])
    return rows.mapInArrow(lambda batches: place(batches), schema)


def _found(rows: DataFrame, block: list[str], k: int) -> DataFrame:
    """block..., id1, id2, distance: for each point at least its k nearest, where a block has more than k points, all finite."""
    rows = materialize(_placed(rows, block, k), "placed")
    ends = lambda lo, hi: [F.struct(*(F.min(lo(c)).alias(c) for c in "xyz")).alias("lo"), F.struct(*(F.max(hi(c)).alias(c) for c in "xyz")).alias("hi")]
    leaves = materialize(rows.where("_lead").groupBy(*block, "_chunk", "_leaf").agg(*ends(F.col, F.col), F.max("_reach").alias("_reach")), "leaves")
    chunks = leaves.groupBy(*block, "_chunk").agg(*ends(lambda c: F.col("lo")[c], lambda c: F.col("hi")[c]))

    def gap(lo, hi, to: str) -> Column:
        return _length([F.greatest(F.col(f"lo_{to}")[c] - hi(c), lo(c) - F.col(f"hi_{to}")[c], F.lit(0.0)) for c in "xyz"]) * SLACK

    own = [lambda c: F.col("lo")[c], lambda c: F.col("hi")[c]]
    meet = leaves.join(chunks.select(*block, F.col("_chunk").alias("_other"), F.col("lo").alias("lo_c"), F.col("hi").alias("hi_c")), block).where(gap(*own, "c") <= F.col("_reach"))
    meet = meet.join(leaves.select(*block, F.col("_chunk").alias("_other"), F.col("_leaf").alias("_to"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")), [*block, "_other"])
    meet = meet.where(gap(*own, "b") <= F.col("_reach")).select(*block, "_leaf", "_to", "lo_b", "hi_b")
    asked = rows.join(meet, [*block, "_leaf"]).where(gap(F.col, F.col, "b") <= F.col("_reach"))
    asked = asked.select(*block, "_to", F.col("pid").alias("id1"), *(F.col(c).alias(f"{c}1") for c in "xyz"), "_reach")
    leads = rows.where("_lead").select(*block, F.col("_leaf").alias("_to"), F.col("pid").alias("id2"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    distance = _length([F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"])
    return asked.join(leads, [*block, "_to"]).where(F.col("id1") != F.col("id2")).where(distance <= F.col("_reach")).select(*block, "id1", "id2", distance.alias("distance"))


def _rest(rows: DataFrame, sizes: DataFrame, block: list[str], k: int) -> DataFrame:
    """As _found() for points without a finite place and for blocks of no more than k finite ones.

    The distance to a point without a finite place depends only on which of the coordinates are what, so the first ids of each kind serve.
    """
    c_kind = lambda c: F.when(F.col(c).isNull(), 4).when(F.isnan(c), 3).when(F.col(c) == float("inf"), 2).when(F.col(c) == -float("inf"), 1).otherwise(0)
    rows = rows.join(sizes.where(f"_n <= {k} OR _n < _all").select(*block, "_n"), block).withColumn("_kind", c_kind("x") * 25 + c_kind("y") * 5 + c_kind("z"))
    w = Window.partitionBy(*block, "_kind").orderBy("pid")
    few = rows.withColumn("_nth", F.dense_rank().over(w)).where(F.col("_nth") <= k + 1).select(*block, F.col("pid").alias("id2"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    asked = rows.where(f"_kind > 0 OR _n <= {k}").select(*block, F.col("pid").alias("id1"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    return asked.join(few, block).where(F.col("id1") != F.col("id2")).select(*block, "id1", "id2", _length([F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"]).alias("distance"))


def nearest(points: DataFrame, block: list[str], k: int, symmetric: bool = True) -> DataFrame:
    """block..., id1, id2, distance: each point's k nearest of its block (ties by id), as pairs id1 < id2.

    symmetric: a pair counts if either end has the other among its nearest; else only if the smaller id has.
    Distances that are infinite, not a number or unknown come last, in this order.
    """
    ship(points.sparkSession)
    rows = points.select(*block, "pid", *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna(subset=[*block, "pid"])
    finite = reduce(lambda a, b: a & b, (F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in "xyz"))
    ends = (F.struct(*(f(F.when(finite, F.col(c))).alias(c) for c in "xyz")).alias(n) for n, f in (("lo", F.min), ("hi", F.max)))
    sizes = materialize(rows.groupBy(*block).agg(F.count_if(finite).alias("_n"), F.count(F.lit(1)).alias("_all"), *ends), "blocks")
    found = _found(rows.where(finite).join(sizes.where(F.col("_n") > k), block), block, k)
    if not sizes.where(f"_n <= {k} OR _n < _all").isEmpty():
        found = found.union(_rest(rows, sizes, block, k))
    w = Window.partitionBy(*block, "id1").orderBy(F.asc_nulls_last("distance"), "id2")
    found = found.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= k)
    if not symmetric:
        return found.where("id1 < id2").select(*block, "id1", "id2", "distance")
    return found.select(*block, F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "distance").distinct()
