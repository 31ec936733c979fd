"""Friends-of-friends groups: linking lengths, membership, sizes, centres, inertia ellipsoids, and views of groups."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import delaunay
from .components import connected
from .graph import radius_pairs, spread_blocks

#: The smallest linking length: the spacing of single precision at 1. Fixed value.
LEAST = 1.1920929e-07
#: Points of a block whose corners are looked for in one task; the hull is taken from the corners of all parts.
PART_POINTS = 50_000
#: Fixed linking lengths of the first version, by tracer (Mpc). Fixed values.
FIXED = {"BGS": 20.0, "ELG": 20.0, "LRG": 20.0, "QSO": 70.0}


def linking_lengths(points: DataFrame, block: list[str], part: int = PART_POINTS) -> DataFrame:
    """block..., n, linklen: the cube root of hull volume over number; the bounding box's diagonal where there is no hull.

    The hull is that of all points: a block is dealt to parts of about so many points, and only points that may be
    corners of their part's hull can be corners of the block's.
    """
    ship(points.sparkSession)
    box = points.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.sqrt(sum((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in "xyz")).alias("diagonal"))
    parts = box.select(*block, F.ceil(F.col("n") / part).alias("_parts"))
    dealt = points.select(*block, "pid", *"xyz").join(parts, block).withColumn("_part", F.pmod(F.xxhash64("pid"), F.col("_parts")))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in block)

    def places(table: pa.Table) -> np.ndarray:
        return np.unique(np.stack([np.asarray(table.column(c).combine_chunks()).astype(float) for c in "xyz"], 1), axis=0)

    def corners(table: pa.Table) -> pa.Table:
        at = delaunay.rim(places(table))
        return pa.table({**{c: pa.array([table.column(c)[0].as_py()] * len(at), type=table.schema.field(c).type) for c in block}, **{c: at[:, k] for k, c in enumerate("xyz")}})

    def hull(table: pa.Table) -> pa.Table:
        at = places(table)
        try:
            v = _four(at) if len(at) == 4 else delaunay.volume(at)
        except delaunay.DegenerateError:
            v = 0.0
        return pa.table({**{c: table.column(c).slice(0, 1) for c in block}, "volume": pa.array([v])})

    rims = spread_blocks(dealt.select(*block, "_part", *"xyz"), [*block, "_part"]).groupBy(*block, "_part").applyInArrow(lambda t: corners(t), f"{keys}, x double, y double, z double")
    volumes = spread_blocks(rims, block).groupBy(*block).applyInArrow(lambda t: hull(t), f"{keys}, volume double")
    length = F.when(F.col("n") <= 1, LEAST).when(F.col("volume") > 0, F.cbrt(F.col("volume") / F.col("n"))).otherwise(F.greatest("diagonal", F.lit(LEAST)))
    return box.join(volumes, block).select(*block, "n", length.alias("linklen"))


def _four(at: np.ndarray) -> float:
    return float(abs(np.linalg.det(at[1:] - at[0])) / 6)


def friends(points: DataFrame, block: list[str], eps: float) -> DataFrame:
    """points with `first` (the smallest pid of the group) and groupid (dense from 0 within the block). pid is unique in all blocks."""
    # Points of a cell whose box is no longer than eps across are all linked: the smallest stands for them, and one link for all between two cells.
    cell = {f"_c{c}": F.floor(F.col(c) / (eps / math.sqrt(3) * (1 - 1e-9))) for c in "xyz"}
    across = F.sqrt(reduce(lambda a, b: a + b, ((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in "xyz")))
    rows = points.withColumns(cell)
    cells = rows.groupBy(*block, *cell).agg(F.min("pid").alias("_least"), across.alias("_across"))
    rows = rows.join(cells, [*block, *cell]).withColumn("_home", F.when(F.col("_across") <= eps, F.col("_least")).otherwise(F.col("pid"))).drop(*cell, "_least", "_across")
    links = radius_pairs(rows.select(*block, F.col("_home").alias("pid"), *"xyz"), block, eps)
    part = connected(links.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    rows = rows.join(part.withColumnRenamed("node", "_home"), "_home", "left").withColumn("first", F.coalesce("component", "_home")).select(*points.columns, "first")
    return rows.withColumn("groupid", F.dense_rank().over(Window.partitionBy(*block).orderBy("first")) - 1)


def fixed_lengths(points: DataFrame, block: list[str], lengths: dict[str, float] = FIXED) -> DataFrame:
    """block..., linklen of the first version, by the tracer's first token; tracers without one are left out."""
    name = F.substring_index(F.col("tracer").cast("string"), "_", 1)
    own = F.create_map(*(F.lit(x) for kv in lengths.items() for x in kv))[name]
    return points.select(*block).distinct().withColumn("linklen", own).where("linklen IS NOT NULL")


#: Directions in which diameters() looks for a first pair.
WAYS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]


def diameters(points: DataFrame, block: list[str], side: int = 8) -> DataFrame:
    """block..., diameter: the largest distance of two points, 0 for a single one.

    The extremes in a few directions give a distance that some pair has. Only cells of a grid whose boxes
    reach that far apart are joined, and of their points only those that do, so the inside of a cloud meets nothing.
    """
    key = [F.col(c).alias(c) for c in block]
    at = F.struct(*"xyz")
    along = [sum(w * F.col(c) for w, c in zip(way, "xyz", strict=True)) for way in WAYS]
    apart = lambda p, q: F.sqrt(sum((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz"))
    ends = points.groupBy(*key).agg(F.struct(*(F.min(c).alias(c) for c in "xyz")).alias("lo"), F.struct(*(F.max(c).alias(c) for c in "xyz")).alias("hi"), *(f(at, d).alias(f"e{k}{n}") for k, d in enumerate(along) for n, f in enumerate((F.min_by, F.max_by))))
    ends = ends.select(*block, "lo", "hi", F.greatest(*(apart(F.col(f"e{k}0"), F.col(f"e{k}1")) for k in range(len(WAYS)))).alias("found"))  # a row for each block
    index = sum(F.coalesce(F.least(F.lit(side - 1), F.floor(F.try_divide(F.col(c) - F.col("lo")[c], F.col("hi")[c] - F.col("lo")[c]) * side)), F.lit(0)) * side**k for k, c in enumerate("xyz"))
    rows = points.select(*block, *"xyz").join(ends, block).select(*block, at.alias("at"), "found", index.cast("int").alias("cell"))
    cells = rows.groupBy(*block, "cell").agg(*(f(F.col("at")[c]).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    one, two = (cells.select(*block, F.col("cell").alias(f"cell_{k}"), F.struct(*(F.col(f"{n}{c}") for c in "xyz" for n in ("lo", "hi"))).alias(f"box_{k}")) for k in "ab")
    reach = lambda lo, hi: sum(F.pow(F.greatest(F.abs(h(c)), F.abs(g(c))), 2) for c in "xyz" for h, g in ((lo, hi),))
    enough = F.col("found") * F.col("found") * (1 - 1e-12)
    boxes = reach(lambda c: F.col("box_b")[f"hi{c}"] - F.col("box_a")[f"lo{c}"], lambda c: F.col("box_a")[f"hi{c}"] - F.col("box_b")[f"lo{c}"])
    meet = one.join(two, block).where("cell_a <= cell_b").join(ends.select(*block, "found"), block).where(boxes >= enough).drop("found")
    sides = []
    for k, other in (("a", "b"), ("b", "a")):
        box = F.col(f"box_{other}")
        near = rows.withColumnRenamed("cell", f"cell_{k}").join(meet, [*block, f"cell_{k}"])
        far = reach(lambda c, box=box: box[f"hi{c}"] - F.col("at")[c], lambda c, box=box: F.col("at")[c] - box[f"lo{c}"])
        sides.append(near.where(far >= enough).select(*block, "cell_a", "cell_b", F.col("at").alias(f"at_{k}")))
    best = sides[0].join(sides[1], [*block, "cell_a", "cell_b"]).groupBy(*block).agg(F.max(apart(F.col("at_a"), F.col("at_b"))).alias("best"))
    return ends.join(best, block, "left").select(*block, F.greatest("found", F.coalesce("best", F.lit(0.0))).alias("diameter"))


def friends_each(points: DataFrame, block: list[str], lengths: DataFrame) -> DataFrame:
    """As friends(), with each block's own linking length; lengths(block..., linklen).

    Coordinates are scaled by the length, so one pass with unit cells serves all blocks.
    """
    scaled = points.join(lengths.select(*block, "linklen"), block).withColumns({f"raw_{c}": F.col(c) for c in "xyz"})
    scaled = scaled.withColumns({c: F.col(c) / F.col("linklen") for c in "xyz"})
    found = friends(scaled, block, 1.0)
    return found.withColumns({c: F.col(f"raw_{c}") for c in "xyz"}).drop("raw_x", "raw_y", "raw_z")


def axes(ixx: Column, iyy: Column, izz: Column, ixy: Column, ixz: Column, iyz: Column) -> list[Column]:
    """Square roots of the eigenvalues of a symmetric 3x3 tensor, largest first, negative ones taken as 0."""
    q = (ixx + iyy + izz) / 3
    off = ixy * ixy + ixz * ixz + iyz * iyz
    spread = (ixx - q) * (ixx - q) + (iyy - q) * (iyy - q) + (izz - q) * (izz - q) + 2 * off
    p = F.sqrt(spread / 6)
    a, b, c = ixx - q, iyy - q, izz - q
    det = a * (b * c - iyz * iyz) - ixy * (ixy * c - iyz * ixz) + ixz * (ixy * iyz - b * ixz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det / 2, p * p * p), F.lit(0.0))))
    angle = F.acos(r) / 3
    high = q + 2 * p * F.cos(angle)
    low = q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return [F.sqrt(F.greatest(F.lit(0.0), v)) for v in (high, 3 * q - high - low, low)]


def ellipsoids(members: DataFrame, keys: list[str], normalized: bool = False, least: int = 1) -> DataFrame:
    """keys..., npts, xcm, ycm, zcm, a >= b >= c of each group: the roots of the summed inertia tensor's eigenvalues (of the mean one if normalized); NULL axes below `least` members (2 in the first version)."""
    mid = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("npts"), *(F.avg(c).alias(f"{c}cm") for c in "xyz"))
    near = members.select(*keys, *"xyz").join(mid, keys).select(*keys, *((F.col(c) - F.col(f"{c}cm")).alias(c) for c in "xyz"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    t = near.groupBy(*keys).agg(F.sum(y * y + z * z).alias("ixx"), F.sum(x * x + z * z).alias("iyy"), F.sum(x * x + y * y).alias("izz"), (-F.sum(x * y)).alias("ixy"), (-F.sum(x * z)).alias("ixz"), (-F.sum(y * z)).alias("iyz"))
    out = mid.join(t, keys)
    scale = F.sqrt(F.col("npts")) if normalized else F.lit(1.0)
    a, b, c = (F.when(F.col("npts") >= least, v) for v in axes(*(F.col(n) for n in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz"))))
    return out.select(*keys, "npts", "xcm", "ycm", "zcm", (a / scale).alias("a"), (b / scale).alias("b"), (c / scale).alias("c"))


def catalogue(members: DataFrame, block: list[str], normalized: bool = False) -> DataFrame:
    """Member rows with their group's statistics."""
    return members.join(ellipsoids(members, [*block, "groupid"], normalized), [*block, "groupid"])


def centres(members: DataFrame, keys: list[str]) -> DataFrame:
    """Median right ascension and redshift, and size, of each group."""
    return members.groupBy(*keys).agg(F.median("ra").alias("ra"), F.median("z").alias("z"), F.count(F.lit(1)).alias("npts"))


def largest(groups: DataFrame, block: list[str], n: int) -> DataFrame:
    """The n groups of each block with the most members, ties by id."""
    w = Window.partitionBy(*block).orderBy(F.desc("npts"), "groupid")
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def extents(members: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """How long each group is in a projection."""
    return members.groupBy(*keys).agg(F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("extent"), F.count(F.lit(1)).alias("npts"))


def longest(members: DataFrame, block: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*block).orderBy(F.desc("extent"), "groupid")
    return extents(members, [*block, "groupid"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def polylines(members: DataFrame, block: list[str], least: int) -> DataFrame:
    """Members of groups of at least so many points, numbered along y."""
    w = Window.partitionBy(*block, "groupid")
    rows = members.withColumn("npts", F.count(F.lit(1)).over(w)).where(F.col("npts") >= least)
    return rows.withColumn("step", F.row_number().over(w.orderBy("y", "pid")))


def colours(groups: DataFrame, block: list[str], n: int) -> DataFrame:
    """A palette index for each group."""
    return groups.withColumn("colour", (F.dense_rank().over(Window.partitionBy(*block).orderBy("groupid")) - 1) % n)
