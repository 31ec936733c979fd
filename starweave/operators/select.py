"""Selections of catalogues: boxes, zones, sources, iterations, redshift ranges, cubes, and joins between products."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import base_label

#: Zones of the northern hemisphere in the early release. Fixed values.
NORTH = [3, 6, 7, 11, 12, 13, 14, 15, 18, 19]
#: Largest redshifts shown by default. Fixed values.
Z_CAPS = {"BGS": 0.45, "LRG": 1.0, "ELG": 1.4, "QSO": 2.2}
#: Boxes of the first release: right ascension and declination, low and high, by zone. Fixed values.
BOXES = {"NGC1": (110.0, 260.0, -10.0, 8.0), "NGC2": (180.0, 260.0, 30.0, 40.0)}
#: Least members of a group shown, by tracer. Fixed values.
MIN_MEMBERS = {"BGS": 8, "LRG": 12, "ELG": 8, "QSO": 6}


def in_box(ra_low: float, ra_high: float, dec_low: float, dec_high: float, z_low: float | None = None, z_high: float | None = None) -> Column:
    """Strictly inside; redshift limits count where given."""
    ra, dec, z = F.col("ra"), F.col("dec"), F.col("z")
    ok = (ra > ra_low) & (ra < ra_high) & (dec > dec_low) & (dec < dec_high)
    if z_low is not None:
        ok &= z > z_low
    if z_high is not None:
        ok &= z < z_high
    return ok


def ra_side(low: float = 90.0, high: float = 300.0, edges: bool = True) -> Column:
    ra = F.col("ra")
    inside = (ra >= low) & (ra <= high) if edges else (ra > low) & (ra < high)
    return F.when(inside, "NGC").otherwise("SGC")


def hemisphere(zone: Column) -> Column:
    return F.when(zone.isin(NORTH), "N").otherwise("S")


def regions(catalogue: DataFrame, cuts: dict[str, tuple] = BOXES) -> DataFrame:
    """The rows of each box, united, with the box's name as zone."""
    return reduce(DataFrame.unionByName, (catalogue.where(in_box(*c)).withColumn("region", F.lit(k)) for k, c in cuts.items()))


def cut_counts(catalogue: DataFrame, cuts: dict[str, tuple] = BOXES) -> DataFrame:
    """How many of each tracer lie in each box."""
    wide = catalogue.groupBy("tracer").agg(*(F.count_if(in_box(*c)).alias(k) for k, c in cuts.items()))
    return wide.unpivot(["tracer"], list(cuts), "region", "n")


def of_source(source: str) -> Column:
    """Rows of real data (randiter -1), of random points, or both."""
    if source not in ("data", "rand", "both"):
        raise ValueError("source must be data, rand or both")
    r = F.col("randiter")
    return {"data": r == -1, "rand": r != -1, "both": F.lit(True)}[source]


def of_iterations(iterations: list[int], source: str = "both") -> Column:
    """Rows of these iterations; those of real data too unless random points alone are asked for."""
    return F.col("randiter").isin(sorted({*iterations} | ({-1} if source != "rand" else set())))


def under_caps(catalogue: DataFrame, caps: dict[str, float] = Z_CAPS, default: float | None = None, most: float | None = None, slices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows within their tracer's redshift range: a slice if there is one, else up to its cap, else up to `most`, else the default."""
    for k, (low, high) in (slices or {}).items():
        if low == high:
            raise ValueError(f"the slice of {k} is empty")
    high = F.lit(default if default is not None else float("inf"))
    if most is not None:
        high = F.lit(most)
    low = F.lit(float("-inf"))
    first = F.substring_index("tracer", "_", 1)
    for k, v in caps.items():
        high = F.when(first == k, v).otherwise(high)
    for k, (a, b) in (slices or {}).items():
        high, low = F.when(first == k, max(a, b)).otherwise(high), F.when(first == k, min(a, b)).otherwise(low)
    return catalogue.where((F.col("z") >= low) & (F.col("z") <= high))


def slice_specs(specs: Iterable[str] | None) -> dict[str, tuple[float, float]]:
    """Redshift slices by tracer of texts TRACER:low:high; only the tracer's first token counts, and limits may be given either way round."""
    out = {}
    for spec in specs or []:
        if not spec.strip():
            continue
        tracer, *limits = (x.strip() for x in spec.split(":"))
        if len(limits) != 2 or not tracer:
            raise ValueError(f"{spec!r} is not TRACER:low:high")
        low, high = sorted(map(float, limits))
        if not math.isfinite(high - low) or math.isclose(low, high, rel_tol=1e-5, abs_tol=1e-8):
            raise ValueError(f"the limits of {spec!r} are not finite or leave no width")
        out[tracer.split("_")[0].upper()] = (low, high)
    return out


def picked(wanted: Iterable[str] | None, known: Iterable[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Tracers in the order asked for, each once, by name in any case or by alias in small letters; all where none is asked for."""
    known = list(known)
    if wanted is None:
        return known
    out = []
    for name in map(str.strip, wanted):
        found = next((x for x in (name, name.upper(), (aliases or {}).get(name.lower())) if x in known), None)
        if found is None:
            raise ValueError(f"unknown tracer {name}; known are {', '.join(known)}")
        out.append(found)
    return list(dict.fromkeys(out))


def enough_members(npts: Column, tracer: Column, least: int = 0, presets: dict[str, int] = MIN_MEMBERS) -> Column:
    """Groups large enough to be shown: of as many members as their tracer's preset and `least` ask for."""
    own = F.lit(0)
    for k, v in presets.items():
        own = F.when(F.substring_index(tracer, "_", 1) == k, v).otherwise(own)
    return npts >= F.greatest(own, F.lit(least))


def middle_slice(catalogue: DataFrame, low: float = 0.1, high: float = 0.9, narrow: float = 1e-3, least: float = 0.05) -> DataFrame:
    """Rows between two quantiles of their tracer's redshift; a narrow range is widened about its middle."""
    q = catalogue.groupBy("tracer").agg(F.percentile("z", F.array(F.lit(low), F.lit(high))).alias("q"))
    width = F.col("q")[1] - F.col("q")[0]
    middle, reach = (F.col("q")[0] + F.col("q")[1]) / 2, F.greatest(F.lit(least), width)
    low, high = F.when(width < narrow, middle - reach).otherwise(F.col("q")[0]), F.when(width < narrow, middle + reach).otherwise(F.col("q")[1])
    q = q.select("tracer", low.alias("z_low"), high.alias("z_high"))  # a row for each tracer
    return catalogue.join(q, "tracer").where("z >= z_low AND z <= z_high").drop("z_low", "z_high")


def cube(points: DataFrame, side: float, centre: tuple[float, float, float] | None = None) -> DataFrame:
    """Points within a closed cube about a centre (the medians where none is given), recentred."""
    if centre is None:
        mid = points.agg(*(F.median(c).alias(f"m{c}") for c in "xyz"))  # one row
    else:
        mid = points.sparkSession.createDataFrame([tuple(map(float, centre))], "mx double, my double, mz double")
    rows = points.crossJoin(F.broadcast(mid)).withColumns({c: F.col(c) - F.col(f"m{c}") for c in "xyz"}).drop("mx", "my", "mz")
    return rows.where(reduce(lambda a, b: a & b, (F.abs(F.col(c)) <= side / 2 for c in "xyz")))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def with_coordinates(classes: DataFrame, raw: DataFrame) -> DataFrame:
    """Class rows with the coordinates of their point, by id, iteration (-1 for data) and tracer without suffix; the first raw row of a key counts."""
    left = classes.withColumn("join_iter", F.when(F.col("isdata"), -1).otherwise(F.col("randiter"))).withColumn("join_label", base_label(F.col("tracertype")))
    right = raw.select("targetid", F.col("randiter").alias("join_iter"), base_label(F.col("tracertype")).alias("join_label"), "xcart", "ycart", "zcart")
    right = right.groupBy("targetid", "join_iter", "join_label").agg(F.min(F.struct("xcart", "ycart", "zcart")).alias("at")).select("targetid", "join_iter", "join_label", "at.*")
    return left.join(right, ["targetid", "join_iter", "join_label"]).drop("join_iter", "join_label")


def groups_on_raw(groups: DataFrame, raw: DataFrame, source: str = "both") -> DataFrame:
    """Members of stored groups with their raw row, by id, label and iteration, of real data, random points or both."""
    return groups.where(of_source(source)).join(raw.where(of_source(source)), ["targetid", "tracertype", "randiter"])


def groups_on_raw_by_iteration(groups: DataFrame, raw: DataFrame, iteration: int = 0, source: str = "both") -> DataFrame:
    """As groups_on_raw(), by id and iteration alone: members in `iteration` are found among real data too, unless random points alone are asked for."""
    at = F.col("randiter")
    if source != "rand":
        at = F.when(at == iteration, -1).otherwise(at)
    raw = raw.where(of_source(source)).withColumnRenamed("randiter", "join_iter")
    return groups.withColumn("join_iter", at).join(raw, ["targetid", "join_iter"])


def seen_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("targetid").distinct(), "targetid", "left_semi")
