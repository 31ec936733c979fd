"""Distributions: cumulative curves, histograms, bands over zones, density grids, principal axes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys..., value, below: the share of values up to each distinct value."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return n.select(*keys, value, (F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w)).alias("below"))


def ecdf_on_grid(df: DataFrame, keys: list[str], value: str, low: float, high: float, points: int) -> DataFrame:
    """keys..., k, x, below: the curve at evenly spaced x. Values are counted by the grid's step first, so rows do not multiply."""
    width = (high - low) / (points - 1)
    step = F.greatest(F.lit(0), F.ceil((F.col(value) - low) / width)).cast("int")
    # The first step whose x reaches the value, as the x are computed; rounding may put it one off.
    x_of = lambda k: F.lit(low) + k * F.lit(width)
    step = F.when(x_of(step) < F.col(value), step + 1).when((step > 0) & (x_of(step - 1) >= F.col(value)), step - 1).otherwise(step)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, step.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    grid = total.select(*keys, "total", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    rows = grid.join(n, [*keys, "k"], "left")
    w = Window.partitionBy(*keys).orderBy("k")
    return rows.select(*keys, "k", x_of(F.col("k")).alias("x"), (F.sum(F.coalesce("n", F.lit(0))).over(w) / F.col("total")).alias("below"))


def bands(curves: DataFrame, keys: list[str], value: str) -> DataFrame:
    """16th, 50th and 84th percentiles across zones of a curve's value at each place."""
    q = F.percentile(value, F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)))
    return curves.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("p16"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p84"))


def nth_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """From 0: whole widths from `low` to the value, which width_bucket would round otherwise at the ends of bins."""
    return F.least(F.floor((value - F.lit(float(low))) / F.lit((high - low) / bins)), F.lit(bins - 1))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys..., bin (from 0), n: even bins, the last of which holds its right end; values outside are left out."""
    rows = df.where((F.col(value) >= low) & (F.col(value) <= high))
    return rows.groupBy(*keys, nth_bin(F.col(value), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys..., bin, density: counts over the total of all values, those outside too, and the width."""
    total = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rows = histogram(df, keys, value, low, high, bins)
    return rows.join(total, keys).select(*keys, "bin", (F.col("n") / (F.col("total") * ((high - low) / bins))).alias("density"))


def grid_counts(points: DataFrame, side: float, cells: int) -> DataFrame:
    """ix, iy, iz, n of points in a cube about the origin; empty cells have no row."""
    rows = points.where(" AND ".join(f"abs({c}) <= {side / 2}D" for c in "xyz"))
    of = lambda c: nth_bin(F.col(c), -side / 2, side / 2, cells).cast("int").alias(f"i{c}")
    return rows.groupBy(of("x"), of("y"), of("z")).agg(F.count(F.lit(1)).alias("n"))


def kernel(sigma: float, cut: float = 4.0) -> list[tuple[int, float]]:
    reach = int(cut * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [(k, v / sum(w)) for k, v in zip(range(-reach, reach + 1), w, strict=True)]


def smoothed(grid: DataFrame, cells: int, sigma: float = 1.2) -> DataFrame:
    """Gaussian smoothing of a sparse grid, axis by axis, with nothing beyond its border."""
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in kernel(sigma)))
    out = grid.withColumn("n", F.col("n").cast("double"))
    for c in ("ix", "iy", "iz"):
        rest = [d for d in ("ix", "iy", "iz") if d != c]
        wide = out.select(*rest, "n", F.col(c).alias("at"), F.explode(taps).alias("t")).select(*rest, (F.col("at") + F.col("t.k")).alias(c), (F.col("n") * F.col("t.v")).alias("n"))
        out = wide.where(f"{c} >= 0 AND {c} < {cells}").groupBy("ix", "iy", "iz").agg(F.sum("n").alias("n"))
    return out


def covariance(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Of columns, from one row of sums."""
    row = df.agg(*(F.covar_samp(a, b).alias(f"{a}_{b}") for a in cols for b in cols)).first()
    return np.array([[row[f"{a}_{b}"] for b in cols] for a in cols], dtype=float)


def principal_axes(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with pc1, pc2, ... : coordinates along the axes of largest variance; an axis points where its largest component is positive."""
    values, vectors = np.linalg.eigh(covariance(df, cols))
    vectors = vectors[:, np.argsort(-values)]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    mean = df.agg(*(F.avg(c).alias(c) for c in cols)).first()
    for k in range(len(cols)):
        df = df.withColumn(f"pc{k + 1}", sum((F.col(c) - float(mean[c])) * float(vectors[i, k]) for i, c in enumerate(cols)))
    return df

