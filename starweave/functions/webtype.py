"""From neighbour counts to structure classes, their probabilities and entropy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes in the order in which ties go. Fixed values.
TYPES = ("void", "sheet", "filament", "knot")
LOW, HIGH = -0.9, 0.9


def checked(low: float, high: float) -> tuple[float, float]:
    if not low < 0 < high:
        raise ValueError("thresholds must satisfy low < 0 < high")
    return low, high


def ratio(ndata: Column, nrand: Column, undefined: float | None = None) -> Column:
    """(ndata - nrand) / (ndata + nrand); null (or `undefined`) without neighbours."""
    r = F.try_divide((ndata - nrand).cast("double"), (ndata + nrand).cast("double"))
    return r if undefined is None else F.coalesce(r, F.lit(undefined))


def classify(r: Column, low: float = LOW, high: float = HIGH, closed: str = "left") -> Column:
    """The class of r; bins hold their left ends, or right ones. Null for null."""
    checked(low, high)
    if closed == "left":
        return F.when(r < low, "void").when(r < 0, "sheet").when(r < high, "filament").when(r.isNotNull(), "knot")
    return F.when(r <= low, "void").when(r <= 0, "sheet").when(r <= high, "filament").when(r.isNotNull(), "knot")


def probabilities(df: DataFrame, keys: list[str], webtype: str = "webtype") -> DataFrame:
    """For each key, how often each class occurs among its rows that have one; 0 throughout if none has."""
    total = F.count(webtype)
    return df.groupBy(*keys).agg(*(F.coalesce(F.try_divide(F.sum(F.when(F.col(webtype) == t, 1.0).otherwise(0.0)), total), F.lit(0.0)).alias(f"p{t}") for t in TYPES))


def one_hot(webtype: Column) -> list[Column]:
    return [F.coalesce((webtype == t).cast("double"), F.lit(0.0)).alias(f"p{t}") for t in TYPES]


def most_probable(parts: list[Column]) -> Column:
    """The class of the largest probability, the first of equals; '' if all are null."""
    best = F.greatest(*parts)
    pick = F.when(best.isNull(), "")
    for t, p in zip(TYPES, parts, strict=True):
        pick = pick.when(p == best, t)
    return pick


def entropy(parts: list[Column]) -> Column:
    """Shannon's, over its maximum."""
    return -reduce(lambda a, b: a + b, (F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in parts)) / F.log2(F.lit(float(len(parts))))
