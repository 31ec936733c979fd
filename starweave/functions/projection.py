"""Places in the views: wedges, sections, pizza slices. Angles in degrees; parameters are columns or numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wedge_cone(ra: Column, y: Column, centre, y_max, half_width, distance_max) -> tuple[Column, Column]:
    """x across a cone that opens with y, clipped to the half width, and y."""
    x = y / y_max * distance_max * F.radians(ra - centre)
    return F.greatest(-F.lit(half_width), F.least(F.lit(half_width), x)), y


def section_polar(ra: Column, r: Column, ra_low, ra_high, spread: float = 60.0, inner: float = 0.1, r_max=1.0) -> tuple[Column, Column]:
    """A section of a ring: right ascension spread over an angle about the vertical, r mapped linearly to [inner, 1]."""
    angle = F.radians(F.lit(90.0 + spread / 2) - (ra - ra_low) / (ra_high - ra_low) * spread)
    radius = F.lit(inner) + (1 - inner) * r / r_max
    return radius * F.cos(angle), radius * F.sin(angle)


def pizza_angle(ra: Column, ra_low: Column, ra_high: Column, sector: Column, sectors: Column) -> Column:
    """The angle of ra within sector k of n, which spans [k, k + 1] * 2 pi / n; the middle where the range is empty."""
    part = F.coalesce(F.try_divide(ra - ra_low, ra_high - ra_low), F.lit(0.5))
    return (sector + part) * (2 * math.pi) / sectors


def polar(ra: Column, dec: Column, r: Column) -> tuple[Column, Column]:
    """The flat view of old: shortened by the cosine of the declination."""
    return r * F.cos(F.radians(dec)) * F.cos(F.radians(ra)), r * F.cos(F.radians(dec)) * F.sin(F.radians(ra))
