"""Releases: which files hold which catalogue, and how a zone is cut out of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cosmology import cartesian, comoving_distance
from ..operators.sampling import draw, rotation_table
from ..operators.select import BOXES, hemisphere, in_box, ra_side
from .fits import read_fits


@dataclass(frozen=True)
class Release:
    """Tracers, files per tracer, zones and how rows come to a zone; `by_file`: an iteration draws from one file."""

    name: str
    tracers: tuple[str, ...]
    zones: tuple[str, ...]
    halves: tuple[str, ...] = ("N", "S")
    random_files: int = 18
    columns: dict[str, str] = field(default_factory=lambda: {"TARGETID": "bigint", "RA": "double", "DEC": "double", "Z": "double"})
    by_file: bool = False
    boxes: dict[str, tuple] | None = None

    def paths(self, base: str, tracer: str, random_file: int | None = None) -> list[str]:
        end = "clustering.dat.fits" if random_file is None else f"{random_file}_clustering.ran.fits"
        return [f"{base}/{tracer}_{h + '_' if h else ''}{end}" for h in self.halves]

    def zone(self, df: DataFrame) -> DataFrame:
        """Rows with their zone; rows of no zone are left out."""
        if self.name == "early":
            return df.withColumn("zone", F.col("rosette_number").cast("string")).where(F.col("hemisphere") == hemisphere(F.col("rosette_number")))
        if self.boxes:
            return reduce(DataFrame.unionByName, (df.where(in_box(*cut)).withColumn("zone", F.lit(k)) for k, cut in self.boxes.items()))
        return df.withColumn("zone", ra_side())


#: The releases' tracers and zones. Fixed values.
EARLY = Release("early", ("BGS_ANY", "ELG", "LRG", "QSO"), tuple(f"{k:02d}" for k in range(20)), columns={"TARGETID": "bigint", "ROSETTE_NUMBER": "int", "RA": "double", "DEC": "double", "Z": "double"}, by_file=True)
FIRST = Release("first", ("BGS_BRIGHT", "ELG_LOPnotqso", "LRG", "QSO"), tuple(BOXES), boxes=BOXES)
SECOND = Release("second", ("BGS_BRIGHT", "ELG_LOPnotqso", "LRG", "QSO"), ("NGC", "SGC"), halves=("",))


def zones_of(release: Release, wanted: str | list[str] | None = None) -> list[str]:
    """The zones asked for, by names split by commas or blanks.

    Numbered zones come in order; `all` or nothing means all of them. The boxes of the first release are shown one at a time.
    """
    names = (wanted if isinstance(wanted, str) else " ".join(map(str, wanted or []))).replace(",", " ").upper().split()
    if release.boxes:
        if len(names) != 1 or names[0] not in release.zones:
            raise ValueError(f"one zone of {', '.join(release.zones)} is wanted")
        return names
    if not names or "ALL" in names:
        return list(release.zones)
    numbered = all(z.isdigit() for z in release.zones)
    found = [f"{int(n):02d}" if numbered and n.isdigit() else n for n in names]
    if unknown := [n for n in found if n not in release.zones]:
        raise ValueError(f"unknown zones {', '.join(unknown)}; known are {', '.join(release.zones)}")
    return sorted(set(found)) if numbered else list(dict.fromkeys(found))


def narrowed(df: DataFrame, zone: int | None = None, tracer_ids: dict[str, int] | None = None, floats: tuple[str, ...] = ("ra", "dec", "z", "xcart", "ycart", "zcart")) -> DataFrame:
    """Rows as the second release stores them: single precision, short iterations, the zone's number where there is none, and the tracer's number."""
    df = df.withColumns({c: F.col(c).cast("float") for c in floats if c in df.columns})
    if "randiter" in df.columns:
        df = df.withColumn("randiter", F.col("randiter").cast("short"))
    if zone is not None and "zone" not in df.columns:
        df = df.withColumn("zone", F.lit(zone))
    if tracer_ids:
        known = F.create_map(*(F.lit(x) for kv in tracer_ids.items() for x in kv))
        df = df.withColumn("tracer_id", F.coalesce(known[F.col("tracer")], F.lit(255)).cast("short"))
    return df


def cuts_from_json(text: str, known: dict[str, tuple] = BOXES) -> dict[str, tuple]:
    """Boxes of a configuration replace those of the same zone; unknown zones are an error."""
    cuts = dict(known)
    for zone, c in json.loads(text).items():
        if zone not in known:
            raise ValueError(f"unknown zone {zone}")
        cuts[zone] = tuple(float(c[k]) if k in c else None for k in ("RA_min", "RA_max", "DEC_min", "DEC_max", "Z_min", "Z_max"))
    return cuts


def catalogues(spark: SparkSession, release: Release, base: str, randoms: bool) -> DataFrame:
    """Real or random rows of all tracers, halves and files: tracer, hemisphere, file_idx and the release's columns."""
    frames = []
    for t in release.tracers:
        for k in range(release.random_files) if randoms else [None]:
            df = read_fits(spark, release.paths(base, t, k), release.columns)
            half = F.regexp_extract("file", r"_([NS])_[^/]*$", 1)
            frames.append(df.select(F.lit(t).alias("tracer"), half.alias("hemisphere"), F.lit(k).cast("int").alias("file_idx"), *(F.col(c).alias(c.lower()) for c in release.columns)))
    return reduce(DataFrame.unionByName, frames)


def placed(df: DataFrame) -> DataFrame:
    return df.withColumn("_d", comoving_distance(F.col("z"))).select("*", *cartesian(F.col("ra"), F.col("dec"), F.col("_d"))).drop("_d")


def raw_rows(spark: SparkSession, real: DataFrame, pool: DataFrame, iterations: int, files: int = 18, by_file: bool = False, label: Column | None = None) -> DataFrame:
    """Data rows (randiter -1) and as many random rows for each iteration, of every zone and tracer; tracers without data in a zone have none."""
    sizes = real.groupBy("zone", "tracer").agg(F.count(F.lit(1)).alias("n_real"))
    plan = rotation_table(spark, files, iterations)
    name = F.col("tracer") if label is None else label
    data = placed(real).withColumns({"randiter": F.lit(-1), "tracertype": F.concat(name, F.lit("_DATA"))})
    rand = placed(draw(pool, plan, sizes, ["zone", "tracer"], by_file)).withColumn("tracertype", F.concat(name, F.lit("_RAND")))
    keep = ["zone", "tracer", "targetid", "ra", "dec", "z", "xcart", "ycart", "zcart", "tracertype", "randiter"]
    return data.select(keep).unionByName(rand.select(keep))
