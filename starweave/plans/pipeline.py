"""From raw points to pairs, classes, probabilities and groups, for all zones in one plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.webtype import HIGH, LOW, classify, most_probable, one_hot, probabilities, ratio
from ..operators.graph import delaunay_edges, neighbour_counts
from ..operators.groups import catalogue, friends_each, linking_lengths
from ..storage import materialize

BLOCK = ["zone", "tracer", "randiter"]


@dataclass
class Products:
    raw: DataFrame
    pairs: DataFrame
    classification: DataFrame
    probability: DataFrame
    groups: DataFrame


def iterated(raw: DataFrame) -> DataFrame:
    """Every data row in every iteration that its zone and tracer have, beside the random rows."""
    rand = raw.where("randiter <> -1")
    plan = rand.select("zone", "tracer", "randiter").distinct()
    data = raw.where("randiter = -1").drop("randiter").join(plan, ["zone", "tracer"])
    rows = data.withColumn("isdata", F.lit(True)).unionByName(rand.withColumn("isdata", F.lit(False)))
    # Ids of data and random rows may be equal; a row is known by both.
    pid = F.col("targetid") * 2 + F.col("isdata").cast("long")
    return rows.withColumns({"pid": pid, "x": F.col("xcart"), "y": F.col("ycart"), "z3": F.col("zcart")})


def pairs_of(raw: DataFrame) -> DataFrame:
    points = iterated(raw).select(*BLOCK, "pid", "x", "y", F.col("z3").alias("z"))
    return delaunay_edges(points, BLOCK)


def classes_of(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    points = iterated(raw).select(*BLOCK, "targetid", "pid", "isdata", "xcart", "ycart", "zcart")
    return neighbour_counts(points, pairs, BLOCK)


def probabilities_of(classes: DataFrame, low: float = LOW, high: float = HIGH, undefined: str = "drop") -> DataFrame:
    """Data rows: class frequencies over iterations; random rows: their own class. undefined='filament' takes points without neighbours as r = 0."""
    r = ratio(F.col("ndata"), F.col("nrand"), 0.0 if undefined == "filament" else None)
    rows = classes.withColumn("webtype", classify(r, low, high))
    data = probabilities(rows.where("isdata"), ["zone", "tracer", "targetid"]).withColumns({"randiter": F.lit(-1), "isdata": F.lit(True)})
    rand = rows.where("NOT isdata").select("zone", "tracer", "targetid", *one_hot(F.col("webtype")), "randiter", "isdata")
    return data.unionByName(rand).withColumn("most", most_probable([F.col(f"p{t}") for t in ("void", "sheet", "filament", "knot")]))


def groups_of(classes: DataFrame, webtype: str, source: str = "rand", low: float = LOW, high: float = HIGH, multiplicity: bool = False) -> DataFrame:
    """Members and statistics of friends-of-friends groups of one class, in every zone, tracer and iteration.

    Data rows belong to iteration -1: once, or (multiplicity) once for each iteration in which they match.
    """
    rows = classes.withColumn("webtype", classify(ratio(F.col("ndata"), F.col("nrand")), low, high)).where(F.col("webtype") == webtype)
    rows = rows.where({"data": "isdata", "rand": "NOT isdata", "both": "true"}[source])
    rows = rows.withColumn("iteration", F.when(F.col("isdata"), -1).otherwise(F.col("randiter")))
    if not multiplicity:
        rows = rows.dropDuplicates(["zone", "tracer", "iteration", "pid"])
    rows = rows.select("zone", "tracer", F.col("iteration").alias("randiter"), "targetid", "isdata", F.col("xcart").alias("x"), F.col("ycart").alias("y"), F.col("zcart").alias("z"))
    rows = materialize(rows.withColumn("pid", F.monotonically_increasing_id()), "members")
    lengths = linking_lengths(rows, BLOCK)
    found = friends_each(rows, BLOCK, lengths)
    return catalogue(found, BLOCK).withColumn("webtype", F.lit(webtype))


def run(raw: DataFrame, webtype: str = "void", source: str = "rand", low: float = LOW, high: float = HIGH) -> Products:
    raw = materialize(raw, "raw")
    pairs = materialize(pairs_of(raw), "pairs")
    classes = materialize(classes_of(raw, pairs), "classes")
    return Products(raw, pairs, classes, probabilities_of(classes, low, high), groups_of(classes, webtype, source, low, high))
