"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can.

Floating-point results are rounded where sums or transcendental functions may differ in the last digits.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import labels as lab
from ..functions import projection as proj
from ..functions.cosmology import cartesian, comoving_distance, comoving_sql
from ..functions.webtype import TYPES, classify, entropy, most_probable, one_hot, probabilities, ratio
from ..operators import graph, groups, sampling, select, stats
from ..sources import products, releases
from . import fixtures as fx
from . import pipeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def typed(spark, d):
    df = fx.counts(spark, d).withColumn("r", ratio(F.col("ndata"), F.col("nrand")))
    return df.withColumn("webtype", classify(F.col("r")))


P = [f"p{t}" for t in TYPES]


def probs(spark, d):
    return probabilities(typed(spark, d), ["targetid"])


# Classes and probabilities


@query(f"WITH {fx.TYPED} SELECT targetid, randiter, r, webtype FROM typed")
def ratio_classify(spark, d):
    return typed(spark, d).select("targetid", "randiter", "r", "webtype")


@query(f"WITH {fx.COUNTS}, x AS (SELECT *, {fx.R} AS r FROM counts) SELECT targetid, randiter, CASE WHEN r <= -0.9 THEN 'void' WHEN r <= 0 THEN 'sheet' WHEN r <= 0.9 THEN 'filament' WHEN r IS NOT NULL THEN 'knot' END AS webtype FROM x")
def ratio_classify_right_closed(spark, d):
    df = fx.counts(spark, d)
    return df.select("targetid", "randiter", classify(ratio(F.col("ndata"), F.col("nrand")), closed="right").alias("webtype"))


@query(f"WITH {fx.PROBS} SELECT * FROM probs")
def web_probabilities(spark, d):
    return probs(spark, d)


@query(f"WITH {fx.TYPED} SELECT targetid, randiter, " + ", ".join(f"coalesce((webtype = '{t}')::INT::DOUBLE, 0) AS p{t}" for t in TYPES) + " FROM typed")
def random_one_hot(spark, d):
    return typed(spark, d).select("targetid", "randiter", *one_hot(F.col("webtype")))


ARGMAX = "CASE greatest(pvoid, psheet, pfilament, pknot) WHEN pvoid THEN 'void' WHEN psheet THEN 'sheet' WHEN pfilament THEN 'filament' WHEN pknot THEN 'knot' END"


@query(f"WITH {fx.PROBS} SELECT targetid, {ARGMAX} AS webtype FROM probs")
def argmax_webtype(spark, d):
    return probs(spark, d).select("targetid", most_probable([F.col(p) for p in P]).alias("webtype"))


ENTROPY = "round(-(" + " + ".join(f"CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0 END" for p in P) + ") / 2, 9) + 0.0"


@query(f"WITH {fx.PROBS} SELECT targetid, {ENTROPY} AS h FROM probs")
def prob_entropy(spark, d):
    return rounded(probs(spark, d).select("targetid", entropy([F.col(p) for p in P]).alias("h")), 9, "h")


@query(f"WITH {fx.TYPED} SELECT coalesce(webtype, '') AS webtype, count(*) AS n FROM typed GROUP BY 1")
def webtype_counts(spark, d):
    return typed(spark, d).groupBy(F.coalesce("webtype", F.lit("")).alias("webtype")).agg(F.count(F.lit(1)).alias("n"))


# Entropy, cumulative curves, histograms

ZONE_PROBS = f"{fx.TYPED}, {fx.ZONED}, zp AS (SELECT zone, targetid, " + ", ".join(f"sum(CASE WHEN webtype = '{t}' THEN 1.0::DOUBLE ELSE 0 END) / nullif(count(webtype), 0) AS p{t}" for t in TYPES) + f" FROM zoned GROUP BY ALL), zh AS (SELECT zone, targetid, {ENTROPY} AS h FROM zp)"
DENSITY = "hd AS (SELECT zone, bin, count(*) / (any_value(total) * (0.6::DOUBLE / 30)) AS density FROM (SELECT zone, h, least(floor(h / (0.6::DOUBLE / 30))::INT, 29) AS bin, count(*) OVER (PARTITION BY zone) AS total FROM zh) WHERE h >= 0 AND h <= 0.6 GROUP BY ALL)"


def zone_entropy(spark, d):
    p = probabilities(fx.zoned(spark, d, typed(spark, d)), ["zone", "targetid"])
    return rounded(p.select("zone", "targetid", entropy([F.col(c) for c in P]).alias("h")), 9, "h")


@query(f"WITH {ZONE_PROBS}, {DENSITY} SELECT zone, bin, round(density, 9) AS density FROM hd")
def entropy_pdf(spark, d):
    return rounded(stats.density(zone_entropy(spark, d), ["zone"], "h", 0.0, 0.6, 30), 9, "density")


@query(f"WITH {ZONE_PROBS}, {DENSITY} SELECT bin, round(quantile_cont(density, 0.16), 9) AS p16, round(quantile_cont(density, 0.5), 9) AS p50, round(quantile_cont(density, 0.84), 9) AS p84 FROM hd GROUP BY bin")
def entropy_pdf_bands(spark, d):
    pdf = stats.density(zone_entropy(spark, d), ["zone"], "h", 0.0, 0.6, 30)
    return rounded(stats.bands(pdf, ["bin"], "density"), 9, "p16", "p50", "p84")


@query(f"WITH {fx.TYPED}, {fx.ZONED} SELECT DISTINCT zone, r, round(cume_dist() OVER (PARTITION BY zone ORDER BY r), 9) AS below FROM zoned WHERE r IS NOT NULL")
def ecdf_exact(spark, d):
    return rounded(stats.ecdf(fx.zoned(spark, d, typed(spark, d)), ["zone"], "r"), 9, "below")


GRID = f"{fx.TYPED}, {fx.ZONED}, grid AS (SELECT k::INT AS k, -1.0::DOUBLE + k * 0.05::DOUBLE AS x FROM range(41) t(k)), curve AS (SELECT zone, k, x, count(*) FILTER (r <= x) / count(*)::DOUBLE AS below FROM zoned, grid WHERE r IS NOT NULL GROUP BY ALL)"


@query(f"WITH {GRID} SELECT zone, k, x, round(below, 9) AS below FROM curve")
def ecdf_grid(spark, d):
    return rounded(stats.ecdf_on_grid(fx.zoned(spark, d, typed(spark, d)), ["zone"], "r", -1.0, 1.0, 41), 9, "below")


@query(f"WITH {GRID} SELECT k, round(quantile_cont(below, 0.16), 9) AS p16, round(quantile_cont(below, 0.5), 9) AS p50, round(quantile_cont(below, 0.84), 9) AS p84 FROM curve GROUP BY k")
def ecdf_bands(spark, d):
    curves = stats.ecdf_on_grid(fx.zoned(spark, d, typed(spark, d)), ["zone"], "r", -1.0, 1.0, 41)
    return rounded(stats.bands(curves, ["k"], "below"), 9, "p16", "p50", "p84")


@query(f"WITH {fx.SKY} SELECT tracer, least(floor(z / 0.1::DOUBLE)::INT, 19) AS bin, count(*) AS n FROM sky WHERE z >= 0 AND z <= 2 GROUP BY ALL")
def z_histogram(spark, d):
    return stats.histogram(fx.sky(spark, d), ["tracer"], "z", 0.0, 2.0, 20).withColumn("bin", F.col("bin").cast("int"))


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY tracer, isdata ORDER BY md5('0|' || pid), pid) AS k, count(*) FILTER (isdata) OVER (PARTITION BY tracer) AS nd, count(*) FILTER (NOT isdata) OVER (PARTITION BY tracer) AS nr FROM points)"


@query(f"WITH {fx.POINTS}, {RANKED}, dist AS (SELECT tracer, isdata, sqrt(x * x + y * y + z * z) AS s FROM ranked WHERE k <= least(nd, nr)) SELECT tracer, isdata, least(floor(s / 0.05::DOUBLE)::INT, 19) AS bin, count(*) AS n FROM dist WHERE s <= 1 GROUP BY ALL")
def radial_histogram(spark, d):
    pts = fx.points(spark, d)
    size = pts.groupBy("tracer").agg(F.least(F.count_if("isdata"), F.count_if(~F.col("isdata"))).alias("least_n"))
    w = select.Window.partitionBy("tracer", "isdata").orderBy(sampling.rank_hash(F.lit(0), F.col("pid")), "pid")
    even = pts.withColumn("k", F.row_number().over(w)).join(size, "tracer").where("k <= least_n")
    return stats.histogram(even.withColumn("s", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))), ["tracer", "isdata"], "s", 0.0, 1.0, 20).withColumn("bin", F.col("bin").cast("int"))


# Selections

BOX = {k: f"ra > {a} AND ra < {b} AND dec > {c} AND dec < {e}" for k, (a, b, c, e) in select.BOXES.items()}


@query(f"WITH {fx.SKY} SELECT targetid, ra, dec, z FROM sky WHERE {BOX['NGC1']} AND z > 0.5 AND z < 1.5")
def box_cut(spark, d):
    return fx.sky(spark, d).where(select.in_box(*select.BOXES["NGC1"], 0.5, 1.5)).select("targetid", "ra", "dec", "z")


@query(f"WITH {fx.SKY} SELECT targetid, CASE WHEN ra >= 90 AND ra <= 300 THEN 'NGC' ELSE 'SGC' END AS side FROM sky")
def ra_split(spark, d):
    return fx.sky(spark, d).select("targetid", select.ra_side().alias("side"))


@query(f"WITH {fx.SKY} SELECT targetid, zone, CASE WHEN zone IN {tuple(select.NORTH)} THEN 'N' ELSE 'S' END AS hemisphere FROM sky")
def hemisphere(spark, d):
    return fx.sky(spark, d).select("targetid", "zone", select.hemisphere(F.col("zone")).alias("hemisphere"))


@query(f"WITH {fx.SKY} " + " UNION ALL ".join(f"SELECT targetid, tracer, '{k}' AS region FROM sky WHERE {c}" for k, c in BOX.items()))
def region_union(spark, d):
    return select.regions(fx.sky(spark, d)).select("targetid", "tracer", "region")


@query(f"WITH {fx.SKY} " + " UNION ALL ".join(f"SELECT tracer, '{k}' AS region, count(*) FILTER ({c}) AS n FROM sky GROUP BY tracer" for k, c in BOX.items()))
def cut_counts(spark, d):
    return select.cut_counts(fx.sky(spark, d))


@query(f"WITH {fx.SKY}, p AS (SELECT *, {comoving_sql('z')} AS dist FROM sky) SELECT targetid, round(dist, 4) AS dist, round(dist * cos(radians(dec)) * cos(radians(ra)), 4) + 0.0 AS xcart, round(dist * cos(radians(dec)) * sin(radians(ra)), 4) + 0.0 AS ycart, round(dist * sin(radians(dec)), 4) + 0.0 AS zcart FROM p")
def cartesian_places(spark, d):
    df = fx.sky(spark, d).withColumn("dist", comoving_distance(F.col("z")))
    return rounded(df.select("targetid", "dist", *cartesian(F.col("ra"), F.col("dec"), F.col("dist"))), 4, "dist", "xcart", "ycart", "zcart")


ITER = "raw AS (SELECT o_orderkey AS targetid, (o_orderkey % 12)::INT - 1 AS randiter FROM orders)"


def raw_iterations(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("targetid"), (F.col("o_orderkey") % 12 - 1).cast("int").alias("randiter"))


@query(f"WITH {ITER} SELECT * FROM raw WHERE randiter = -1")
def source_filter(spark, d):
    return raw_iterations(spark, d).where(select.of_source("data"))


@query(f"WITH {ITER} SELECT * FROM raw WHERE randiter IN (-1, 2, 5)")
def iteration_filter(spark, d):
    return raw_iterations(spark, d).where(select.of_iterations([2, 5]))


@query(f"WITH {fx.SKY} SELECT targetid, tracer, z FROM sky WHERE CASE tracer WHEN 'BUILDING' THEN z BETWEEN 0.2 AND 0.8 WHEN 'MACHINERY' THEN z <= 0.45 ELSE z <= 1.4 END")
def zcap_filter(spark, d):
    return select.under_caps(fx.sky(spark, d), caps={"MACHINERY": 0.45}, default=1.4, slices={"BUILDING": (0.8, 0.2)}).select("targetid", "tracer", "z")


@query(f"WITH {fx.SKY}, q AS (SELECT tracer, quantile_cont(z, 0.1) AS a, quantile_cont(z, 0.9) AS b FROM sky GROUP BY tracer) SELECT targetid, sky.tracer, z FROM sky JOIN q USING (tracer) WHERE z >= CASE WHEN b - a < 0.001 THEN (a + b) / 2 - greatest(0.05, b - a) ELSE a END AND z <= CASE WHEN b - a < 0.001 THEN (a + b) / 2 + greatest(0.05, b - a) ELSE b END")
def quantile_slice(spark, d):
    return select.middle_slice(fx.sky(spark, d)).select("targetid", "tracer", "z")


# Both quantiles are the median, so every tracer's range is narrow and is widened.
@query(f"WITH {fx.SKY}, q AS (SELECT tracer, median(z) AS m FROM sky GROUP BY tracer) SELECT targetid, sky.tracer, z FROM sky JOIN q USING (tracer) WHERE z >= m - 0.05::DOUBLE AND z <= m + 0.05::DOUBLE")
def narrow_slice(spark, d):
    return select.middle_slice(fx.sky(spark, d), 0.5, 0.5).select("targetid", "tracer", "z")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"WITH {fx.SKY} SELECT targetid, tracer, z FROM sky WHERE (tracer = 'MACHINERY' AND z <= 1.4) OR (tracer = 'BUILDING' AND z BETWEEN 0.2 AND 0.8)")
def picked_slices(spark, d):
    names = select.picked(["machinery", "homes", "BUILDING"], SEGMENTS, {"homes": "BUILDING"})
    rows = fx.sky(spark, d).where(F.col("tracer").isin(names))
    return select.under_caps(rows, caps={}, default=1.4, slices=select.slice_specs(["building_new:0.8:0.2", " "])).select("targetid", "tracer", "z")


@query(f"WITH {fx.SKY} SELECT targetid, tracer, ra::FLOAT AS ra, dec::FLOAT AS dec, z::FLOAT AS z, (targetid % 5 - 1)::SMALLINT AS randiter, CASE tracer WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 255 END::SMALLINT AS tracer_id, 2001 AS zone FROM sky")
def narrowed_rows(spark, d):
    rows = fx.sky(spark, d).drop("zone").withColumn("randiter", F.col("targetid") % 5 - 1)
    return releases.narrowed(rows, 2001, {"BUILDING": 1, "MACHINERY": 2})


@query(f"WITH {fx.POINTS}, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM points), c AS (SELECT pid, x - mx AS x, y - my AS y, z - mz AS z FROM points, m) SELECT pid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM c WHERE abs(x) <= 0.1 AND abs(y) <= 0.1 AND abs(z) <= 0.1")
def cube_roi(spark, d):
    return rounded(select.cube(fx.points(spark, d), 0.2).select("pid", "x", "y", "z"), 9, "x", "y", "z")


# Labels


@query(f"WITH {fx.LABELS} SELECT label, regexp_replace(label, '_(DATA|RAND)$', '', 'i') AS base, regexp_replace(label, '_(DATA|RAND)$', '') AS base_strict, regexp_replace(regexp_replace(label, '_(DATA|RAND)$', ''), '_[^_]*$', '') AS base_core, regexp_replace(label, '_[^_]*$', '') AS without_last FROM labels")
def label_normalize(spark, d):
    c = F.col("label")
    return fx.labels(spark, d).select("label", lab.base_label(c).alias("base"), lab.base_strict(c).alias("base_strict"), lab.without_last_token(lab.base_strict(c)).alias("base_core"), lab.without_last_token(c).alias("without_last"))


@query(f"WITH {fx.LABELS} SELECT split_part(label, '_', 1) AS prefix, count(*) AS n FROM labels GROUP BY 1")
def tracer_prefix(spark, d):
    return fx.labels(spark, d).groupBy(lab.first_token(F.col("label")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.LABELS} SELECT label, coalesce(starts_with(label, 'BGS'), false) AS bgs, coalesce(starts_with(label, 'ELG'), false) AS elg FROM labels")
def tracer_alias(spark, d):
    return fx.labels(spark, d).select("label", *(F.coalesce(lab.matches_alias(F.col("label"), t), F.lit(False)).alias(t.lower()) for t in ("BGS", "ELG")))


@query("SELECT c_custkey AS targetid, coalesce(n_name || CASE WHEN c_custkey % 2 = 0 THEN '_DATA' ELSE '_RAND' END, 'UNKNOWN') AS label FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 7 = 0 THEN 255 ELSE c_nationkey END")
def label_lookup(spark, d):
    df = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("targetid"), F.when(F.col("c_custkey") % 7 == 0, 255).otherwise(F.col("c_nationkey")).alias("tracer_id"), (F.col("c_custkey") % 2 == 0).alias("isdata"))
    dim = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("tracer_id"), F.col("n_name").alias("tracer"))
    return lab.full_label(df, dim).select("targetid", "label")


@query("SELECT n_name AS tag, CASE WHEN n_nationkey < 10 THEN lpad(n_nationkey::VARCHAR, 2, '0') ELSE n_nationkey::VARCHAR END AS zone, '_' || regexp_replace(n_name, '[^A-Za-z0-9_.]', '_', 'g') AS safe, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def name_tags(spark, d):
    n = fx.table(spark, d, "nation")
    return n.select(F.col("n_name").alias("tag"), lab.zone_tag(F.col("n_nationkey")).alias("zone"), lab.safe_tag(F.col("n_name")).alias("safe"), lab.slug(F.col("n_name")).alias("slug"))


# Projections

PARAMS = "lim AS (SELECT min(ra) AS lo, max(ra) AS hi, max(z) AS zmax FROM sky)"


def with_limits(df):
    lim = df.agg(F.min("ra").alias("lo"), F.max("ra").alias("hi"), F.max("z").alias("zmax"))  # one row
    return df.crossJoin(F.broadcast(lim))


@query(f"WITH {fx.SKY}, {PARAMS} SELECT targetid, round(greatest(-0.5, least(0.5, z / zmax * 3.0 * radians(ra - (lo + hi) / 2))), 9) + 0.0 AS px, round(z, 9) AS py FROM sky, lim")
def wedge_cone(spark, d):
    df = with_limits(fx.sky(spark, d))
    x, y = proj.wedge_cone(F.col("ra"), F.col("z"), (F.col("lo") + F.col("hi")) / 2, F.col("zmax"), 0.5, 3.0)
    return rounded(df.select("targetid", x.alias("px"), y.alias("py")), 9, "px", "py")


@query(f"WITH {fx.SKY}, {PARAMS}, a AS (SELECT targetid, radians(120.0 - (ra - lo) / (hi - lo) * 60.0) AS t, 0.1 + 0.9 * z / zmax AS s FROM sky, lim) SELECT targetid, round(s * cos(t), 9) + 0.0 AS px, round(s * sin(t), 9) + 0.0 AS py FROM a")
def wedge_section(spark, d):
    df = with_limits(fx.sky(spark, d))
    x, y = proj.section_polar(F.col("ra"), F.col("z"), F.col("lo"), F.col("hi"), r_max=F.col("zmax"))
    return rounded(df.select("targetid", x.alias("px"), y.alias("py")), 9, "px", "py")


@query(f"WITH {fx.SKY}, lim AS (SELECT zone, min(ra) AS lo, max(ra) AS hi FROM sky GROUP BY zone), k AS (SELECT zone, row_number() OVER (ORDER BY zone) - 1 AS sector, count(*) OVER () AS sectors FROM (SELECT DISTINCT zone FROM sky)) SELECT targetid, sky.zone, round((sector + coalesce((ra - lo) / nullif(hi - lo, 0), 0.5)) * 2 * pi() / sectors, 9) AS angle FROM sky JOIN lim USING (zone) JOIN k USING (zone)")
def pizza_angles(spark, d):
    df = fx.sky(spark, d)
    lim = df.groupBy("zone").agg(F.min("ra").alias("lo"), F.max("ra").alias("hi"))
    w = select.Window.orderBy("zone")  # a row for each zone
    lim = lim.withColumns({"sector": F.row_number().over(w) - 1, "sectors": F.count(F.lit(1)).over(select.Window.partitionBy(F.lit(1)))})
    out = df.join(lim, "zone").select("targetid", "zone", proj.pizza_angle(F.col("ra"), F.col("lo"), F.col("hi"), F.col("sector"), F.col("sectors")).alias("angle"))
    return rounded(out, 9, "angle")


@query(f"WITH {fx.SKY} SELECT targetid, round(z * cos(radians(dec)) * cos(radians(ra)), 9) + 0.0 AS px, round(z * cos(radians(dec)) * sin(radians(ra)), 9) + 0.0 AS py FROM sky")
def polar_view(spark, d):
    x, y = proj.polar(F.col("ra"), F.col("dec"), F.col("z"))
    return rounded(fx.sky(spark, d).select("targetid", x.alias("px"), y.alias("py")), 9, "px", "py")


# Draws

ITERATIONS = 5
_rotation = ", ".join(f"({j}, {f})" for j, f in enumerate(sampling.rotation(18, 36)))


@query(f"WITH {fx.POOL}, sizes AS (SELECT zone, tracer, count(*) AS n_real FROM sky GROUP BY ALL), ranked AS (SELECT j::INT AS randiter, pool.*, row_number() OVER (PARTITION BY zone, tracer, j ORDER BY md5(j || '|' || targetid), targetid) AS k FROM pool, range({ITERATIONS}) t(j)) SELECT randiter, zone, tracer, targetid FROM ranked JOIN sizes USING (zone, tracer) WHERE k <= n_real")
def draw_randoms(spark, d):
    real, pool = fx.sky(spark, d), fx.pool(spark, d)
    sizes = real.groupBy("zone", "tracer").agg(F.count(F.lit(1)).alias("n_real"))
    its = sampling.rotation_table(spark, 18, ITERATIONS)
    return sampling.draw(pool, its, sizes, ["zone", "tracer"]).select("randiter", "zone", "tracer", "targetid")


@query(f"WITH {fx.POOL}, its(randiter, file_idx) AS (VALUES {_rotation}), sizes AS (SELECT tracer, 20 AS n_real FROM sky GROUP BY ALL), ranked AS (SELECT randiter, file_idx, pool.tracer, targetid, row_number() OVER (PARTITION BY tracer, randiter ORDER BY md5(randiter || '|' || targetid), targetid) AS k FROM pool JOIN its USING (file_idx)) SELECT randiter, file_idx, tracer, targetid FROM ranked JOIN sizes USING (tracer) WHERE k <= n_real")
def draw_randoms_rotating_files(spark, d):
    sizes = fx.sky(spark, d).select("tracer").distinct().withColumn("n_real", F.lit(20))
    return sampling.draw(fx.pool(spark, d), sampling.rotation_table(spark, 18, 36), sizes, ["tracer"], by_file=True).select("randiter", "file_idx", "tracer", "targetid")


@query(f"SELECT * FROM (VALUES {_rotation}) t(randiter, file_idx)")
def file_rotation(spark, d):
    return sampling.rotation_table(spark, 18, 36)


@query(f"WITH {fx.SKY} SELECT targetid, j::INT AS randiter, true AS isdata FROM sky, range(4) t(j) UNION ALL SELECT o_orderkey, (o_orderkey % 4)::INT, false FROM orders")
def iteration_expand(spark, d):
    data = fx.sky(spark, d).select("targetid").withColumn("randiter", F.lit(-1))
    rand = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("targetid"), (F.col("o_orderkey") % 4).cast("int").alias("randiter"))
    return sampling.expand(data, rand, sampling.rotation_table(spark, 18, 4)).select("targetid", "randiter", "isdata")


@query(f"WITH {fx.POOL}, d AS (SELECT zone, count(*) AS n_data FROM sky GROUP BY 1), r AS (SELECT zone, count(*) AS n_rand FROM pool GROUP BY 1) SELECT zone, coalesce(n_data, 0) AS n_data, coalesce(n_rand, 0) AS n_rand, coalesce(n_data, 0) * 4 + coalesce(n_rand, 0) AS n_class, CASE WHEN n_data > 0 THEN 4.0::DOUBLE END AS effective_random FROM d FULL JOIN r USING (zone)")
def size_invariants(spark, d):
    data, rand = fx.sky(spark, d).select("zone", "targetid"), fx.pool(spark, d).select("zone", "targetid")
    its = sampling.rotation_table(spark, 18, 4)
    classes = data.crossJoin(F.broadcast(its)).select("zone", "targetid").union(rand)
    return sampling.size_check(data, rand, classes, ["zone"])


@query(f"WITH {fx.SKY}, r AS (SELECT *, row_number() OVER (PARTITION BY tracer ORDER BY md5('123|' || targetid), targetid) AS k FROM sky) SELECT targetid, tracer FROM r WHERE k <= 50")
def max_points(spark, d):
    return sampling.subsample(fx.sky(spark, d), 50, ["tracer"]).select("targetid", "tracer")


@query(f"WITH {fx.SKY} SELECT targetid FROM sky ORDER BY targetid LIMIT 100 OFFSET 20")
def row_block(spark, d):
    return sampling.block(fx.sky(spark, d), 100, ["targetid"], start=20).select("targetid")


# Graphs

DEGREES = f"{fx.EDGES}, e2 AS (SELECT randiter, id1 AS pid, id2 AS other FROM edges UNION ALL SELECT randiter, id2, id1 FROM edges), deg AS (SELECT randiter, pid, count(*) FILTER (other < 1000000) AS ndata, count(*) FILTER (other >= 1000000) AS nrand FROM e2 GROUP BY ALL)"


@query(f"WITH {DEGREES} SELECT randiter, pid, ndata + nrand AS degree FROM deg")
def degree_counts(spark, d):
    return graph.both_ways(fx.edges(spark, d)).groupBy("randiter", "pid").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {DEGREES}, ids AS (SELECT p_partkey AS pid, true AS isdata, j::INT AS randiter FROM part, range(1, 8) t(j) UNION ALL SELECT s_suppkey + 1000000, false, (s_suppkey % 7 + 1)::INT FROM supplier) SELECT ids.randiter, ids.pid, isdata, coalesce(ndata, 0) AS ndata, coalesce(nrand, 0) AS nrand FROM ids LEFT JOIN deg ON deg.pid = ids.pid AND deg.randiter = ids.randiter")
def class_from_pairs(spark, d):
    # Random ids have rows of their own iteration only; pairs of other iterations do not count for them.
    parts = fx.table(spark, d, "part").select(F.lit("all").alias("tracer"), F.col("p_partkey").alias("pid"), F.lit(-1).alias("randiter"))
    supp = fx.table(spark, d, "supplier").select(F.lit("all").alias("tracer"), (F.col("s_suppkey") + 1_000_000).alias("pid"), (F.col("s_suppkey") % 7 + 1).cast("int").alias("randiter"))
    its = spark.range(1, 8).select(F.col("id").cast("int").alias("randiter"))
    edges = fx.edges(spark, d)
    ends = graph.both_ways(edges).groupBy("tracer", "randiter", "pid").agg(F.count_if(F.col("other") < 1_000_000).alias("ndata"), F.count_if(F.col("other") >= 1_000_000).alias("nrand"))
    data = parts.drop("randiter").crossJoin(F.broadcast(its)).withColumn("isdata", F.lit(True)).unionByName(supp.withColumn("isdata", F.lit(False)))
    return data.join(ends, ["tracer", "randiter", "pid"], "left").na.fill(0, ["ndata", "nrand"]).select("randiter", "pid", "isdata", "ndata", "nrand")


SPHERES = f"""{fx.POINTS},
  corner AS (
    SELECT a.tracer, a.pid AS ia, b.pid AS ib, c.pid AS ic, e.pid AS id, a.x AS ax, a.y AS ay, a.z AS az,
           b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz, e.x - a.x AS wx, e.y - a.y AS wy, e.z - a.z AS wz
    FROM points a JOIN points b ON a.tracer = b.tracer AND a.pid < b.pid JOIN points c ON b.tracer = c.tracer AND b.pid < c.pid JOIN points e ON c.tracer = e.tracer AND c.pid < e.pid),
  cr AS (SELECT *, vy*wz - vz*wy AS p1, vz*wx - vx*wz AS p2, vx*wy - vy*wx AS p3, wy*uz - wz*uy AS q1, wz*ux - wx*uz AS q2, wx*uy - wy*ux AS q3, uy*vz - uz*vy AS s1, uz*vx - ux*vz AS s2, ux*vy - uy*vx AS s3, ux*ux + uy*uy + uz*uz AS u2, vx*vx + vy*vy + vz*vz AS v2, wx*wx + wy*wy + wz*wz AS w2 FROM corner),
  ce AS (SELECT tracer, ia, ib, ic, id, ax, ay, az, (u2*p1 + v2*q1 + w2*s1) / (2*(ux*p1 + uy*p2 + uz*p3)) AS cx, (u2*p2 + v2*q2 + w2*s2) / (2*(ux*p1 + uy*p2 + uz*p3)) AS cy, (u2*p3 + v2*q3 + w2*s3) / (2*(ux*p1 + uy*p2 + uz*p3)) AS cz FROM cr WHERE ux*p1 + uy*p2 + uz*p3 <> 0),
  tets AS (SELECT * FROM ce WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.tracer = ce.tracer AND o.pid NOT IN (ia, ib, ic, id)
    AND (o.x-ax-cx)*(o.x-ax-cx) + (o.y-ay-cy)*(o.y-ay-cy) + (o.z-az-cz)*(o.z-az-cz) < (cx*cx + cy*cy + cz*cz) * (1 - 1e-12))),
  del AS (SELECT DISTINCT tracer, unnest([least(ia, ib), least(ia, ic), least(ia, id), least(ib, ic), least(ib, id), least(ic, id)]) AS id1, unnest([greatest(ia, ib), greatest(ia, ic), greatest(ia, id), greatest(ib, ic), greatest(ib, id), greatest(ic, id)]) AS id2 FROM tets)"""


@query(f"WITH {SPHERES} SELECT tracer, id1, id2 FROM del")
def delaunay_edges(spark, d):
    return graph.delaunay_edges(fx.points(spark, d), ["tracer"])


@query(f"WITH {SPHERES}, e2 AS (SELECT tracer, id1 AS pid, id2 AS other FROM del UNION ALL SELECT tracer, id2, id1 FROM del) SELECT points.tracer, points.pid, points.isdata, count(o.pid) FILTER (o.isdata) AS ndata, count(o.pid) FILTER (NOT o.isdata) AS nrand FROM points LEFT JOIN e2 ON e2.tracer = points.tracer AND e2.pid = points.pid LEFT JOIN points o ON o.tracer = e2.tracer AND o.pid = e2.other GROUP BY ALL")
def delaunay_counts(spark, d):
    pts = fx.points(spark, d)
    return graph.neighbour_counts(pts, graph.delaunay_edges(pts, ["tracer"]), ["tracer"]).select("tracer", "pid", "isdata", "ndata", "nrand")


EPS = 0.06
NEAR = f"{fx.POINTS}, near AS (SELECT a.tracer, a.pid AS id1, b.pid AS id2, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS distance FROM points a JOIN points b ON a.tracer = b.tracer AND a.pid < b.pid)"


@query(f"WITH {NEAR} SELECT tracer, id1, id2, round(distance, 9) AS distance FROM near WHERE distance <= {EPS}")
def radius_pairs(spark, d):
    return rounded(graph.radius_pairs(fx.points(spark, d), ["tracer"], EPS), 9, "distance")


KNN = f"{NEAR}, both_ AS (SELECT * FROM near UNION ALL SELECT tracer, id2, id1, distance FROM near), nn AS (SELECT *, row_number() OVER (PARTITION BY tracer, id1 ORDER BY distance, id2) AS k FROM both_)"


@query(f"WITH {KNN} SELECT DISTINCT tracer, least(id1, id2) AS id1, greatest(id1, id2) AS id2 FROM nn WHERE k <= 4")
def knn_edges(spark, d):
    return graph.nearest(fx.points(spark, d), ["tracer"], 4).select("tracer", "id1", "id2")


@query(f"WITH {KNN} SELECT tracer, id1, id2 FROM nn WHERE k <= 4 AND id1 < id2")
def knn_edges_directed(spark, d):
    return graph.nearest(fx.points(spark, d), ["tracer"], 4, symmetric=False).select("tracer", "id1", "id2")


@query(f"WITH {NEAR}, e AS (SELECT * FROM near WHERE distance <= 0.1), q AS (SELECT tracer, greatest(quantile_cont(distance, 0.95), 2.5 * median(distance)) AS most FROM e GROUP BY tracer) SELECT e.tracer, id1, id2 FROM e JOIN q USING (tracer) WHERE distance <= most")
def edge_length_filter(spark, d):
    return graph.within_length(graph.radius_pairs(fx.points(spark, d), ["tracer"], 0.1), ["tracer"]).select("tracer", "id1", "id2")


FOF = f"{NEAR}, link AS (SELECT tracer, id1 AS a, id2 AS b FROM near WHERE distance <= {EPS} UNION ALL SELECT tracer, id2, id1 FROM near WHERE distance <= {EPS}), reach AS (SELECT tracer, pid AS a, pid AS b FROM points UNION SELECT r.tracer, r.a, l.b FROM reach r JOIN link l ON l.tracer = r.tracer AND l.a = r.b), fof AS (SELECT tracer, a AS pid, min(b) AS first FROM reach GROUP BY ALL), member AS (SELECT points.*, fof.first, dense_rank() OVER (PARTITION BY points.tracer ORDER BY fof.first) - 1 AS groupid FROM points JOIN fof ON fof.pid = points.pid AND fof.tracer = points.tracer)"


def members(spark, d):
    return groups.friends(fx.points(spark, d), ["tracer"], EPS)


@query(f"WITH RECURSIVE {FOF} SELECT tracer, pid, first, groupid FROM member")
def fof_groups(spark, d):
    return members(spark, d).select("tracer", "pid", "first", F.col("groupid").cast("long").alias("groupid"))


@query(f"WITH RECURSIVE {FOF} SELECT n.tracer, id1, id2, m.groupid FROM near n JOIN member m ON m.tracer = n.tracer AND m.pid = id1 JOIN member o ON o.tracer = n.tracer AND o.pid = id2 WHERE m.groupid = o.groupid AND distance <= 0.1")
def edges_in_groups(spark, d):
    return graph.within_groups(graph.radius_pairs(fx.points(spark, d), ["tracer"], 0.1), members(spark, d), ["tracer"]).withColumn("groupid", F.col("groupid").cast("long"))


# The hull volume has no short SQL: tested against sums over tetrahedra.
@query(f"WITH {SPHERES}, v AS (SELECT t.tracer, sum(abs(c.ux*c.p1 + c.uy*c.p2 + c.uz*c.p3)) / 6 AS vol FROM tets t JOIN cr c ON c.tracer = t.tracer AND c.ia = t.ia AND c.ib = t.ib AND c.ic = t.ic AND c.id = t.id GROUP BY 1) SELECT tracer, n, round(cbrt(vol / n), 9) AS linklen FROM v JOIN (SELECT tracer, count(*) AS n FROM points GROUP BY 1) USING (tracer)")
def fof_linking_length(spark, d):
    return rounded(groups.linking_lengths(fx.points(spark, d), ["tracer"]), 9, "linklen")


TENSOR = f"{FOF}, mid AS (SELECT tracer, groupid, count(*) AS npts, avg(x) AS xcm, avg(y) AS ycm, avg(z) AS zcm FROM member GROUP BY ALL), t AS (SELECT m.tracer, m.groupid, any_value(npts) AS npts, any_value(xcm) AS xcm, any_value(ycm) AS ycm, any_value(zcm) AS zcm, sum((y-ycm)*(y-ycm) + (z-zcm)*(z-zcm)) AS ixx, sum((x-xcm)*(x-xcm) + (z-zcm)*(z-zcm)) AS iyy, sum((x-xcm)*(x-xcm) + (y-ycm)*(y-ycm)) AS izz, -sum((x-xcm)*(y-ycm)) AS ixy, -sum((x-xcm)*(z-zcm)) AS ixz, -sum((y-ycm)*(z-zcm)) AS iyz FROM member m JOIN mid g ON g.tracer = m.tracer AND g.groupid = m.groupid GROUP BY ALL), ev AS (SELECT *, (ixx+iyy+izz)/3 AS q FROM t), ev2 AS (SELECT *, sqrt(((ixx-q)*(ixx-q) + (iyy-q)*(iyy-q) + (izz-q)*(izz-q) + 2*(ixy*ixy + ixz*ixz + iyz*iyz)) / 6) AS p FROM ev), ev3 AS (SELECT *, acos(greatest(-1, least(1, coalesce(((ixx-q)*((iyy-q)*(izz-q) - iyz*iyz) - ixy*(ixy*(izz-q) - iyz*ixz) + ixz*(ixy*iyz - (iyy-q)*ixz)) / 2 / nullif(p*p*p, 0), 0)))) / 3 AS f FROM ev2), ev4 AS (SELECT *, q + 2*p*cos(f) AS e1, q + 2*p*cos(f + 2*pi()/3) AS e3 FROM ev3)"


@query(f"WITH RECURSIVE {TENSOR} SELECT tracer, groupid, npts, round(xcm, 6) + 0.0 AS xcm, round(ycm, 6) + 0.0 AS ycm, round(zcm, 6) + 0.0 AS zcm, round(sqrt(greatest(0, e1)), 6) + 0.0 AS a, round(sqrt(greatest(0, 3*q - e1 - e3)), 6) + 0.0 AS b FROM ev4")
def group_inertia(spark, d):
    df = groups.ellipsoids(members(spark, d), ["tracer", "groupid"]).drop("c").withColumn("groupid", F.col("groupid").cast("long"))
    return rounded(df, 6, "xcm", "ycm", "zcm", "a", "b")


@query(f"WITH RECURSIVE {TENSOR} SELECT tracer, groupid, npts, CASE WHEN npts > 1 THEN round(sqrt(greatest(0, e1)), 6) + 0.0 END AS a, CASE WHEN npts > 1 THEN round(sqrt(greatest(0, 3*q - e1 - e3)), 6) + 0.0 END AS b, CASE WHEN npts > 3 THEN round(sqrt(greatest(0, e3)), 6) + 0.0 END AS c FROM ev4")
def group_inertia_of_pairs_up(spark, d):
    df = groups.ellipsoids(members(spark, d), ["tracer", "groupid"], least=2).withColumn("groupid", F.col("groupid").cast("long"))
    # The least axis of three points or fewer is 0 but for rounding, which a root makes large.
    return rounded(df.select("tracer", "groupid", "npts", "a", "b", F.when(F.col("npts") > 3, F.col("c")).alias("c")), 6, "a", "b", "c")


@query(f"WITH {fx.POINTS} SELECT p.tracer, round(max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))), 9) AS diameter FROM points p JOIN points q ON p.tracer = q.tracer GROUP BY 1")
def max_pairwise_distance(spark, d):
    return rounded(groups.diameters(fx.points(spark, d), ["tracer"]), 9, "diameter")


@query(f"WITH {fx.SKY}, g AS (SELECT tracer, zone, count(*) AS npts FROM sky GROUP BY ALL) SELECT * FROM g WHERE npts >= CASE tracer WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN 3 ELSE 5 END AND npts >= 5")
def groups_of_preset_size(spark, d):
    g = fx.sky(spark, d).groupBy("tracer", "zone").agg(F.count(F.lit(1)).alias("npts"))
    return g.where(select.enough_members(F.col("npts"), F.col("tracer"), 5, {"BUILDING": 12, "MACHINERY": 3}))


@query(f"WITH {fx.SKY} SELECT tracer, zone, round(median(ra), 6) AS ra, round(median(z), 6) AS z, count(*) AS npts FROM sky GROUP BY ALL")
def group_centers(spark, d):
    return rounded(groups.centres(fx.sky(spark, d), ["tracer", "zone"]), 6, "ra", "z")


@query(f"WITH RECURSIVE {FOF}, g AS (SELECT tracer, groupid, count(*) AS npts FROM member GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tracer ORDER BY npts DESC, groupid) AS rank FROM g) SELECT * FROM r WHERE rank <= 5")
def top_groups(spark, d):
    g = members(spark, d).groupBy("tracer", F.col("groupid").cast("long").alias("groupid")).agg(F.count(F.lit(1)).alias("npts"))
    return groups.largest(g, ["tracer"], 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {fx.SKY}, g AS (SELECT tracer, zone AS groupid, round(sqrt((max(ra)-min(ra))*(max(ra)-min(ra)) + (max(dec)-min(dec))*(max(dec)-min(dec))), 6) AS extent, count(*) AS npts FROM sky GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tracer ORDER BY extent DESC, groupid) AS rank FROM g) SELECT tracer, groupid, extent, npts, rank FROM r WHERE rank <= 3")
def longest_groups(spark, d):
    df = fx.sky(spark, d).withColumn("groupid", F.col("zone"))
    ext = rounded(groups.extents(df, ["tracer", "groupid"], "ra", "dec"), 6, "extent")
    w = select.Window.partitionBy("tracer").orderBy(F.desc("extent"), "groupid")
    return ext.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")


@query(f"WITH RECURSIVE {FOF}, s AS (SELECT *, count(*) OVER (PARTITION BY tracer, groupid) AS npts, row_number() OVER (PARTITION BY tracer, groupid ORDER BY y, pid) AS step FROM member) SELECT tracer, groupid, pid, step FROM s WHERE npts >= 3")
def polyline_order(spark, d):
    df = groups.polylines(members(spark, d), ["tracer"], 3)
    return df.select("tracer", F.col("groupid").cast("long").alias("groupid"), "pid", F.col("step").cast("long").alias("step"))


@query(f"WITH RECURSIVE {FOF}, g AS (SELECT DISTINCT tracer, groupid FROM member) SELECT tracer, groupid, (dense_rank() OVER (PARTITION BY tracer ORDER BY groupid) - 1) % 10 AS colour FROM g")
def group_colours(spark, d):
    g = members(spark, d).select("tracer", F.col("groupid").cast("long").alias("groupid")).distinct()
    return groups.colours(g, ["tracer"], 10).withColumn("colour", F.col("colour").cast("long"))


CELLS, SIDE = 8, 0.8
_cell = ", ".join(f"least(floor(({c} + {SIDE / 2}) / {SIDE / CELLS})::INT, {CELLS - 1}) AS i{c}" for c in "xyz")
DENS = f"{fx.POINTS}, cells AS (SELECT {_cell}, count(*) AS n FROM points WHERE abs(x) <= {SIDE / 2} AND abs(y) <= {SIDE / 2} AND abs(z) <= {SIDE / 2} GROUP BY ALL)"


@query(f"WITH {DENS} SELECT * FROM cells")
def density_grid(spark, d):
    return stats.grid_counts(fx.points(spark, d), SIDE, CELLS)


_taps = ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in stats.kernel(1.2))
_in = lambda c: f"{c} >= 0 AND {c} < {CELLS}"


@query(f"WITH {DENS}, tap(k, v) AS (VALUES {_taps}), s1 AS (SELECT ix + k AS ix, iy, iz, sum(n * v) AS n FROM cells, tap GROUP BY ALL), s2 AS (SELECT ix, iy + k AS iy, iz, sum(n * v) AS n FROM s1, tap WHERE {_in('ix')} GROUP BY ALL), s3 AS (SELECT ix, iy, iz + k AS iz, sum(n * v) AS n FROM s2, tap WHERE {_in('iy')} GROUP BY ALL) SELECT ix, iy, iz, round(n, 9) AS n FROM s3 WHERE {_in('iz')}")
def density_smooth(spark, d):
    return rounded(stats.smoothed(stats.grid_counts(fx.points(spark, d), SIDE, CELLS), CELLS), 9, "n")


@query()
def pca_align(spark, d):
    return stats.principal_axes(fx.points(spark, d), ["x", "y", "z"]).select("pid", "pc1", "pc2", "pc3")


# Joins of products


def class_rows(spark, d):
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("targetid"), (F.col("l_linenumber") - 2).alias("randiter"), (F.col("l_linenumber") % 2 == 1).alias("isdata"), F.concat("l_returnflag", F.lit("_data")).alias("tracertype"))


def raw_places(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("targetid"), (F.col("o_orderkey") % 4 - 1).cast("int").alias("randiter"), F.concat(F.element_at(F.array(F.lit("N"), F.lit("A"), F.lit("R")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("_RAND")).alias("tracertype"), F.col("o_totalprice").alias("xcart"), F.col("o_custkey").cast("double").alias("ycart"), F.lit(0.0).alias("zcart"))


CR = "class AS (SELECT l_orderkey AS targetid, l_linenumber - 2 AS randiter, l_linenumber % 2 = 1 AS isdata, l_returnflag AS base FROM lineitem), raw AS (SELECT o_orderkey AS targetid, (o_orderkey % 4 - 1)::INT AS randiter, ['N', 'A', 'R'][o_orderkey % 3 + 1] AS base, o_totalprice AS xcart, o_custkey::DOUBLE AS ycart FROM orders)"


@query(f"WITH {CR} SELECT class.targetid, class.randiter, isdata, xcart, ycart FROM class JOIN raw ON raw.targetid = class.targetid AND raw.base = class.base AND raw.randiter = CASE WHEN isdata THEN -1 ELSE class.randiter END")
def join_class_raw(spark, d):
    return select.with_coordinates(class_rows(spark, d), raw_places(spark, d)).select("targetid", "randiter", "isdata", "xcart", "ycart")


def group_rows(spark, d):
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("targetid"), (F.col("l_linenumber") - 2).alias("randiter"), F.concat("l_returnflag", F.lit("_RAND")).alias("tracertype"), F.col("l_suppkey").alias("groupid"))


GR = "grp AS (SELECT l_orderkey AS targetid, l_linenumber - 2 AS randiter, l_returnflag || '_RAND' AS tracertype, l_suppkey AS groupid FROM lineitem), raw AS (SELECT o_orderkey AS targetid, (o_orderkey % 4 - 1)::INT AS randiter, ['N', 'A', 'R'][o_orderkey % 3 + 1] || '_RAND' AS tracertype, o_totalprice AS xcart FROM orders)"


@query(f"WITH {GR} SELECT targetid, tracertype, randiter, groupid, xcart FROM grp JOIN raw USING (targetid, tracertype, randiter) WHERE randiter <> -1")
def join_groups_raw(spark, d):
    return select.groups_on_raw(group_rows(spark, d), raw_places(spark, d), "rand").select("targetid", "tracertype", "randiter", "groupid", "xcart")


@query(f"WITH {GR} SELECT grp.targetid, grp.randiter, groupid, xcart FROM grp JOIN raw ON raw.targetid = grp.targetid AND raw.randiter = CASE WHEN grp.randiter = 2 THEN -1 ELSE grp.randiter END")
def join_groups_raw_by_iteration(spark, d):
    raw = raw_places(spark, d).drop("tracertype")
    return select.groups_on_raw_by_iteration(group_rows(spark, d), raw, 2).select("targetid", "randiter", "groupid", "xcart")


@query(f"WITH {fx.PROBS}, best AS (SELECT targetid, {ARGMAX} AS webtype FROM probs) SELECT p_partkey AS targetid, p_brand, webtype FROM part JOIN best ON targetid = p_partkey")
def join_types(spark, d):
    best = probs(spark, d).select("targetid", most_probable([F.col(p) for p in P]).alias("webtype"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("targetid"), "p_brand").join(best, "targetid")


@query(f"WITH {fx.COUNTS}, raw AS (SELECT p_partkey AS targetid, j::INT AS randiter FROM part, range(1, 8) t(j)) SELECT raw.targetid, raw.randiter, {fx.R} AS r FROM raw LEFT JOIN counts ON counts.targetid = raw.targetid AND counts.randiter = raw.randiter")
def left_join_counts(spark, d):
    its = spark.range(1, 8).select(F.col("id").cast("int").alias("randiter"))
    raw = fx.table(spark, d, "part").select(F.col("p_partkey").alias("targetid")).crossJoin(F.broadcast(its))
    return raw.join(fx.counts(spark, d), ["targetid", "randiter"], "left").select("targetid", "randiter", ratio(F.col("ndata"), F.col("nrand")).alias("r"))


@query(f"WITH {fx.COUNTS} SELECT targetid, randiter, ndata, nrand FROM counts WHERE targetid IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def semi_ids(spark, d):
    ids = fx.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("targetid"))
    return select.seen_ids(fx.counts(spark, d), ids).select("targetid", "randiter", "ndata", "nrand")


@query("SELECT l_partkey AS targetid, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def dedupe_first(spark, d):
    df = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("targetid"), "l_orderkey", "l_linenumber")
    return select.first_of(df, ["targetid"], ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS targetid, o_custkey AS zone, NULL::VARCHAR AS tracer FROM orders UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def combine_products(spark, d):
    a = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("targetid"), F.col("o_custkey").alias("zone"))
    b = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("targetid"), F.col("c_nationkey").cast("long").alias("zone"), F.col("c_mktsegment").alias("tracer"))
    return products.combined([a, b])


@query(f"WITH {fx.POOL} SELECT 'raw' AS product, zone::VARCHAR AS zone, count(*) AS rows FROM sky GROUP BY zone UNION ALL SELECT 'pool', zone::VARCHAR, count(*) FROM pool GROUP BY zone")
def manifest(spark, d):
    return products.manifest({"raw": fx.sky(spark, d), "pool": fx.pool(spark, d)})


# The whole pipeline: raw draws, triangulations, counts, probabilities, groups


def small_release(spark, d):
    """All customers as data, all orders as the random pool, three iterations."""
    real = fx.sky(spark, d).withColumn("zone", select.ra_side())
    pool = fx.pool(spark, d).withColumn("zone", select.ra_side())
    return releases.raw_rows(spark, real, pool, 3)


@query()
def pipeline_probabilities(spark, d):
    raw = pipeline.materialize(small_release(spark, d), "raw")
    pairs = pipeline.materialize(pipeline.pairs_of(raw), "pairs")
    return pipeline.probabilities_of(pipeline.classes_of(raw, pairs))


@query()
def pipeline_groups(spark, d):
    raw = pipeline.materialize(small_release(spark, d), "raw")
    pairs = pipeline.materialize(pipeline.pairs_of(raw), "pairs")
    classes = pipeline.materialize(pipeline.classes_of(raw, pairs), "classes")
    return pipeline.groups_of(classes, "sheet", "both").select("zone", "tracer", "randiter", "targetid", "isdata", "webtype", "groupid", "npts", "xcm", "ycm", "zcm", "a", "b", "c", "linklen")


assert math.isclose(sum(v for _, v in stats.kernel(1.2)), 1.0)
