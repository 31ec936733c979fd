import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from starweave.functions import cosmology
from starweave.functions.webtype import TYPES, classify, entropy, most_probable, probabilities, ratio
from starweave.operators import delaunay, graph, groups, nearest, sampling, select, stats
from starweave.operators.components import connected
from starweave.plans import pipeline, registry
from starweave.sources import fits, products, releases


def test_thresholds_and_undefined_ratios(spark):
    df = spark.createDataFrame([(0, 10), (1, 19), (5, 5), (19, 1), (10, 0), (0, 0)], "nd int, nr int")
    r = ratio(F.col("nd"), F.col("nr"))
    got = df.select(classify(r).alias("l"), classify(r, closed="right").alias("r"), classify(ratio(F.col("nd"), F.col("nr"), 0.0)).alias("u")).collect()
    assert [x.l for x in got] == ["void", "sheet", "filament", "knot", "knot", None]
    assert [x.r for x in got] == ["void", "void", "sheet", "filament", "knot", None]
    assert got[5].u == "filament"
    with pytest.raises(ValueError):
        classify(F.col("nd"), 0.1, 0.2)


def test_ties_nulls_and_entropy(spark):
    rows = [(0.5, 0.5, 0.0, 0.0), (None, 0.2, 0.2, None), (None,) * 4, (0.25,) * 4]
    df = spark.createDataFrame(rows, "pvoid double, psheet double, pfilament double, pknot double")
    parts = [F.col(f"p{t}") for t in TYPES]
    got = df.select(most_probable(parts).alias("t"), entropy(parts).alias("h")).collect()
    assert [x.t for x in got] == ["void", "sheet", "", "void"]
    assert got[0].h == pytest.approx(0.5) and got[3].h == pytest.approx(1.0)


def test_probabilities_sum_to_one_or_zero(spark):
    df = spark.createDataFrame([(1, "void"), (1, "knot"), (2, None)], "id int, webtype string")
    got = {x.id: x for x in probabilities(df, ["id"]).collect()}
    assert got[1].pvoid == got[1].pknot == 0.5 and sum(got[2][f"p{t}"] for t in TYPES) == 0


def test_distance_is_monotone_and_converged(spark):
    assert cosmology.hubble(1.0) == pytest.approx(1.0, abs=1e-12)
    z = spark.createDataFrame([(x,) for x in np.linspace(0, 3.5, 30).tolist()], "z double")
    got = z.select(cosmology.comoving_distance(F.col("z")).alias("a"), cosmology.comoving_distance(F.col("z"), 64).alias("b")).orderBy("a").collect()
    assert got[0].a == 0 and all(abs(x.a - x.b) < 1e-6 for x in got)
    assert spark.range(1).select(cosmology.comoving_distance(F.lit(1.0)).alias("d")).first().d == pytest.approx(3395.63, abs=0.5)


def test_box_is_open_and_sides_are_closed(spark):
    df = spark.createDataFrame([(110.0, 0.0, 0.5), (110.1, 0.0, 0.5), (90.0, 0.0, 0.1), (300.0, 0.0, 0.1)], "ra double, dec double, z double")
    assert df.where(select.in_box(110, 260, -10, 8)).count() == 1
    assert df.where(select.in_box(110, 260, -10, 8, 0.6, 1)).count() == 0
    assert [x.s for x in df.select(select.ra_side().alias("s")).collect()] == ["NGC"] * 4
    assert [x.s for x in df.select(select.ra_side(edges=False).alias("s")).collect()] == ["NGC", "NGC", "SGC", "SGC"]


def test_triangulation_by_euler_and_empty_spheres():
    rng = np.random.default_rng(3)
    for n in (5, 12, 60, 200):
        p = rng.normal(size=(n, 3))
        t = delaunay.tetrahedra(p)
        centre, r2 = delaunay._spheres(p, t)
        inside = ((p[None] - centre[:, None]) ** 2).sum(2) < r2[:, None] * (1 - 1e-9)
        assert not inside.any()
        edges = len(delaunay.edges(p))
        faces = np.unique(np.sort(np.concatenate([np.delete(t, k, 1) for k in range(4)]), 1), axis=0)
        assert n - edges + len(faces) - len(t) == 1
    with pytest.raises(delaunay.DegenerateError):
        delaunay.tetrahedra(np.c_[rng.normal(size=(9, 2)), np.zeros(9)])
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], dtype=float)
    assert delaunay.volume(cube + rng.normal(size=cube.shape) * 1e-7) == pytest.approx(1.0, abs=1e-5)


def test_triangulation_of_copies_that_differ_in_the_last_digits():
    # As of catalogues repeated under other keys, whose places are computed anew; on a lattice many points share a sphere.
    rng = np.random.default_rng(2)
    near = np.repeat(rng.normal(size=(60, 3)), 6, 0) + rng.normal(size=(360, 3)) * 1e-13
    lattice = np.stack(np.meshgrid(*[np.arange(5.0)] * 3), -1).reshape(-1, 3)
    for p in (near, lattice):
        t = delaunay.tetrahedra(p)
        edges = delaunay.edges(p)
        faces, times = np.unique(np.sort(np.concatenate([np.delete(t, k, 1) for k in range(4)]), 1), axis=0, return_counts=True)
        assert times.max() == 2 and len(np.unique(t)) == len(p)
        assert len(p) - len(edges) + len(faces) - len(t) == 1
    assert delaunay.volume(near) == pytest.approx(delaunay.volume(near[::6]), rel=1e-9)
    assert delaunay.volume(lattice) == pytest.approx(64.0)


def test_degrees_match_edges_and_coincident_points_are_isolated(spark):
    rng = np.random.default_rng(1)
    at = [(0, i, *map(float, rng.normal(size=3)), bool(i % 2)) for i in range(30)]
    at.append((0, 30, *at[0][2:5], True))
    at += [(1, i, float(i), 0.0, 0.0, True) for i in range(6)]
    pts = spark.createDataFrame(at, "b int, pid long, x double, y double, z double, isdata boolean")
    edges = graph.delaunay_edges(pts, ["b"])
    got = graph.neighbour_counts(pts, edges, ["b"]).collect()
    assert sum(x.ndata + x.nrand for x in got) == 2 * edges.count()
    assert len(got) == 37 and all(x.ndata + x.nrand == 0 for x in got if x.b == 1 or x.pid == 30)
    with pytest.raises(Exception):
        graph.delaunay_edges(pts, ["b"], on_degenerate="raise").collect()


@pytest.mark.parametrize("k, leaf, chunk", [(4, 256, 65_536), (1, 8, 300)])
def test_nearest_of_leaves_copies_and_points_without_a_place(spark, duck, monkeypatch, k, leaf, chunk):
    monkeypatch.setattr(nearest, "LEAF", leaf)
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    rng, inf, nan = np.random.default_rng(1), np.inf, np.nan
    odd = [[inf, 0, 0], [nan, 0, 0], [inf, 1, 1], [-inf, 2, 2], [1, nan, inf], [None, 0, 0], [1, None, nan]]
    blocks = [rng.normal(size=(700, 3)), rng.integers(0, 4, (600, 3)), np.concatenate([np.zeros((300, 3)), rng.normal(size=(50, 3)) * 1e-9, [[1e9, 0, 0], [1e200, 0, 0]]])]
    blocks = [[list(map(float, p)) for p in b] for b in blocks] + [[[0, 0, 0], [1, 0, 0], [0, 3, 0], *odd], [*rng.normal(size=(40, 3)).tolist(), *odd]]
    at = [(t if i % 97 else None, *(None if c is None else float(c) for c in p)) for t, b in enumerate(blocks) for i, p in enumerate(b, 1)]
    df = spark.createDataFrame([(int(i), *p) for i, p in zip(rng.permutation(len(at)), at, strict=True)], "pid long, tracer int, x double, y double, z double")
    given = df.toArrow()  # noqa: F841
    duck.sql("CREATE OR REPLACE TEMP TABLE points_of_leaves AS SELECT * FROM given")
    both = "SELECT a.tracer, a.pid AS id1, b.pid AS id2, row_number() OVER (PARTITION BY a.tracer, a.pid ORDER BY sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.pid) AS k FROM points_of_leaves a JOIN points_of_leaves b ON a.tracer = b.tracer AND a.pid <> b.pid"
    want = duck.sql(f"SELECT tracer, id1, id2 FROM ({both}) WHERE k <= {k} AND id1 < id2").fetchall()
    assert sorted(tuple(r)[:3] for r in graph.nearest(df, ["tracer"], k, symmetric=False).collect()) == sorted(want)


def test_nearest_makes_no_pairs_of_whole_blocks(spark):
    at = np.random.default_rng(2).normal(size=(6000, 3))
    df = spark.createDataFrame(pd.DataFrame({"tracer": 1, "pid": range(6000), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))
    rows = nearest._placed(df.withColumns({n: F.struct(*(F.lit(v).alias(c) for c in "xyz")) for n, v in (("lo", -5.0), ("hi", 5.0))}), ["tracer"], 4)
    assert rows.count() == 6000 and rows.where("_lead").groupBy("_leaf").count().agg(F.max("count")).first()[0] <= nearest.LEAF
    assert rows.agg(F.max("_reach")).first()[0] < 5


def test_quantiles_are_exact_without_all_distances_in_memory(spark, duck, monkeypatch):
    monkeypatch.delattr(graph.F, "percentile")
    monkeypatch.delattr(graph.F, "median")
    rng, inf = np.random.default_rng(1), np.inf
    blocks = [rng.random(900), rng.normal(size=700) ** 2, np.repeat([0.1, 0.3], [90, 37]), np.zeros(50), [0.7], rng.random(2), [0.2, 0.4, inf, 0.0], [0.3] * 7 + [inf] * 9, 0.5 + rng.random(500) * 1e-7]
    rows = [(t, i, i + 1, float(d) if i % 101 else None) for t, b in enumerate(blocks) for i, d in enumerate(b)]
    df = spark.createDataFrame(rows, "t int, id1 int, id2 int, distance double")
    given = df.toArrow()  # noqa: F841
    duck.sql("CREATE OR REPLACE TEMP TABLE lengths AS SELECT * FROM given")
    limits = "SELECT t, quantile_cont(distance, 0.95) AS a, median(distance) AS b FROM lengths GROUP BY t HAVING count(distance) > 0"
    assert sorted(map(tuple, graph.quantiles(df, ["t"], [0.95, 0.5]).collect())) == sorted(duck.sql(limits).fetchall())
    want = duck.sql(f"SELECT t, id1, id2 FROM lengths JOIN ({limits}) USING (t) WHERE distance <= greatest(a, 2.5 * b)").fetchall()
    assert sorted((r.t, r.id1, r.id2) for r in graph.within_length(df, ["t"]).collect()) == sorted(want)


def test_classes_made_of_pairs(spark):
    ids = spark.createDataFrame([("t", 1, -1), ("t", 2, -1), ("t", 9, 0), ("t", 8, 1)], "tracer string, pid long, randiter int")
    pairs = spark.createDataFrame([("t", 0, 1, 9), ("t", 0, 1, 2)], "tracer string, randiter int, id1 long, id2 long")
    its = spark.createDataFrame([(0,), (1,)], "randiter int")
    got = {(x.pid, x.randiter): (x.isdata, x.ndata, x.nrand) for x in graph.classes_of_pairs(pairs, ids, its).collect()}
    assert got == {(1, 0): (True, 1, 1), (2, 0): (True, 1, 0), (9, 0): (False, 1, 0), (1, 1): (True, 0, 0), (2, 1): (True, 0, 0), (8, 1): (False, 0, 0)}


def test_groups_of_points(spark):
    pts = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 1.0, 0.0, 0.0), ("a", 3, 2.5, 0.0, 0.0), ("b", 4, 0.5, 0.0, 0.0)], "t string, pid long, x double, y double, z double")
    got = {x.pid: (x.first, x.groupid) for x in groups.friends(pts, ["t"], 1.0).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 1), 4: (4, 0)}  # a distance of exactly eps links
    wide = {x.pid: x.first for x in groups.friends(pts, ["t"], 1.5).collect()}
    assert wide == {1: 1, 2: 1, 3: 1, 4: 4}
    length = {x.t: x.linklen for x in groups.linking_lengths(pts, ["t"]).collect()}
    assert length["a"] == pytest.approx(2.5) and length["b"] == groups.LEAST
    e = groups.ellipsoids(groups.friends(pts, ["t"], 1.5), ["t", "groupid"]).where("npts = 3").first()
    inertia = np.array([[0, 0, 0], [1, 0, 0], [2.5, 0, 0]]) - [3.5 / 3, 0, 0]
    want = np.sqrt((inertia**2).sum())
    assert (e.a, e.b, e.c) == (pytest.approx(want, abs=1e-6), pytest.approx(want, abs=1e-6), pytest.approx(0, abs=1e-6))


def test_dense_cells_are_linked_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.random((300, 3)) * 0.1, rng.random((200, 3)) * 6 + [0, 0, 1], rng.random((50, 3)) * 0.1 + [0.5, 0.5, 0.5]])
    counted = []
    monkeypatch.setattr(groups, "connected", lambda e: counted.append(e.distinct().count()) or connected(e))
    df = spark.createDataFrame([("t", int(i), *map(float, p)) for i, p in enumerate(at[rng.permutation(len(at))])], "tracer string, pid long, x double, y double, z double")
    got = {r.pid: r.first for r in groups.friends(df, ["tracer"], 1.0).collect()}
    p = np.array([r[2:] for r in df.orderBy("pid").collect()])
    near = np.linalg.norm(p[:, None] - p[None], axis=2) <= 1.0
    first = np.arange(len(p))
    while (first != (first := np.where(near, first[None], len(p)).min(1))).any():
        pass
    assert [got[i] for i in range(len(p))] == first.tolist()
    assert counted[0] < 5000 < near.sum() // 2


def test_hull_of_many_points_needs_few():
    p = np.random.default_rng(6).normal(size=(3000, 3))
    assert len(delaunay._rim(p)) < 300
    t = delaunay.tetrahedra(p)
    whole = np.abs(np.linalg.det(p[t[:, 1:]] - p[t[:, :1]])).sum() / 6
    assert delaunay.volume(p) == pytest.approx(whole, rel=1e-12)


def test_linking_length_takes_the_hull_of_all_points(spark):
    pids = sorted(range(50_008), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    at = np.random.default_rng(3).random((len(pids), 3)) * 0.2 - 0.1
    at[-8:] = [[x, y, z] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]  # last by hash
    df = spark.createDataFrame(pd.DataFrame({"t": "a", "pid": pids, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))
    want = (8 / len(pids)) ** (1 / 3)
    assert groups.linking_lengths(df, ["t"]).first().linklen == pytest.approx(want, rel=1e-12)
    assert groups.linking_lengths(df, ["t"], part=3000).first().linklen == pytest.approx(want, rel=1e-12)


def test_axes_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i, *map(float, rng.normal(size=3) * [1, 2, 3])) for g in range(20) for i in range(rng.integers(2, 9))]
    df = spark.createDataFrame(rows, "g int, pid long, x double, y double, z double")
    for r in groups.ellipsoids(df, ["g"]).collect():
        p = np.array([x[2:] for x in rows if x[0] == r.g])
        p = p - p.mean(0)
        t = (p**2).sum() * np.eye(3) - p.T @ p
        assert np.allclose([r.c, r.b, r.a], np.sqrt(np.clip(np.linalg.eigvalsh(t), 0, None)), atol=1e-6)


def test_rotation_uses_each_file_once_a_round():
    got = sampling.rotation(18, 54)
    assert all(sorted(got[k : k + 18]) == list(range(18)) for k in (0, 18, 36))


def test_short_pools_and_numpy_draws(spark):
    pool = spark.createDataFrame([("a", i) for i in range(5)], "tracer string, targetid long")
    sizes = spark.createDataFrame([("a", 6), ("b", 1)], "tracer string, n_real long")
    assert {x.tracer for x in sampling.short_pools(pool, sizes, ["tracer"]).collect()} == {"a", "b"}
    got = {x.targetid for x in sampling.numpy_draw(pool, 7, 3, ["targetid"]).collect()}
    assert got == {int(i) for i in np.random.default_rng(7).choice(5, size=3, replace=False)}
    with pytest.raises(ValueError):
        sampling.numpy_draw(pool, 7, 6, ["targetid"])


def test_histogram_holds_its_right_end(spark):
    df = spark.createDataFrame([("k", x) for x in (0.0, 0.3, 0.6, 0.61)], "k string, v double")
    assert {x.bin: x.n for x in stats.histogram(df, ["k"], "v", 0, 0.6, 2).collect()} == {0: 1, 1: 2}
    assert {x.bin: x.density for x in stats.density(df, ["k"], "v", 0, 0.6, 2).collect()}[1] == pytest.approx(2 / (4 * 0.3))


def test_histogram_counts_whole_widths_as_its_sql_does(spark, duck, tmp_path):
    # Balances of 550 k - 1000 lie on the ends of bins, where z / 0.1 and 20 z / 2 round to either side.
    rows = [(k, "x", 1, 550.0 * k - 1000.0, "t") for k in range(21)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT tracer, bin, n FROM ({registry.ORACLE_SQL['z_histogram']})").fetchall())
    assert sorted(map(tuple, registry.QUERIES["z_histogram"](spark, str(tmp_path)).select("tracer", "bin", "n").collect())) == want


def test_fits_round_trip(spark, tmp_path):
    rows = [(1, 0.5, True, "abc", 3), (2, -1.25, False, "", 4)]
    df = spark.createDataFrame(rows, "TARGETID long, Z double, ISDATA boolean, NAME string, N int").coalesce(1)
    for zipped in (False, True):
        folder = str(tmp_path / f"f{zipped}")
        paths = fits.write_fits(df, folder, {"ZONE": "03", "N_ITER": 5}, zipped)
        cols = {"TARGETID": "bigint", "Z": "double", "ISDATA": "boolean", "NAME": "string", "N": "int", "TRACER_ID": "smallint"}
        back = fits.read_fits(spark, paths, cols, optional=["TRACER_ID"], rename={"N": "ZONE"}).orderBy("TARGETID").collect()
        assert [(x.TARGETID, x.Z, x.ISDATA, x.NAME, x.ZONE, x.TRACER_ID) for x in back] == [(*r, None) for r in rows]
        assert fits.row_counts(spark, paths).first().rows == 2
    with pytest.raises(Exception, match="lacks"):
        fits.read_fits(spark, paths, {"RA": "double"}).collect()


def test_products_are_partitioned_combined_and_built_once(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("03", "LRG", 1, 7), ("04", "QSO", -1, 8)], "zone string, tracer string, randiter int, targetid long")
    products.write_product(df, root, "classification", "x")
    assert products.read_product(spark, root, "classification", "x", ["targetid", "nothing"]).columns == ["targetid"]
    with pytest.raises(FileNotFoundError):
        products.read_product(spark, root, "pairs")
    calls = []
    for _ in range(2):
        got = products.built_once(spark, f"{root}/once", lambda: calls.append(1) or df)
        assert got.count() == 2
    assert len(calls) == 1
    assert [x.t for x in df.select(products.iteration_tag(F.col("randiter")).alias("t")).collect()] == ["iter001", "iterdata"]
    assert releases.cuts_from_json('{"NGC1": {"RA_min": 1, "RA_max": 2, "DEC_min": 3, "DEC_max": 4}}')["NGC1"] == (1.0, 2.0, 3.0, 4.0, None, None)
    with pytest.raises(ValueError):
        releases.cuts_from_json('{"XX": {}}')


def test_release_of_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    small = releases.Release("first", ("LRG",), tuple(select.BOXES), random_files=2, boxes=select.BOXES)
    for half in "NS":
        for k in (None, 0, 1):
            n = 20 if k is None else 60
            rows = [(int(i), float(rng.uniform(180, 250)), float(rng.uniform(-9, 7)), float(rng.uniform(0.1, 1))) for i in range(n)]
            made = fits.write_fits(spark.createDataFrame(rows, "TARGETID long, RA double, DEC double, Z double").coalesce(1), str(tmp_path / "x"))
            path = small.paths(str(tmp_path), "LRG", k)["NS".index(half)]
            (tmp_path / "x" / made[0].rsplit("/", 1)[1]).rename(path)
    real = small.zone(releases.catalogues(spark, small, str(tmp_path), randoms=False))
    pool = small.zone(releases.catalogues(spark, small, str(tmp_path), randoms=True))
    raw = releases.raw_rows(spark, real, pool, 2, files=2)
    got = {(x.zone, x.randiter): x["count"] for x in raw.groupBy("zone", "randiter").count().collect()}
    assert got == {("NGC1", -1): 40, ("NGC1", 0): 40, ("NGC1", 1): 40}
    out = pipeline.run(raw, "filament", "both")
    assert out.classification.count() == 40 * 2 + 80
    assert out.probability.where("abs(pvoid + psheet + pfilament + pknot - 1) < 1e-9").count() == out.probability.where("most <> '' and pvoid + psheet + pfilament + pknot > 0").count()
    assert out.groups.where("a >= b and b >= c and c >= 0").count() == out.groups.count()


def test_a_narrow_slice_is_widened_about_its_middle(spark):
    rows = [("a", z) for z in (0.5, 0.5002, 0.5004, 0.5491, 0.5512, 0.4489)] + [("b", k / 10) for k in range(11)]
    rows += [("a", 0.5002)] * 60
    got = select.middle_slice(spark.createDataFrame(rows, "tracer string, z double"))
    assert {r.z for r in got.where("tracer = 'a'").collect()} == {0.5, 0.5002, 0.5004, 0.5491}
    assert sorted(r.z for r in got.where("tracer = 'b'").collect()) == [k / 10 for k in range(1, 10)]


def test_slice_specs_and_tracers_asked_for():
    assert select.slice_specs([" lrg_x : 0.8:0.2", "", "QSO:1:2"]) == {"LRG": (0.2, 0.8), "QSO": (1.0, 2.0)}
    assert select.slice_specs(None) == {}
    for bad in ("LRG:1", ":1:2", "LRG:a:b", "LRG:nan:1", "LRG:1:inf", "LRG:1:1", "LRG:1:2:3"):
        with pytest.raises(ValueError):
            select.slice_specs([bad])
    known = ["BGS_BRIGHT", "LRG", "QSO"]
    assert select.picked(None, known) == known
    assert select.picked(["qso", "bgs", "QSO"], known, {"bgs": "BGS_BRIGHT"}) == ["QSO", "BGS_BRIGHT"]
    with pytest.raises(ValueError):
        select.picked(["ELG"], known)


def test_zones_asked_for():
    assert releases.zones_of(releases.EARLY, "7, 3 7") == ["03", "07"]
    assert releases.zones_of(releases.EARLY) == releases.zones_of(releases.EARLY, ["1", "all"]) == list(releases.EARLY.zones)
    assert releases.zones_of(releases.SECOND, "sgc ngc") == ["SGC", "NGC"]
    assert releases.zones_of(releases.FIRST, "ngc1") == ["NGC1"]
    for release, bad in ((releases.EARLY, "20"), (releases.EARLY, "x"), (releases.SECOND, "NGC1"), (releases.FIRST, "all"), (releases.FIRST, None), (releases.FIRST, "NGC1 NGC2")):
        with pytest.raises(ValueError):
            releases.zones_of(release, bad)


def test_diameters(spark):
    rng = np.random.default_rng(4)
    shell = rng.normal(size=(300, 3))
    shell /= np.linalg.norm(shell, axis=1)[:, None]
    clouds = {"shell": shell, "ball": rng.normal(size=(500, 3)), "flat": rng.random((200, 3)) * [1, 1, 0], "line": np.outer(np.arange(9.0), [1, 2, 3]), "one": np.ones((1, 3)), "same": np.ones((4, 3))}
    df = spark.createDataFrame([(k, *map(float, p)) for k, v in clouds.items() for p in v], "tracer string, x double, y double, z double")
    got = dict(groups.diameters(df, ["tracer"]).collect())
    for k, v in clouds.items():
        assert got[k] == pytest.approx(np.linalg.norm(v[:, None] - v[None], axis=2).max())


def test_fixed_lengths_and_single_members(spark):
    df = spark.createDataFrame([("BGS_ANY", 0, 0.0, 0.0, 0.0), ("BGS_ANY", 1, 19.0, 0.0, 0.0), ("BGS_ANY", 2, 50.0, 0.0, 0.0), ("QSO", 3, 0.0, 0.0, 0.0), ("QSO", 4, 69.0, 0.0, 0.0), ("other", 5, 0.0, 0.0, 0.0)], "tracer string, pid long, x double, y double, z double")
    lengths = groups.fixed_lengths(df, ["tracer"])
    assert dict(lengths.collect()) == {"BGS_ANY": 20.0, "QSO": 70.0}
    found = groups.friends_each(df, ["tracer"], lengths)
    assert sorted((r.pid, r.groupid) for r in found.collect()) == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0)]
    got = {(r.tracer, r.groupid): r.a for r in groups.ellipsoids(found, ["tracer", "groupid"], least=2).collect()}
    assert got["BGS_ANY", 1] is None and got["BGS_ANY", 0] == pytest.approx(np.sqrt(19.0**2 / 2))


def test_blocks_begin_where_path_and_seed_say():
    starts = {sampling.block_start(p, 1000, 100, s) for p in ("a.fits", "b.fits") for s in range(20)}
    assert len(starts) > 30 and all(0 <= x <= 900 for x in starts)
    assert sampling.block_start("a.fits", 1000, 100, 3) == sampling.block_start("a.fits", 1000, 100, 3)
    assert sampling.block_start("a.fits", 50, 100) == 0


@pytest.mark.parametrize("by_file", [False, True])
def test_draws_are_the_lowest_hashes(spark, by_file):
    import hashlib

    # Key c has ids picked so that its low hashes are too few.
    low = lambda j, i: int(hashlib.md5(f"{j}|{i}".encode()).hexdigest()[:8], 16) / 2**32
    ids = {"a": range(2000), "b": range(2000, 2030), "c": [i for i in range(9000) if low(0, i) > 0.5][:900]}
    rows = [(k, i, i % 2) for k, v in ids.items() for i in v]
    plan = [(0, 1), (1, 0)]
    n = {"a": 40, "b": 50, "c": 30}
    pool = spark.createDataFrame(rows, "tracer string, targetid long, file_idx int")
    got = sampling.draw(pool, spark.createDataFrame(plan, "randiter int, file_idx int"), spark.createDataFrame(list(n.items()), "tracer string, n_real int"), ["tracer"], by_file)
    want = []
    for j, f in plan:
        for k, v in ids.items():
            own = [i for i in v if not by_file or i % 2 == f]
            want += [(k, j, i) for i in sorted(own, key=lambda i: (hashlib.md5(f"{j}|{i}".encode()).hexdigest(), i))[: n[k]]]
    assert sorted((r.tracer, r.randiter, r.targetid) for r in got.collect()) == sorted(want)
