"""Near-duplicate vectors by dual traversal of cover trees.

Equal vectors of a label are one point with a multiplicity. Points are dealt to cells by a tree of pivots:
a node with more than CELL points takes about FAN of them as pivots, each of its points goes to the nearest,
and so on for as many levels as the largest label needs, so that a point meets FAN pivots a level whatever
the number of points is. Nodes are compared with their pivots in shares of SHARE points, and a cell that is
left with more than CELL points is split evenly by hash, so a dense region or a hot label never makes a large
task. Only children of nodes that meet are compared, and nodes meet only if their pivots are near enough for
their covering radii. A task builds a cover tree for each of its two cells, nested levels of balls whose
radii halve, and walks both trees at once, a level as it is needed: pairs of nodes whose balls
are too far apart are pruned, pairs that lie within the threshold as a whole are taken as they are, and
what is left is compared by cosine in double precision. Links are counted, not listed; a task reports a
spanning part of its links for the components.

Rows whose label is null, or whose vector is null, zero, of another length than others of its label, or
holds null or non-finite components, link with nothing (different lengths never link with each other).
Rows that repeat vec_id, label and vector are vectors of their own; a vec_id is taken to name one vector of a
label. An empty table gives no rows. Only vec_id, embedding
and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import connected, materialize

CELL = 2048
#: Pivots that a node of the tree of pivots takes.
FAN = 32
#: Points of a node that one task compares with the node's pivots.
SHARE = 8192
#: Pairs of points up to which two sets of balls are compared without going down.
LEAF = 1 << 16
#: Slack for rounding in pruning and in taking balls whole; borderline pairs are compared.
SLACK = 1e-7


def build(unit: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], float]]:
    """Levels of a cover tree: centres (rows of unit), members of each ball, radius. Each level splits the balls of the one above."""
    members, radius = [np.arange(len(unit))], 2.0
    yield np.zeros(1, dtype=np.int64), members, radius
    while any(len(m) > 1 for m in members) and radius > 2e-4:
        radius /= 2
        centres, above, members = [], members, []
        for rest in above:
            while len(rest) > 1:
                near = np.sqrt(np.maximum(0, 2 - 2 * (unit[rest] @ unit[rest[0]]))) <= radius
                near[0] = True
                centres.append(rest[0])
                members.append(rest[near])
                rest = rest[~near]
            if len(rest):
                centres.append(rest[0])
                members.append(rest)
        yield np.array(centres), members, radius


def spread(unit: np.ndarray, level) -> np.ndarray:
    """Covering radius of each ball of a level."""
    centres, members, _ = level
    sizes = np.array([len(m) for m in members])
    cosines = np.einsum("ij,ij->i", unit[np.concatenate(members)], unit[np.repeat(centres, sizes)])
    least = np.minimum.reduceat(cosines, np.cumsum(sizes) - sizes)
    return np.where(sizes > 1, np.sqrt(np.maximum(0, 2 - 2 * least)), 0.0)


def descend(parents: list[np.ndarray], level) -> list[np.ndarray]:
    """For each ball of the level above, the balls of this level within it."""
    sizes = np.array([len(m) for m in parents])
    owner = np.empty(int(sizes.sum()), dtype=np.int64)
    owner[np.concatenate(parents)] = np.repeat(np.arange(len(parents)), sizes)
    own = owner[level[0]]
    return np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(parents)))[:-1])


def dual(a: np.ndarray, b: np.ndarray | None, least: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of points a and b (None: a with itself): weights linked with each, and a root of each among a's then b's rows."""
    same = b is None
    b = a if same else b
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / norm_a[:, None], b / norm_b[:, None]
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    tree_a = build(ua)
    tree_b = tree_a if same else build(ub)
    links_a, links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    shift = 0 if same else len(a)
    parent = np.arange(len(a) + (0 if same else len(b)))

    def unite(some: np.ndarray) -> None:
        top = parent[some]
        while ((up := parent[top]) != top).any():
            top = up
        parent[top] = parent[some] = top.min()

    def all_linked(i: np.ndarray, j: np.ndarray) -> None:
        """Balls i of a with balls j of b, each pair within the threshold as a whole; i ascends."""
        for k, (balls, others, of, links, weight) in enumerate(((ma, mb, (i, j), links_a, weight_b), (mb, ma, (j, i), links_b, weight_a))):
            sizes, lengths = np.array([len(m) for m in balls]), np.array([len(m) for m in others])
            sums = np.add.reduceat(weight[np.concatenate(others)], np.cumsum(lengths) - lengths)
            met = np.zeros(len(balls), dtype=np.int64)
            np.add.at(met, of[0], sums[of[1]])
            links[np.concatenate(balls)] += np.repeat(met, sizes)
            for x in np.unique(of[0][sizes[of[0]] > 1]):
                unite(balls[x] + k * shift)
        for s in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            unite(np.append(cb[j[s]] + shift, ca[i[s[0]]]))

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        """Points against points."""
        for k in range(0, len(p), 1024):
            own = p[k : k + 1024]
            hit = (a[own] @ b[q].T) / (norm_a[own][:, None] * norm_b[q][None, :]) >= least
            rows = np.flatnonzero(hit.any(1))
            if not len(rows):
                continue
            links_a[own] += hit @ weight_b[q]
            links_b[q] += weight_a[own] @ hit
            for r in rows:
                unite(np.append(q[hit[r]] + shift, own[r]))

    level_a = next(tree_a)
    level_b = level_a if same else next(tree_b)
    live = [(np.array([0]), np.array([0]))]  # balls of a against balls of b
    while live:
        (ca, ma, _), (cb, mb, _) = level_a, level_b
        ra = spread(ua, level_a)
        rb = ra if same else spread(ub, level_b)
        pairs_a, pairs_b, whole_a, whole_b = [], [], [], []
        for p, q in live:
            for k in range(0, len(p), 1024):
                own = p[k : k + 1024]
                far = np.sqrt(np.maximum(0, 2 - 2 * (ua[ca[own]] @ ub[cb[q]].T)))
                bound = ra[own][:, None] + rb[q][None, :]
                x, y = np.nonzero(far - bound <= reach + SLACK)
                whole = far[x, y] + bound[x, y] <= reach - SLACK
                pairs_a.append(own[x][~whole]), pairs_b.append(q[y][~whole])
                whole_a.append(own[x][whole]), whole_b.append(q[y][whole])
        i, j = np.concatenate(whole_a), np.concatenate(whole_b)
        if len(i):
            order = np.argsort(i, kind="stable")
            all_linked(i[order], j[order])
        pa_, pb_ = np.concatenate(pairs_a), np.concatenate(pairs_b)
        if not len(pa_):
            break
        order = np.argsort(pa_, kind="stable")
        pa_, pb_ = pa_[order], pb_[order]
        groups = np.split(np.arange(len(pa_)), np.flatnonzero(np.diff(pa_)) + 1)
        size_a = np.array([len(m) for m in ma])
        size_b = size_a if same else np.array([len(m) for m in mb])
        next_a = next_b = None
        if int((size_a[pa_] * size_b[pb_]).sum()) > LEAF:
            next_a = next(tree_a, None)
            next_b = next_a if same else next(tree_b, None)
        if next_a is None and next_b is None:  # few pairs of points in all, or no deeper level
            for s in groups:
                compare(ma[pa_[s[0]]], np.concatenate([mb[j] for j in pb_[s]]))
            break
        level_a, level_b = next_a or level_a, next_b or level_b
        da = descend(ma, level_a)
        db = da if same else descend(mb, level_b)
        live = [(da[pa_[s[0]]], np.concatenate([db[j] for j in pb_[s]])) for s in groups]
    root = parent
    while (root[root] != root).any():
        root = root[root]
    return links_a, links_b, root, shift


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """Vectors of one length in double precision."""
    return np.asarray(table.column(column).combine_chunks().flatten()).astype(np.float64).reshape(table.num_rows, -1)


def nearest(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """Points of a share of a node with the nearest of its pivots (the smallest of several) and the chord to it."""
    pivots = pivots.sort_by("pivot")
    at, to = matrix(points, "embedding"), matrix(pivots, "centre")
    at /= np.linalg.norm(at, axis=1)[:, None]
    to /= np.linalg.norm(to, axis=1)[:, None]
    cosines = at @ to.T
    best = cosines.argmax(1)
    far = np.sqrt(np.maximum(0, 2 - 2 * cosines[np.arange(len(at)), best]))
    columns = {c: points.column(c) for c in ("label", "dim", "rep", "n", "embedding")}
    return pa.table({**columns, "parent": points.column("node"), "node": pivots.column("pivot").take(pa.array(best)), "far": pa.array(far)})


def dealt_to_cells(points: DataFrame, reach: float, cell: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Points (label, dim, node, rep, n, embedding) by their cell, and the pairs (label, dim, a, b) of cells that meet, each once, a cell with itself too."""
    key = ["label", "dim", "node"]
    rows = points.select("label", F.size("embedding").alias("dim"), F.lit(0).cast("long").alias("node"), F.col("rep").cast("long").alias("rep"), "n", "embedding")
    pairs = rows.select("label", "dim").distinct().withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in ("label", "dim", "rep", "n", "embedding")), "parent long", "node long", "far double"])
    cosine = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * y), 0D, (a, x) -> a + x) / sqrt(aggregate({0}, 0D, (a, x) -> a + cast(x as double) * x) * aggregate({1}, 0D, (a, x) -> a + cast(x as double) * x))"
    chord = F.expr(f"sqrt(greatest(0D, 2 - 2 * ({cosine.format('centre_1', 'centre_2')})))")
    most = rows.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    for level in range(max(1, math.ceil(math.log(most / cell, fan)))):
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held"), F.min("rep").alias("least"))
        marked = rows.join(sizes, key).withColumn("shares", F.ceil(F.col("held") / SHARE).cast("int"))
        chance = F.expr(f"held > {cell} and pmod(xxhash64(rep, {level}), 1000000007) / 1000000007D <= 1.5D * least({fan}D, held / {cell}D) / held")
        pivots = marked.where((F.col("rep") == F.col("least")) | chance).groupBy(*key, "shares", F.col("rep").alias("pivot")).agg(F.min("embedding").alias("centre"))
        pivots = materialize(pivots, "pivots")  # some `fan` rows a node
        share = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("shares")).cast("int")
        left = marked.withColumn("share", share).drop("held", "least", "shares").groupBy(*key, "share")
        right = pivots.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares").groupBy(*key, "share")
        rows = materialize(left.cogroup(right).applyInArrow(lambda p, q: nearest(p, q), shape), "placed")
        nodes = rows.groupBy("label", "dim", "parent", "node").agg(F.max("far").alias("radius"))
        nodes = nodes.join(pivots.select("label", "dim", F.col("node").alias("parent"), F.col("pivot").alias("node"), "centre"), ["label", "dim", "parent", "node"])
        one, two = (nodes.select("label", "dim", F.col("parent").alias(up), *(F.col(c).alias(f"{c}_{k}") for c in ("node", "radius", "centre"))) for k, up in ((1, "a"), (2, "b")))
        meet = pairs.join(one, ["label", "dim", "a"]).join(two, ["label", "dim", "b"]).where("a <> b or node_1 <= node_2")
        meet = meet.where(chord <= F.col("radius_1") + F.col("radius_2") + F.lit(reach + SLACK))
        pairs = materialize(meet.select("label", "dim", F.col("node_1").alias("a"), F.col("node_2").alias("b")), "meet")
        rows = rows.drop("parent", "far")
    return rows, pairs


def near_links(vectors: DataFrame, least: float = 0.98, cell: int = CELL, fan: int = FAN) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", "label", "embedding")
    good = F.expr("label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    points = materialize(rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "points")
    placed, pairs = dealt_to_cells(points, math.sqrt(max(0.0, 2 - 2 * least)), cell, fan)
    key = ["label", "dim", "node"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    one, two = (parts.select("label", "dim", F.col("node").alias(side), F.col("parts").alias(f"parts_{side}")) for side in "ab")
    meet = pairs.join(one, ["label", "dim", "a"]).join(two, ["label", "dim", "b"])
    meet = meet.withColumn("part_a", F.explode(F.expr("sequence(0, parts_a - 1)"))).withColumn("part_b", F.explode(F.expr("sequence(0, parts_b - 1)"))).where("a <> b or part_a <= part_b")
    meet = materialize(meet.select("label", "dim", "a", "part_a", "b", "part_b", F.xxhash64("label", "dim", "a", "part_a", "b", "part_b").alias("task")), "tasks")
    sides = [meet.where(F.lit(k == 1) | F.expr("a <> b or part_a <> part_b")).select("label", "dim", F.col(side).alias("node"), F.col(f"part_{side}").alias("part"), "task", F.lit(k).alias("side")) for k, side in ((1, "a"), (2, "b"))]
    placed = placed.join(parts, key).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int"))
    dealt = placed.join(sides[0].union(sides[1]), [*key, "part"])

    def link(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side").combine_chunks())
        rep, n = np.asarray(table.column("rep").combine_chunks()), np.asarray(table.column("n").combine_chunks())
        vec = matrix(table, "embedding")
        # Of points with one identifier but different vectors, each counts for itself.
        p, q = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        la, lb, root, shift = dual(vec[p], None if not len(q) else vec[q], least, n[p], n[q] if len(q) else n[p])
        if not len(q):
            la = la - n[p]  # a point with itself
            ids = rep[p]
            out = pa.table({"rep": ids, "links": la, "root": ids[root]})
        else:
            ids = np.concatenate([rep[p], rep[q]])
            out = pa.table({"rep": ids, "links": np.concatenate([la, lb]), "root": ids[root]})
        return out.filter(pa.array((np.asarray(out.column("links")) > 0) | (np.asarray(out.column("rep")) != np.asarray(out.column("root")))))

    found = materialize(dealt.select("task", "side", "rep", "n", "embedding").groupBy("task").applyInArrow(lambda t: link(t), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    points = points.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    points = points.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("good").join(points, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))
