"""Three-dimensional Delaunay triangulation in numpy, by insertion of many points at a time.

Outer facets are tetrahedra with a vertex at infinity, so there is no large bounding simplex to spoil the
hull. A round takes points in random order, walks to each from a vertex nearby, finds the tetrahedra whose
spheres hold it through their neighbours, and inserts all points whose cavities do not touch, so that work grows
little faster than the number of points. Tests are in floating point with bounds of its error; what these leave
open is decided in whole numbers, and points on one sphere by a perturbation in order of their coordinates.
"""

from __future__ import annotations

import numpy as np

#: A round tries so many points for each one that it holds already: with more of them most cavities would touch.
TRIED = 1 / 16
#: Unit roundoff.
EPS = 2.0**-53
_NONE = np.iinfo(np.int64).max
#: By the place of a vertex, the other three, turned so that it comes last in an even order; and all in order.
_TURNED = np.array([[1, 3, 2], [0, 2, 3], [1, 0, 3], [0, 1, 2]])


class DegenerateError(ValueError):
    """Fewer than five points, or all in one plane."""


def _spheres(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = p[t[:, 0]]
    u, v, w = p[t[:, 1]] - a, p[t[:, 2]] - a, p[t[:, 3]] - a
    vw, wu, uv = np.cross(v, w), np.cross(w, u), np.cross(u, v)
    det = 2 * np.einsum("ij,ij->i", u, vw)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = ((u * u).sum(1)[:, None] * vw + (v * v).sum(1)[:, None] * wu + (w * w).sum(1)[:, None] * uv) / det[:, None]
    return a + c, (c * c).sum(1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(a.shape, dtype=a.dtype)
    for k, i, j in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        out[:, k] = a[:, i] * b[:, j] - a[:, j] * b[:, i]
    return out


def _sides(p: list[np.ndarray]) -> np.ndarray:
    """Six times the signed volumes of tetrahedra."""
    return _dot(_cross(p[1] - p[0], p[2] - p[0]), p[3] - p[0])


def _lifted(p: list[np.ndarray]) -> np.ndarray:
    """Positive where the fifth point lies within the sphere of the others, which have a positive volume."""
    a, b, c, d = (x - p[4] for x in p[:4])
    ab, bc, cd, da, ac, bd = (x[:, 0] * y[:, 1] - y[:, 0] * x[:, 1] for x, y in ((a, b), (b, c), (c, d), (d, a), (a, c), (b, d)))
    az, bz, cz, dz = (x[:, 2] for x in (a, b, c, d))
    abc, bcd, cda, dab = az * bc - bz * ac + cz * ab, bz * cd - cz * bd + dz * bc, cz * da + dz * ac + az * cd, dz * ab + az * bd + bz * da
    return (_dot(c, c) * dab - _dot(d, d) * abc) + (_dot(a, a) * bcd - _dot(b, b) * cda)


def _signs(x: np.ndarray) -> np.ndarray:
    return (x > 0).astype(np.int8) - (x < 0).astype(np.int8)


class _Mesh:
    """Tetrahedra of positive volume with their neighbours opposite to each vertex; vertex n lies at infinity."""

    def __init__(self, p: np.ndarray, first: np.ndarray):
        self.n = len(p)
        self.p = np.concatenate([np.ldexp(p, -int(np.frexp(np.abs(p).max())[1])), np.zeros((1, 3))])  # powers of two: exact
        self.lowest = int(np.frexp(self.p[self.p != 0])[1].min())
        self.order = None
        room = 8 * self.n + 64
        self.corners, self.near = np.full((room, 4), -1, dtype=np.int64), np.full((room, 4), -1, dtype=np.int64)
        self.base, self.ball = np.zeros(room, dtype=np.int64), np.empty((room, 5))
        self.claim, self.ring = np.full(room, _NONE), np.full(room, -1, dtype=np.int64)
        self.used, self.free = 5, np.zeros(0, dtype=np.int64)
        self.of = np.zeros(self.n + 1, dtype=np.int64)  # a tetrahedron of each vertex
        if self.side(first[None])[0] < 0:
            first = first[[1, 0, 2, 3]]
        rows = np.stack([first] * 5)
        for k in range(4):
            rows[k + 1, k] = self.n
            i, j = [m for m in range(4) if m != k][:2]
            rows[k + 1, [i, j]] = rows[k + 1, [j, i]]
        for a in range(5):
            for k in range(4):
                face = set(rows[a].tolist()) - {int(rows[a, k])}
                self.near[a, k] = next(b for b in range(5) if b != a and face <= set(rows[b].tolist()))
        self.put(np.arange(5), rows)

    def put(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Writes tetrahedra, a point each of their spheres' centres as seen from it, and the error of these; planes for those at infinity."""
        self.corners[ids] = rows
        self.of[rows] = ids[:, None]
        outer = rows == self.n
        at_infinity = outer.any(1)
        inner = ~at_infinity
        r = rows[inner]
        a = self.p[r[:, 0]]
        u, v, w = self.p[r[:, 1]] - a, self.p[r[:, 2]] - a, self.p[r[:, 3]] - a
        uu, vv, ww = _dot(u, u), _dot(v, v), _dot(w, w)
        vw = _cross(v, w)
        det = np.abs(_dot(u, vw))
        box = np.sqrt(uu * vv * ww)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            c = (uu[:, None] * vw + vv[:, None] * _cross(w, u) + ww[:, None] * _cross(u, v)) / (2 * det)[:, None]
            off = 128 * EPS * (box * (np.sqrt(uu) + np.sqrt(vv) + np.sqrt(ww)) / det * (1 + box / det) + np.sqrt(_dot(c, c)))
            off[~(det > 128 * EPS * box)] = np.nan
        new, base = np.empty((len(rows), 5)), np.empty(len(rows), dtype=np.int64)
        new[inner, :3], new[inner, 3], new[inner, 4], base[inner] = c, off, 1.0, r[:, 0]
        if at_infinity.any():
            r, k = rows[at_infinity], outer[at_infinity].argmax(1)
            r = np.take_along_axis(r, _TURNED[k], 1)
            a = self.p[r[:, 0]]
            v, w = self.p[r[:, 1]] - a, self.p[r[:, 2]] - a
            new[at_infinity, :3], new[at_infinity, 3], new[at_infinity, 4], base[at_infinity] = _cross(v, w) / 2, 64 * EPS * np.sqrt(_dot(v, v) * _dot(w, w)), 0.0, r[:, 0]
        self.ball[ids], self.base[ids] = new, base

    def whole(self, ids: np.ndarray) -> np.ndarray:
        """Coordinates as whole numbers of one scale."""
        part, power = np.frexp(self.p[ids])
        return np.ldexp(part, 53).astype(np.int64).astype(object) << np.where(part == 0, 0, power - self.lowest).astype(object)

    def side(self, rows: np.ndarray) -> np.ndarray:
        """Signs of volumes."""
        p = [self.p[rows[:, k]] for k in range(4)]
        found = _sides(p)
        bound = 16 * EPS * np.prod([np.abs(x - p[0]).sum(1) for x in p[1:]], axis=0)
        out = _signs(found)
        if len(open_ := np.flatnonzero(~(np.abs(found) > bound))):
            out[open_] = _signs(_sides([self.whole(rows[open_, k]) for k in range(4)]))
        return out

    def within(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether points lie within the spheres of tetrahedra; of points on a sphere, the ones first in order are moved out least."""
        rows = np.column_stack([rows, q])
        p = [self.p[rows[:, k]] for k in range(5)]
        found, size = _lifted(p), np.stack([np.abs(x - p[4]).sum(1) for x in p[:4]])
        out = _signs(found)
        if len(open_ := np.flatnonzero(~(np.abs(found) > 32 * EPS * size.prod(0) * size.sum(0)))):
            out[open_] = _signs(_lifted([self.whole(rows[open_, k]) for k in range(5)]))
            tied = open_[out[open_] == 0]
            if len(tied):
                if self.order is None:
                    self.order = np.empty(self.n, dtype=np.int64)
                    self.order[np.lexsort(self.p[: self.n].T[::-1])] = np.arange(self.n)
                last = np.argsort(-self.order[rows[tied]], axis=1)
                for k in range(2):
                    left = (out[tied] == 0) & (last[:, k] < 4)
                    out[tied[(out[tied] == 0) & (last[:, k] == 4)]] = -1
                    if left.any():
                        swapped = rows[tied[left], :4]
                        swapped[np.arange(len(swapped)), last[left, k]] = rows[tied[left], 4]
                        out[tied[left]] = self.side(swapped)
        return out > 0

    def conflicts(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether points lie within the spheres of tetrahedra, or beyond the planes of those at infinity."""
        d, ball = self.p[q] - self.p[self.base[t]], self.ball[t]
        dd = _dot(d, d)
        with np.errstate(invalid="ignore", over="ignore"):
            found = ball[:, 4] * dd - 2 * _dot(d, ball)
            far = np.sqrt(dd)
            out, sure = found < 0, np.abs(found) > far * (2 * ball[:, 3] + 16 * EPS * ball[:, 4] * far)
        if not sure.all():
            open_ = np.flatnonzero(~sure)
            rows, p, t = self.corners[t[open_]], q[open_], t[open_]
            outer = rows == self.n
            if outer.any():
                at = np.flatnonzero(outer.any(1))
                k = outer[at].argmax(1)
                beyond = rows[at]
                beyond[np.arange(len(at)), k] = p[at]
                sides = self.side(beyond)
                out[open_[at]] = sides > 0
                # In the plane of a facet, its circle is that of the sphere behind it.
                flat = sides == 0
                out[open_[at[flat]]] = self.within(self.corners[self.near[t[at[flat]], k[flat]]], p[at[flat]])
            at = np.flatnonzero(~outer.any(1))
            out[open_[at]] = self.within(rows[at], p[at])
        return out

    def walk(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The tetrahedra that hold points, or those at infinity that see them, on the way from others."""
        t = t.copy()
        live = np.arange(len(q))
        while len(live):
            rows = self.corners[t[live]]
            outer = rows == self.n
            out = np.flatnonzero(outer.any(1))
            ends = np.zeros(len(live), dtype=bool)
            if len(out):
                k = outer[out].argmax(1)
                row = rows[out]
                row[np.arange(len(out)), k] = q[live[out]]
                seen = self.side(row) > 0
                ends[out[seen]] = True
                t[live[out[~seen]]] = self.near[t[live[out[~seen]]], k[~seen]]
            at = np.flatnonzero(~outer.any(1))
            r, x = rows[at], q[live[at]]
            a = self.p[r[:, 0]]
            u, v, w, d = self.p[r[:, 1]] - a, self.p[r[:, 2]] - a, self.p[r[:, 3]] - a, self.p[x] - a
            vw = _cross(v, w)
            sides = np.empty((len(at), 4))
            sides[:, 1], sides[:, 2], sides[:, 3] = _dot(vw, d), _dot(_cross(w, u), d), _dot(_cross(u, v), d)
            sides[:, 0] = _dot(vw, u) - sides[:, 1] - sides[:, 2] - sides[:, 3]
            lu, lv, lw, ld = (np.sqrt(_dot(y, y)) for y in (u, v, w, d))
            bound = 64 * EPS * (lu * lv * lw + ld * (lu * lv + lv * lw + lw * lu))
            k = sides.argmin(1)
            go = sides[np.arange(len(at)), k] < -bound
            # The rest is inside but for faces too near to tell.
            for j in range(4):
                near = np.flatnonzero(~go & ~(np.abs(sides[:, j]) > bound))
                if len(near):
                    row = r[near]
                    row[:, j] = x[near]
                    over = near[self.side(row) < 0]
                    go[over], k[over] = True, j
            ends[at[~go]] = True
            t[live[at[go]]] = self.near[t[live[at[go]]], k[go]]
            live = live[~ends]
        return t

    def insert(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Inserts the points, each held by its tetrahedron, whose cavities touch none of a point before; says which."""
        own = np.arange(len(q))
        np.minimum.at(self.claim, t, own)
        alive = self.claim[t] == own
        front_c, front_t = own[alive], t[alive]
        cavity_c, cavity_t, ring_c, ring_t = [front_c], [front_t], [], []
        while len(front_c):
            c, s = np.repeat(front_c, 4), self.near[front_t].ravel()
            new = (self.claim[s] != c) & (self.ring[s] != c)
            key = np.unique(c[new] * len(self.claim) + s[new])
            c, s = np.divmod(key, len(self.claim))
            hit = self.conflicts(q[c], s)
            ring_c.append(c[~hit])
            ring_t.append(s[~hit])
            self.ring[s[~hit]] = c[~hit]
            c, s = c[hit], s[hit]
            np.minimum.at(self.claim, s, c)
            cavity_c.append(c)
            cavity_t.append(s)
            alive[c[self.claim[s] != c]] = False
            front_c, front_t = c[alive[c]], s[alive[c]]
        cavity_c, cavity_t, ring_c, ring_t = (np.concatenate(x) if x else own[:0] for x in (cavity_c, cavity_t, ring_c, ring_t))
        alive[cavity_c[self.claim[cavity_t] != cavity_c]] = False
        alive[ring_c[self.claim[ring_t] < ring_c]] = False
        c, s = cavity_c[alive[cavity_c]], cavity_t[alive[cavity_c]]
        beside = self.near[s]
        i, j = np.nonzero(self.claim[beside] != c[:, None])
        self.claim[cavity_t], self.claim[t], self.ring[ring_t] = _NONE, _NONE, -1
        c, gone, beyond = c[i], s, beside[i, j]
        rows = self.corners[s[i]]
        rows[np.arange(len(i)), j] = q[c]
        back = (self.near[beyond] == s[i][:, None]).argmax(1)
        ids = self.places(gone, len(rows))
        self.near[ids, j] = beyond
        self.near[beyond, back] = ids
        # Two new tetrahedra of a point are neighbours where they share an edge of its cavity.
        others = _TURNED[j]
        ends = np.take_along_axis(rows, others, 1)
        key = np.concatenate([(c * (self.n + 1) + np.minimum(x, y)) * (self.n + 1) + np.maximum(x, y) for x, y in ((ends[:, 1], ends[:, 2]), (ends[:, 0], ends[:, 2]), (ends[:, 0], ends[:, 1]))])
        tet, face = np.tile(ids, 3), others.T.ravel()
        by = np.argsort(key, kind="stable")
        a, b = by[0::2], by[1::2]
        if len(by) % 2 or (key[a] != key[b]).any():
            raise RuntimeError("a cavity is not closed")
        self.near[tet[a], face[a]], self.near[tet[b], face[b]] = tet[b], tet[a]
        self.put(ids, rows)
        return alive

    def places(self, gone: np.ndarray, n: int) -> np.ndarray:
        """Places for n tetrahedra: those that are removed, then free ones, then new ones."""
        self.corners[gone] = -1
        have = np.concatenate([gone, self.free])
        more = max(0, n - len(have))
        while self.used + more > len(self.corners):
            for name, fill in (("corners", -1), ("near", -1), ("base", 0), ("ball", 0), ("claim", _NONE), ("ring", -1)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full_like(old, fill)]))
        self.used += more
        self.free = have[n:]
        return np.concatenate([have[:n], np.arange(self.used - more, self.used)])


def _curve(p: np.ndarray) -> np.ndarray:
    """Places along a curve through all of space that keeps near points together."""
    low, high = p.min(0), p.max(0)
    cell = ((p - low) / np.maximum(high - low, 1e-300) * (2**20 - 1)).astype(np.int64)
    key = np.zeros(len(p), dtype=np.int64)
    for bit in range(20):
        for k in range(3):
            key |= ((cell[:, k] >> bit) & 1) << (3 * bit + k)
    out = np.empty(len(p), dtype=np.int64)
    out[np.argsort(key, kind="stable")] = np.arange(len(p))
    return out


def tetrahedra(points: np.ndarray) -> np.ndarray:
    """Rows of four indices into points. Points that coincide must be merged before."""
    given = np.asarray(points, dtype=float)
    if len(given) < 5:
        raise DegenerateError("at least five points are needed")
    p = given - given.mean(0)
    p = p / max(np.abs(p).max(), 1e-300)
    # A first simplex of generous size.
    i = int(np.argmax((p * p).sum(1)))
    j = int(np.argmax(((p - p[i]) ** 2).sum(1)))
    k = int(np.argmax((np.cross(p - p[i], p[j] - p[i]) ** 2).sum(1)))
    normal = np.cross(p[j] - p[i], p[k] - p[i])
    height = np.abs((p - p[i]) @ normal)
    m = int(np.argmax(height))
    if height[m] < 1e-10:
        raise DegenerateError("all points lie in one plane")
    first = np.array([i, j, k, m])
    mesh = _Mesh(given, first)
    rest = np.setdiff1d(np.arange(len(p)), first)
    queue = rest[np.random.default_rng(0).permutation(len(rest))]
    place = _curve(p)
    held = np.full(len(p), -1, dtype=np.int64)  # vertices, by place
    held[place[first]] = first
    from_ = np.full(len(p), first[0])
    done, sorted_at = 4, 4
    while len(queue):
        if done >= 2 * sorted_at:
            # Each point starts from the vertex before it on the curve.
            last = np.maximum.accumulate(np.where(held >= 0, np.arange(len(p)), -1))[place[queue]]
            from_[queue] = np.where(last >= 0, held[last], first[0])
            sorted_at = done
        q, queue = np.split(queue, [max(1, int(done * TRIED))])
        t = mesh.walk(q, mesh.of[from_[q]])
        corner = mesh.corners[t]
        from_[q] = np.where(corner[:, 0] < mesh.n, corner[:, 0], corner[:, 1])
        put = mesh.insert(q, t)
        held[place[q[put]]] = q[put]
        done += int(put.sum())
        queue = np.concatenate([q[~put], queue])
    rows = mesh.corners[: mesh.used]
    return rows[(rows[:, 0] >= 0) & (rows < mesh.n).all(1)]


def edges(points: np.ndarray) -> np.ndarray:
    """Pairs i < j of the triangulation."""
    t = tetrahedra(points)
    n = len(points)
    key = np.unique(np.concatenate([np.minimum(t[:, a], t[:, b]) * n + np.maximum(t[:, a], t[:, b]) for a in range(4) for b in range(a + 1, 4)]))
    return np.column_stack(np.divmod(key, n))


def _rim(p: np.ndarray, ways: int = 128) -> np.ndarray:
    """The points that may be corners of the convex hull: without those within the hull of the extremes in some directions."""
    way = np.random.default_rng(0).normal(size=(3, ways))
    along = (p - p.mean(0)) @ way
    ends = np.unique(np.concatenate([along.argmax(0), along.argmin(0)]))
    try:
        t = tetrahedra(p[ends])
    except DegenerateError:
        return p
    faces, times = np.unique(np.sort(np.concatenate([np.delete(t, k, 1) for k in range(4)]), 1), axis=0, return_counts=True)
    a, b, c = (p[ends[faces[times == 1, k]]] for k in range(3))
    normal = np.cross(b - a, c - a)
    middle = p[ends].mean(0)
    size = np.linalg.norm(normal, axis=1)
    normal *= np.where(np.einsum("ij,ij->i", normal, middle - a) > 0, -1.0, 1.0)[:, None]
    # A face too thin to have a direction keeps all points, and so does one that a point is near.
    slack = 1e-6 * size * np.abs(p - middle).max()
    depth = np.full(len(p), True)
    for k in range(0, len(normal), 64):
        depth &= ((p @ normal[k : k + 64].T - np.einsum("ij,ij->i", normal[k : k + 64], a[k : k + 64])) < -slack[k : k + 64]).all(1)
    return p[~depth]


def rim(points: np.ndarray) -> np.ndarray:
    """The points that may be corners of the convex hull; all, where they are few."""
    p = np.asarray(points, dtype=float)
    return _rim(p) if len(p) > 1000 else p


def volume(points: np.ndarray) -> float:
    """Of the convex hull."""
    p = rim(points)
    t = tetrahedra(p)
    a = p[t[:, 0]]
    return float(np.abs(np.einsum("ij,ij->i", p[t[:, 1]] - a, np.cross(p[t[:, 2]] - a, p[t[:, 3]] - a))).sum() / 6)
