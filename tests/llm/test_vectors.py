import numpy as np
import pytest
from starweave.llm import cover_tree, queries


def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(6, 16))
        for k in range(150):
            v = rng.normal(size=16) if k % 3 else centres[k % 6] + rng.normal(size=16) * 0.12
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    rows += [(1000 + k, [float(x) * (k + 1) for x in rows[3][1]], 0) for k in range(40)]  # one direction, many lengths
    rows += [(1100 + k, rows[5][1], 0) for k in range(30)] + [(1100, rows[5][1], 0)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [1.0, None] * 8, 1), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [], 0), (2008, [float("inf")] + [1.0] * 15, 0)]
    return rows


def expected(rows, least=0.98):
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, parent = [0] * len(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=np.float64), np.array(rows[b][1], dtype=np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    n[a] += 1
                    n[b] += 1
                    p, q = find(rows[a][0]), find(rows[b][0])
                    parent[max(p, q)] = min(p, q)
    return sorted((r[0], n[k], find(r[0]), r[0] == find(r[0])) for k, r in enumerate(rows))


@pytest.mark.parametrize(("cell", "fan"), [(2048, 32), (25, 32), (12, 3)])
def test_links_and_components(spark, cell, fan):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    got = sorted(tuple(r) for r in cover_tree.near_links(df, 0.98, cell, fan).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == expected(rows)


def test_levels_nest_and_cover():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(200, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    for centres, members, radius in cover_tree.build(u):
        assert sorted(np.concatenate(members).tolist()) == list(range(200))
        for c, m in zip(centres, members):
            assert (np.linalg.norm(u[m] - u[c], axis=1) <= radius + 1e-9).all()


def test_registered(spark, sf_dir):
    assert "op10_cover_tree" in queries.QUERIES
