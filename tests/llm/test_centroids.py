"""Ball-tree clustering against exhaustive assignment, in whole numbers."""

import hashlib

import duckdb
import numpy as np
import pytest

from tessera.llm import centroids

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def plain(rows, k, rounds, scale, width):
    """rows: (id, components); ids ascending by hash start, ties by components."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    z = [list(v) for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(z))[::-1]
    for _ in range(rounds):
        at = [near(v)[0] for _, v in kept]
        for j in range(len(z)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            z[j] = [sum(x) // len(own) for x in zip(*own)] if own else z[j]
    found = [(i, *near(v)) for i, v in kept]
    inertia = lambda j=None: sum(d for _, c, d in found if j in (None, c))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted(((-1 if i is None else i), c, d, inertia(c), inertia(), sha[c]) for i, c, d in found)


def run(df, k, rounds, scale, width):
    got = centroids.cluster(df, k, rounds, scale, width).collect()
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], *r[1:]) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_and_ties(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(120)]  # many ties and repeated vectors
    rows += [(3, [0.0, 1.0, 1.0, 0.0]), (3, [0.0, 1.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (200, None), (201, [1.0]), (202, [float("nan")] * 4), (203, [None, 1.0, 1.0, 1.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA).repartition(3)
    assert run(df, 7, 3, 1.5, 4) == plain(rows, 7, 3, 1.5, 4)
    few = [(i, v) for i, v in rows if i in (5, 6, 7, None)]
    assert run(spark.createDataFrame([(*x, "c", 1) for x in few], SCHEMA), 7, 2, 1.0, 4) == plain(few, 7, 2, 1.0, 4)  # fewer vectors than centroids
    assert centroids.cluster(df.limit(0), 7, 3, 1.0, 4).count() == 0


def test_large_numbers_are_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=4) * 1e9).tolist()) for i in range(90)]
    want = plain(rows, 5, 3, 1.0, 4)
    most = (1 << 63) - 1
    got = run(spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA), 5, 3, 1.0, 4)
    assert got == [(i, c, min(d, most), min(a, most), min(b, most), s) for i, c, d, a, b, s in want]


def test_blocks_and_whole_balls(spark, monkeypatch):
    r = np.random.default_rng(7)
    middles = 40 * r.normal(size=(9, 8))
    x = middles[r.integers(0, 9, 3000)] + r.normal(size=(3000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(centroids, "BLOCK", 500)
    df = spark.createDataFrame([(*v, "c", 1) for v in rows], SCHEMA).repartition(2)
    assert run(df, 9, 3, 64.0, 8) == plain(rows, 9, 3, 64.0, 8)
    id_v = df.selectExpr("vec_id AS id", "embedding AS v")
    z = np.floor(64 * middles).astype(np.int64)
    held = centroids.trees(id_v, 64.0, 8)
    assert held.count() >= 6 and all(len(t["ids"]) <= 500 for t in held.select("ids").collect())
    per = centroids.sums(held, z).collect()
    assert sum(p["n"] for p in per) == 3000 and sum(p["work"] for p in per) < 0.1 * 3000 * 9  # whole balls


def test_tree_sums_radii_and_children():
    points = np.random.default_rng(0).integers(-50, 50, (300, 5))
    tree, order = centroids.Tree.over(points)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(300))
    for f, t, r, s, c in zip(tree.first, tree.last, tree.radius, tree.sum, tree.child):
        own = tree.points[f:t]
        assert (own.sum(axis=0) == s).all() and np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1)).max() == pytest.approx(r)
        if c:
            assert tree.first[c] == f and tree.last[c] == tree.first[c + 1] and tree.last[c + 1] == t
        else:
            assert t - f <= centroids.LEAF


def test_the_query_and_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = centroids.op11_centroids(spark, DATA)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(centroids.OP11_SQL).fetchall())
