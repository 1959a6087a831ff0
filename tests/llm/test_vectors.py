"""Searches over vectors against brute force: recall, scores, odd vectors, ties and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, exact_topk, vectors

K = 20


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def usable(df):
    return vectors.usable(df).where(F.exists("v", lambda x: x != 0))


def shapes(name):
    r = np.random.default_rng(3)
    if name == "plain":
        return r.normal(size=(4000, 16))
    if name == "clustered":
        return r.normal(size=(60, 32))[r.integers(0, 60, 4000)] + 0.3 * r.normal(size=(4000, 32))
    v = r.normal(size=(3000, 16))
    v[r.permutation(3000)[:200]] *= 1000  # long ones are neighbours of nearly all
    return v


@pytest.mark.parametrize("name", ["plain", "clustered", "long"])
def test_recall_scores_and_work(spark, name):
    rows = usable(frame(spark, shapes(name))).cache()
    table = {r["id"]: np.array(r["v"]) for r in rows.collect()}
    ids, x = np.array(list(table)), np.stack(list(table.values()))
    index = ann.fit(rows, K)
    queries = rows.where("id % 20 = 0")
    got = {}
    for r in ann.search(queries, rows, K, index).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in table if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [rank for rank, _, _ in found] == list(range(1, K + 1)) and len({v for _, v, _ in found}) == K and q not in {v for _, v, _ in found}
        assert all(abs(s - float((table[q] * table[v]).sum())) <= 1e-9 * abs(s) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        scores = x @ table[q]
        scores[ids == q] = -np.inf
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-scores)[:K]].tolist()))
    assert hits / (K * len(got)) >= 0.9
    share = ann.work(queries, rows, index) / (len(got) * len(table))
    assert share < {"plain": 0.6, "clustered": 0.15, "long": 0.15}[name]


def test_small_tables_are_searched_whole(spark):
    v = np.random.default_rng(1).normal(size=(12, 8))
    rows = usable(frame(spark, v))
    got = ann.search(rows.where("id % 20 = 0"), rows, K, ann.fit(rows, K)).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(1, 12)) and sorted(r["rank"] for r in got) == list(range(1, 12))
    alone = usable(frame(spark, v[:1]))
    assert ann.search(alone, alone, K, ann.fit(alone, K)).count() == 0
    assert ann.fit(rows.limit(0), K) is None


def test_ties_repeated_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), *((i, [1.0, 0.0]) for i in range(1, 40)), (40, [0.5]), (40, [0.5]), (41, None), (42, [float("inf"), 0.0]), (43, [None, 1.0]), (44, [0.0, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, row int, list string")
    good = usable(df)
    got = ann.search(good.where("id = 0"), good, K, ann.fit(good, K)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and {r["score"] for r in got} == {1.0}
    exact = exact_topk.exact_top_k(vectors.usable(df).where("id = 40"), vectors.usable(df), 5, 256.0).collect()
    assert len(exact) == 10 and {(r["vec_id"], r["score"]) for r in exact} == {(i, 128 * 256) for i in range(5)}  # a query for each row
    last = exact_topk.exact_top_k(vectors.usable(df).where("id = 0"), vectors.usable(df), 50, 256.0).orderBy("rank").collect()
    assert [r["vec_id"] for r in last] == [*range(1, 40), 40, 40, 44]
    assert exact_topk.exact_top_k(good.limit(0), good, 5).count() == 0 and exact_topk.exact_top_k(good, good.limit(0), 5).count() == 0
