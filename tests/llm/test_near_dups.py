"""The pipeline's near-dedup against all pairs, with copies planted at similarities of 0.8 to 0.95."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, golay, near_dups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


def test_one_of_each_group_stays(spark):
    r = random.Random(7)
    line = " ".join(f"common{i}" for i in range(15))
    texts = []
    for n, changes in itertools.product((60, 200, 600), (0.002, 0.004, 0.007, 0.01, 0.02)):
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(4):
            copy = list(words)
            for at in r.sample(range(n), max(1, round(changes * n))):
                copy[at] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(copy) + (" " + line if r.random() < 0.5 else ""))
    texts += ["a b", "A  b", "a c", "", None, line, "la la " * 50, "la la " * 80]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard((texts[i] or "").lower(), (texts[j] or "").lower()) >= 0.8:
            root = [min(root[i], root[j]) if k in (root[i], root[j]) else k for k in root]
    planted = sum(0.8 <= jaccard(texts[i], texts[j]) <= 0.95 for b in range(0, 60, 4) for i, j in itertools.combinations(range(b, b + 4), 2))
    assert planted >= 30
    rows = [(i, t, "en", "a.org", len(t or "")) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "a.org", 1), (0, "another text of the same id", "en", "a.org", 1), (None, "no id at all here", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    rows_kept = corpus_pipeline.dedup_near(spark, docs, "").collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows_kept)
    want = sorted([-1, 0, *set(root)])
    assert set(want) <= set(got) and len(got) == len(set(got)) + 1  # a document of each group stays, and the two other rows
    assert len(got) - len(want) <= 0.05 * (len(texts) - len(set(root)))  # of those to go, few are not found
    near = {j for i, j in itertools.combinations(range(len(texts)), 2) if jaccard((texts[i] or "").lower(), (texts[j] or "").lower()) >= 0.9}
    assert not near & set(got) - {0}
    assert corpus_pipeline.dedup_near(spark, docs.limit(0), "").count() == 0


def test_a_large_group_costs_few_comparisons(spark, monkeypatch):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(400):
        copy = list(base)
        copy[r.randrange(150)] = f"x{i}"
        texts.append(" ".join(copy))
    compared = []
    alike = near_dups._both

    def counted(pairs, values):
        compared.append(pairs.count())
        return alike(pairs, values)

    monkeypatch.setattr(near_dups, "_both", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dups.near_duplicates(docs).collect()
    assert sum(x["is_first"] for x in got) == 1 and {x["first_id"] for x in got} == {0}
    assert sum(compared) <= 8 * len(texts)


@pytest.mark.parametrize("n", [150, 600])
def test_pages_of_a_template_are_not_compared_in_pairs(spark, monkeypatch, n):
    """150 words of a template and 40 of their own: similarity 0.65, so keys are crowded and nothing is to be linked. A few pairs of similarity above 0.8 are."""
    r = random.Random(n)
    template = [f"t{i}" for i in range(150)]
    texts = [" ".join(template[:75] + [f"w{r.randrange(10**9)}" for _ in range(40)] + template[75:]) for _ in range(n)]
    twins = [texts[i] + " more" for i in range(0, n, 30)]
    compared = []
    both = near_dups._both

    def counted(pairs, values):
        compared.append(pairs.count())
        return both(pairs, values)

    monkeypatch.setattr(near_dups, "_both", counted)
    got = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts + twins)), "doc_id long, text string")).collect()
    first = {x["doc_id"]: x["first_id"] for x in got}
    assert [first[n + k] for k in range(len(twins))] == list(range(0, n, 30)) and all(first[i] == i for i in range(n))
    assert sum(compared) <= 30 * n  # with each turn's leaders, for both measures of likeness


def test_sketches_and_keys():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 255, 256, 5000, 70_000, 0, 510)]
    for own, got in zip(sets, near_dups.sketches(sets)):
        words = np.stack([near_dups.mixed(own, i) for i in range(-(-near_dups.PLACES // 64))], axis=1)
        ones = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : near_dups.PLACES].sum(axis=0, dtype=np.int64)
        margins = 2 * ones - len(own)
        assert np.array_equal(got, np.rint(margins * min(1, 127 / max(1, np.abs(margins).max()))))
    margins = r.normal(size=(50, 23))
    best = np.argsort(-(margins @ golay.codewords().T), axis=1)[:, :3]
    assert np.array_equal(golay.nearest(margins.astype(np.float32), 3), best)
    assert all(golay.remainder(int(w)) == 0 for w in ((golay.codewords() > 0) << np.arange(23)).sum(axis=1))
    assert near_dups.fuzzy_keys(near_dups.sketches(sets)).shape == (8, 91)


def test_rows_that_share_a_key_by_chance_go_no_further(spark, monkeypatch):
    """Of 2,500 unrelated texts some share a key by chance: more, the more texts there are. The copies with a few changed words stay."""
    r = random.Random(4)
    texts = [[f"w{r.randrange(10**7)}" for _ in range(40)] for _ in range(2500)]
    twins = [[*texts[i][:-1], "else"] for i in range(0, 2500, 100)]
    rows, save = {}, near_dups.common.save

    def noted(df, name):
        saved = save(df, name)
        rows.setdefault(name, saved.select("key").distinct().count() if name == "shared-keys" else None)
        return saved

    monkeypatch.setattr(near_dups.common, "save", noted)
    got = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(map(" ".join, texts + twins))), "doc_id long, text string")).where("NOT is_first").collect()
    assert {(x["doc_id"], x["first_id"]) for x in got} == {(2500 + i, 100 * i) for i in range(25)}
    assert 50 <= rows["shared-keys"] <= 55  # sets, of which 50 have a twin


def test_runs_of_a_key_over_batches():
    r = np.random.default_rng(5)
    sizes = [1, 2, 3, near_dups.MEETING, near_dups.MEETING + 1, 700, 1, 5, 2, 256, 1]
    s = np.repeat(np.arange(len(sizes)), sizes)
    n = r.integers(50, 80, len(s)).astype(np.int32)
    words = r.integers(-(2**63), 2**63 - 1, (len(s), 2))
    twin = r.random(len(s)) < 0.3
    words[1:][twin[1:]] = words[:-1][twin[1:]] ^ 7
    want = []
    for i in range(len(s)):
        near = [j for j in np.flatnonzero(s == s[i]) if j != i and sum(int(x).bit_count() for x in (words[i] ^ words[j]).view(np.uint64)) <= near_dups.APART and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])]
        if near or sizes[s[i]] > near_dups.MEETING:
            want.append(i)
    assert 0 < len(want) < len(s)
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (s, np.arange(len(s)), n, words[:, 0].copy(), words[:, 1].copy())], names=["s", "key", "n", "x", "y"])
    for rows in (1, 7, 256, 10_000):
        got = [k for b in near_dups._meeting(0.8)(whole.slice(i, rows) for i in range(0, len(s), rows)) for k in b["key"].to_pylist()]
        assert got == want
    assert list(near_dups._meeting(0.8)(iter([]))) == []


def test_signs_of_similar_sets_are_near():
    """Sets of similarity 0.8, of all sizes, differ in fewer signs than APART, whatever the key; strangers in more, nearly always."""
    r = np.random.default_rng(6)
    most, far = 0, []
    for n in (4, 5, 8, 9, 16, 45, 180, 900):
        for _ in range(40):
            own = r.integers(0, 2**63, 2 * n).astype(np.uint64)
            fresh = n // 9 if n >= 9 else 0  # 8 of 9 are common to both, or one set has n / 4 more
            a, b = (own[:n], np.concatenate([own[fresh:n], own[n : n + fresh]])) if fresh else (own[:n], own[: n + n // 4])
            signs = near_dups.other_signs(near_dups.sketches([np.sort(a), np.sort(b), np.sort(own[n:])])).view(np.uint64)
            most = max(most, int(np.bitwise_count(signs[0] ^ signs[1]).sum(axis=1).max()))
            if n >= 45:
                far.append(np.bitwise_count(signs[0] ^ near_dups.other_signs(near_dups.sketches([r.integers(0, 2**63, n).astype(np.uint64)])).view(np.uint64)[0]).sum(axis=1))
    assert most <= near_dups.APART and np.mean(np.concatenate(far) <= near_dups.APART) < 0.03


@pytest.mark.parametrize("coalesced", [True, False])
def test_components_are_found_in_few_rounds(spark, monkeypatch, coalesced):
    r = random.Random(8)
    chain = [(i, i + 1) for i in range(200)]
    edges = chain + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(140)] + [(-5, 5000), (7000, -5), (9, 9), (9000, 9000)]
    root = {}
    for x in {x for a, b in edges if a != b for x in (a, b)}:
        root[x] = x
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    written, save = [], components.common.save
    monkeypatch.setattr(components.common, "save", lambda df, name: written.append(name) or save(df, name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(coalesced).lower())
    try:
        got = components.components(spark.createDataFrame(r.sample(edges, len(edges)), "a long, b long").repartition(7)).collect()
        assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(root) and {x["node"]: x["root"] for x in got} == root
    assert len(written) == 2 or not coalesced  # one for each call


@pytest.mark.parametrize("fanout", [1000, 3])
def test_queries_are_few_and_small(spark, monkeypatch, fanout):
    """However small the table, the driver plans a query anew whenever one of its shuffles ends: its memory goes with their number. With busy sets, too, groups are the same."""
    r = random.Random(5)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(120)] for _ in range(40)]
    twins = [[*texts[i % 4][: i + 1], "else", *texts[i % 4][i + 2 :]] for i in range(48)]
    shuffles, save = {}, near_dups.common.save

    def noted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles.setdefault(name, []).append(plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange"))
        return save(df, name)

    monkeypatch.setattr(near_dups.common, "save", noted)
    monkeypatch.setattr(near_dups, "FANOUT", fanout)
    got = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(map(" ".join, texts + twins))), "doc_id long, text string")).where("NOT is_first").collect()
    assert {(x["doc_id"], x["first_id"]) for x in got} == {(40 + i, i % 4) for i in range(48)}
    assert ("busy-sets" in shuffles) == (fanout == 3)
    assert fanout == 3 or max(sum(shuffles[name]) / len(shuffles[name]) for name in ("alike-pairs", "similar-pairs")) <= 4
    assert fanout == 3 or sum(map(sum, shuffles.values())) <= 60, shuffles


def test_values_of_both_sides_whatever_the_fanout(spark, monkeypatch):
    pairs = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(1, 2), (5, 29), (3, 29)], "a long, b long").repartition(5)
    values = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "key long, value string").repartition(3)
    want = sorted((p["a"], p["b"], f"v{p['a']}", f"v{p['b']}") for p in pairs.collect())
    for fanout in (1000, 29, 2, 1):
        monkeypatch.setattr(near_dups, "FANOUT", fanout)
        assert sorted(map(tuple, near_dups._both(pairs, values).collect())) == want
