"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import importance

DATA = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score string, rank int, late int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def feats(text, most):
    w = WORDS.findall(lower(text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent, seed, most, buckets):
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in feats(t, most)[1]]
    count = lambda texts: np.bincount(np.array([b for t in texts for b in of(t)], int), minlength=buckets)
    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.sum() + buckets) / ((s[i] + 1) * (t.sum() + buckets)))) for i in range(buckets)]
    rows, able = [], []
    for d, x in docs:
        b, words = of(x), feats(x, most)[0]
        weight = sum(gain[i] for i in b) // len(b) if b else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(b), weight, score))
        if words >= 20:
            able.append((d, len(b), weight, score))
    drawn = sorted((x for x in able if x[3] is not None), key=lambda x: (-x[3], x[0], x[1], x[2]))[: percent * len(able) // 100]
    ranks = {}
    for i, x in enumerate(drawn):
        ranks.setdefault(x, []).append(i + 1)
    out = []
    for x in rows:
        some = ranks.get(x)
        out.append((*x, some.pop(0) if some and x in able else None))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])


@pytest.mark.parametrize("most,percent", [(1, 10), (3, 50)])
def test_against_plain(spark, most, percent):
    r = np.random.default_rng(most)
    vocabulary = ["The", "naïve", "cat", "sat", "ÉCOLE", "école", "x1", "中文", "it's", "a-b", "Q"]
    docs = [(i, " ".join(r.choice(vocabulary, r.integers(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " \n\t"), (None, "no id " * 30), (7, "again " * 40), (7, "again " * 40), (503, "LONG Word " * 5000)]
    target = ["the cat sat", None, "école naïve " * 4]
    df = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs], SCHEMA).repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 2024, most, 97)
    want = plain(docs, target, percent, 2024, most, 97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(map(tuple, got.collect())) == ordered(want)


def test_slices_and_empty_tables(spark, monkeypatch):
    text = "Ab1 çé  " * 300 + "x" * 5000 + " end"
    whole = importance.features(text.encode(), 2, 1000)
    monkeypatch.setattr(importance, "SLICE", 37)
    cut = importance.features(text.encode(), 2, 1000)
    assert whole[0] == cut[0] and sorted(whole[1]) == sorted(cut[1])
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "one two " * 20, "", 1, 1)], SCHEMA)
    assert importance.resample(none, some, 10, 1).count() == 0
    assert [tuple(r) for r in importance.resample(some, none, 100, 2024).collect()] == plain([(1, "one two " * 20)], [], 100, 2024, 1, importance.BUCKETS)


def test_the_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert ordered(map(tuple, importance.op12_importance(spark, DATA).collect())) == ordered(plain(docs, target, 10, 2024, 1, 10_000))
