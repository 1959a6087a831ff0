"""Document fingerprints: bins and borrowing against a plain version, likeness against Jaccard, successors against a plain loop."""

import hashlib

import numpy as np
import pytest

from tessera.llm import fingerprints
from tessera.llm.near_dups import shingles

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, t int, part string, only int, before int"


def plain_minima(hashes):
    bins = fingerprints.BINS
    held = [min((h for h in hashes if h >> (64 - bins.bit_length() + 1) == b), default=None) for b in range(bins)]
    out = []
    for b in range(bins):
        asks = sorted(range(bins), key=lambda j: fingerprints.TURN[b, j])
        out.append(held[b] if held[b] is not None else next(held[j] for j in asks if held[j] is not None))
    return out


@pytest.mark.parametrize("n", [1, 2, 30, 700, 5000])
def test_minima_and_borrowing(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    assert fingerprints.minima(hashes).tolist() == plain_minima(hashes.tolist())
    assert all(sorted(row) == list(range(fingerprints.BINS)) for row in fingerprints.TURN.tolist())


def jaccard(a, b):
    a, b = set(shingles(a).tolist()), set(shingles(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("words", [60, 400, 6000])
def test_likeness_is_unbiased(words):
    r = np.random.default_rng(words)
    off, far = [], []
    for trial in range(60):
        a = [f"w{x}" for x in r.integers(0, 10**6, words)]
        b = a[: int(words * r.random())] + [f"v{x}" for x in r.integers(0, 10**6, words // 2)]
        x, y = " ".join(a), " ".join(b)
        off.append(fingerprints.likeness(fingerprints.packed(x), fingerprints.packed(y)) - jaccard(x, y))
        far.append(fingerprints.likeness(fingerprints.packed(x), fingerprints.packed(" ".join(f"u{i}{trial}" for i in range(words)))))
    size = min(words, fingerprints.BINS)
    assert abs(np.mean(off)) < 4 * 0.5 / (size * 60) ** 0.5 and np.std(off) < 2 * 0.5 / size**0.5
    assert np.mean(far) < 0.03
    assert fingerprints.likeness(fingerprints.packed("one"), fingerprints.packed("two")) < 0.15  # borrowed bins agree by chance, each anew


def plain(docs):
    """Distinct (doc_id, text) in order, each followed by the next."""
    mark = lambda t: fingerprints.packed(t)
    rows = {}
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        rows[d, t] = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark(t).hex(), mark(edited).hex(), fingerprints.likeness(mark(t), mark(edited)), fingerprints.likeness(mark(t), mark(after)))
    return rows


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("size", [1 << 25, 3000, 300])
def test_successors_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "PART_CHARS", size)
    r = np.random.default_rng(1)
    docs = [(int(i), " ".join(r.choice(["alpha", "béta", "中文", "γ δ", "x"], r.integers(0, 80)))) for i in r.permutation(np.arange(-20, 100))]
    docs += [(1000, None), (1001, "word " * 20_000), (None, "no id"), (None, "no id either"), (5, "same id"), (6, "twice"), (6, "twice")]
    df = spark.createDataFrame([(d, t, 1, "p", 2, 3) for d, t in docs], SCHEMA).repartition(4)
    got = ordered(map(tuple, fingerprints.edited_fingerprints(df).collect()))
    hashed = {(x["doc_id"], x["text"]): x["h"] for x in df.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    want = plain(sorted(hashed, key=lambda k: (k[0] is not None, k[0] or 0, hashed[k])))
    assert got == ordered(want[d, t or ""] for d, t in docs)


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fingerprints.edited_fingerprints(none).count() == 0 and fingerprints.fingerprints(none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g", 0, "", 0, 0)], SCHEMA)
    assert [tuple(x) for x in fingerprints.edited_fingerprints(one).collect()] == list(plain([(1, "a b c d e f g")]).values())
    assert fingerprints.fingerprints(one).first()["fingerprint"] == fingerprints.packed("a b c d e f g").hex()


def test_the_query(spark):
    docs = sorted((x["doc_id"], x["text"]) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = fingerprints.op13_fingerprints(spark, DATA)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert ordered(map(tuple, got.collect())) == ordered(plain([(d, t or "") for d, t in docs]).values())
