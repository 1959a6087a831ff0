"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, cutting_stock, exact_topk, golay, lang_id, license_scan, line_dedup, packing, quality, simhash, token_shards, vectors

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", "naïve  Café\n\n\tthere's 12,5 <|endoftext|> 中文 x", "x" * 3000, "la la la " * 2000, "same", "same", "tab\tand\r\nline"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "a.example.org", len(t or "")) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "second row of an id", "en", "b.org", 1)], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_the_librarys(docs, none):
    library = Tokenizer.from_file(WORD)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    want = sorted((d if d is not None else -1, *digest(library, t)) for d, t in texts)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, WORD).collect())
    assert got == want
    assert bpe.digests(none, WORD).count() == 0


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shards_round_trip(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(BYTE)
    manifest = token_shards.write_shards(docs, BYTE, 0, "file://" + str(tmp_path), shard_bytes=5000)
    want, start = [], 0
    in_order = docs.orderBy("doc_id", F.xxhash64("text")).collect()  # null first
    for doc_id, text in ((r["doc_id"], r["text"]) for r in in_order):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_shards.read_shards(manifest).orderBy("start").collect()]
    assert got == want
    found = token_shards.lookup(manifest, spark.createDataFrame([(6,), (3,), (99,), (None,), (3,)], "doc_id long")).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in found) == [(False, 0), (True, 3), (True, 3), (True, 6)]
    assert {tuple(r["ids"]) for r in found if r["doc_id"] == 6} == {(*library.encode("same", add_special_tokens=False).ids, 0)}
    many = spark.createDataFrame([(7, "word " * i) for i in range(300)], "doc_id long, text string")
    one_id = token_shards.write_shards(many, BYTE, 0, "file://" + str(tmp_path / "many"), shard_bytes=20_000)
    assert one_id.count() > 3 and token_shards.read_shards(one_id).count() == 300
    assert token_shards.lookup(one_id, spark.createDataFrame([(7,)], "doc_id long")).count() == 300
    assert token_shards.read_shards(token_shards.write_shards(none, BYTE, 0, "file://" + str(tmp_path / "none"))).count() == 0


def test_packing_holds_every_id_once(docs, none):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(docs, WORD, 1, capacity=64).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert got == want
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in g:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    assert packing.pack(none, WORD, 1).count() == 0


def test_packing_of_whole_sequences(spark):
    """The real capacity: each document's pieces tile it, their checksums are those of its ids, sequences have no gaps."""
    r = random.Random(4)
    texts = ["word " * n for n in (0, 1, 2046, 2047, 2048, 4095, 5000, 20_000)] + [" ".join(r.choice(["some", "other", "words", "hereabouts"]) for _ in range(r.randrange(1, 4000))) for _ in range(60)]
    library = Tokenizer.from_file(WORD)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD, 1).collect()
    for i, own in ids.items():
        at = 0
        for p in sorted((p for p in rows if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(np.array(own[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(own)
    used = {}
    for p in rows:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert sorted(used) == list(range(len(used))) and sum(map(len, ids.values())) / (2048 * len(used)) > 0.93


def test_the_linear_program_decides(monkeypatch):
    """Sizes of which greedy patterns waste much: columns are generated until the program is within GAP of a proven bound, here that of all patterns."""
    sizes, demand, capacity = np.array([26, 34, 35, 45, 51]), np.array([97.0, 610.0, 395.0, 211.0, 301.0]), 100
    calls = []
    plain = cutting_stock.best_pattern
    monkeypatch.setattr(cutting_stock, "best_pattern", lambda *a: calls.append(1) or plain(*a))
    found = cutting_stock.patterns(sizes, demand, capacity)
    assert len(calls) >= 3 and all(sizes @ p <= capacity for p, _ in found) and np.allclose(sum(p * n for p, n in found), demand)
    start, bins = cutting_stock.first_patterns(sizes, demand, capacity)
    assert sum(n for _, n in found) < bins.sum() - 1  # the start is improved on
    # all patterns of a hundred places, and dual prices that prove the value: none of them is worth more than a bin
    every = [p for p in itertools.product(*(range(capacity // s + 1) for s in sizes)) if 0 < np.dot(p, sizes) <= capacity]
    worth = np.linalg.lstsq(np.array([p for p, n in found if n > 1e-9]), np.ones(sum(n > 1e-9 for _, n in found)), rcond=None)[0]
    scale = max(1.0, max(np.dot(p, worth) for p in every))
    assert sum(n for _, n in found) <= worth @ demand / scale * (1 + cutting_stock.GAP) + 1e-6 or sum(n for _, n in found) <= np.ceil(worth @ demand / scale)


def least_bins(histogram, capacity):
    """A lower bound that counts what large pieces leave free."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for s, n in histogram.items() if s > capacity - k)
        large = sum(n for s, n in histogram.items() if capacity / 2 < s <= capacity - k)
        room = sum(n * (capacity - s) for s, n in histogram.items() if capacity / 2 < s <= capacity - k)
        small = sum(n * s for s, n in histogram.items() if k <= s <= capacity / 2)
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def test_cutting_stock_is_near_the_bound():
    r = random.Random(0)
    histogram = {r.randrange(1, 128): r.randrange(1, 500) for _ in range(60)}
    ranges, bins = cutting_stock.plan(histogram, 128)
    assert bins <= 1.01 * least_bins(histogram, 128) + len(histogram)  # patterns are rounded
    for size, n in histogram.items():
        taken = sorted((first, pieces) for s, first, pieces, _, _ in ranges if s == size)
        assert sum(p for _, p in taken) == n and all(a + p == b for (a, p), (b, _) in zip(taken, taken[1:]))


def test_golay_keys_meet_at_one_error():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 300)
    for bit in range(23):
        for a, b in zip(golay.keys(words), golay.keys(words ^ (1 << bit))):
            assert set(a[a >= 0].tolist()) & set(b[b >= 0].tolist())


def test_simhash_links_are_those_of_all_pairs(spark, docs, none):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 20)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 63, (12, 2))]
    fps = sorted({*map(int, base), *near})
    found = {tuple(sorted(x)) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    every = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    assert found <= every and groups(fps, found) == groups(fps, every)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs.where("doc_id <> 3")).collect()}
    assert rows[7]["component_id"] == 6 and rows[0]["fingerprint"] == "0" * 16 and rows[1]["component_id"] == 0
    assert rows[6]["fingerprint"] == f"{xxhash.xxh64_intdigest(b'same', 42):016x}"
    assert simhash.near_duplicates(none).count() == 0


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    return {frozenset(n for n in nodes if find(n) == k) for k in map(find, nodes)}


def test_line_dedup_deletes_later_runs(spark, none):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(14)) for i in range(6))
    rows = [(1, "own line one\n" + passage + "\nend a"), (2, "another\n" + passage), (3, None), (4, ""), (5, "another\nshort repeat")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "another" and got[2]["n_removed"] == 6
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["n_removed"] == 0
    assert line_dedup.dedup_lines(none).columns == [*none.columns, "n_removed"]


def test_license_bounds_and_scores(spark, docs, none):
    text = license_scan.TEMPLATES[5][1]
    found = license_scan.scan(spark.createDataFrame([(1, text), (2, "all rights"), (3, "All  rights, reserved!")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"], r["dice"]) for r in found} == {(1, "MIT", 1.0), (3, "all-rights-reserved", 1.0)}
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(none).count() == 0


def some_vectors(spark, n):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(n, 16)))]
    rows += [(n, None), (n + 1, [float("nan")] * 16), (n + 2, [0.0] * 16), (n + 3, rows[0][1]), (None, rows[1][1])]
    return vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def test_exact_top_k(spark):
    rows = some_vectors(spark, 300)
    table = {r["id"]: [np.floor(256 * x) for x in r["v"]] for r in rows.collect()}
    got = {}
    for r in exact_topk.exact_top_k(rows.where("id % 50 = 0"), rows, 5, 256.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (i for i in table if i % 50 == 0):
        best = sorted((-int(np.dot(table[q], v)), i) for i, v in table.items() if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_updates_of_the_regularised_leader():
    """Example after example, weight after weight."""
    r = np.random.default_rng(3)
    examples = []
    for _ in range(60):
        places = np.sort(r.choice(quality.PLACES, 6, replace=False)).astype(np.int32) if r.random() < 0.5 else np.sort(r.choice(12, 6, replace=False)).astype(np.int32)
        examples.append((places, r.random(6).astype(np.float32), int(r.random() < 0.5)))
    z, n = {}, {}

    def weight(i):
        own, seen = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(own) <= quality.L1 else -(own - math.copysign(quality.L1, own)) / ((quality.BETA + math.sqrt(seen)) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for places, values, label in examples:
            row = [*zip(places.tolist(), map(float, values)), (quality.PLACES, 1.0)]
            w = {i: weight(i) for i, _ in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row)))
            for i, x in row:
                g = (p - label) * x
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.train(examples, 2)
    assert np.flatnonzero(got).size and all(got[i] == pytest.approx(weight(i), rel=1e-4, abs=1e-6) for i in [*range(12), *z, quality.PLACES])
    assert set(np.flatnonzero(got).tolist()) <= set(z)


def test_labels_of_other_documents_use_up_no_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda examples: seen.append(len(examples)) or np.zeros(quality.PLACES + 1, np.float32))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    for own in (labels.where("doc_id < 200"), labels):
        quality.fit(docs, own, sample=300)
    assert seen[0] == seen[1] > 140


def test_quality_learns_and_scores_all(spark, docs, none):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(200)], "doc_id long, quality int")
    texts = spark.createDataFrame([(i, "A fine sentence about rivers." if i % 2 else "click 555 !!! buy $$$ 999") for i in range(200)], "doc_id long, text string")
    weights = quality.fit(texts, labels)
    scored = quality.with_score(texts.where(quality.held_out(F.col("doc_id"))), weights).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in scored)
    assert quality.with_score(docs, weights).where("score IS NULL OR NOT score BETWEEN 0 AND 1").count() == 0
    assert quality.with_score(none, weights).count() == 0
    assert set(quality.fit(texts, labels.where("doc_id < 0")).tolist()) == {0.0}


def test_language_by_text_despite_declaration(spark, none):
    words = {"en": "the water and house with people there ", "de": "das wasser und haus mit leuten dort "}
    rows = [(i, words[lang] * 9, lang, f"{lang}.example.{lang}") for i, lang in enumerate(["en", "de"] * 40)] + [(100, words["de"] * 9, None, None), (101, "", "en", "x.org"), (102, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in lang_id.identify(df, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert got[100]["lang_id"] == "de" and got[100]["lang_kept"] and not got[101]["lang_kept"] and got[102]["lang_id"] is None
    assert all(got[i]["lang_id"] == rows[i][2] for i in range(80))
    assert lang_id.identify(none, "doc_id", F.col("text"), F.col("lang"), F.col("source")).count() == 0
