"""Operators on texts against plain versions of themselves, and on rows with odd ids, columns and texts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, lang_id, line_dedup, quality, simhash

DATA = "/root/testdata/sf0.01"


def fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_bit_by_bit():
    r = random.Random(1)
    texts = ["", "a", "A b", "one two three four", "ÀÉ Straße x ẞ", "tab\tvt\x0bff\x0ccr\rlf\n x", "w " * 10_000]
    texts += [" ".join(r.choice(["Aa", "b", "ccc", "é", "D"]) for _ in range(r.randrange(1, 40))) for _ in range(200)]
    for t in [None, *texts]:
        assert simhash.fingerprint(t) == fingerprint(t)
    assert simhash.fingerprint(texts[-1]) == simhash.fingerprint(texts[-1] + "")


def plain_runs(docs, least=50):
    """For each document the lines of all maximal common runs of so many words that are at an earlier place too."""
    lines = [(d, p, x.strip(" ")) for d, t in docs for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    gone = {}
    for j in range(len(lines)):
        for i in range(j):
            same = lambda k: i + k >= 0 and j + k < len(lines) and lines[i + k][2] == lines[j + k][2] and lines[i + k][0] == lines[i][0] and lines[j + k][0] == lines[j][0]  # noqa: E731, B023
            if not same(0) or same(-1):
                continue
            n = 1
            while same(n):
                n += 1
            if sum(lines[j + k][2].count(" ") + 1 for k in range(n)) >= least:
                gone.setdefault(lines[j][0], set()).update(range(lines[j][1], lines[j + n - 1][1] + 1))
    return gone


def test_all_later_runs_go_and_nothing_else(spark):
    r = random.Random(4)
    pool = [" ".join(f"w{i}x{k}" for k in range(r.choice([1, 3, 8, 13, 24, 49, 55]))) for i in range(25)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randrange(1, 8)):
            at = r.randrange(25)
            lines += r.choice([[r.choice(pool)], pool[at : at + r.randrange(1, 7)], ["", "  "], [f"own {d} line"], ["footer " + "z " * 13]])
        docs.append((d, "\n".join(lines)))
    gone = plain_runs(docs)
    assert len(gone) > 20
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        want = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(d, ()))
        assert (got[d]["text"], got[d]["n_removed"]) == (want, len(gone.get(d, ())))


def test_line_dedup_of_odd_rows(spark):
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(3))
    rows = [(1, run, 7, "a", 5), (1, run, 8, "b", 6), (2, run + "\nmore", 9, "c", 7), (None, "head\n" + run, 1, "d", 8), (3, None, 2, "e", 9), (4, "long " * 300_000, 3, "f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, t string, d int")
    got = {r["t"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert line_dedup.dedup_lines(df).columns == ["doc_id", "text", "t", "d", "n_removed"]
    assert got["d"]["n_removed"] == 0 and got["a"]["n_removed"] == got["b"]["n_removed"] == 3 and got["c"]["text"] == "more"
    assert got["e"]["text"] is None and got["f"]["text"] == rows[5][1] and got["b"]["d"] == 6


def test_scores_are_the_sparse_dot_product():
    r = np.random.default_rng(0)
    weights = r.normal(size=quality.PLACES + 1).astype(np.float32)
    texts = ["", "One two  two\nthree's 45,6", "x", "The THE the 12 12", None, "a b " * 500]
    got = quality.scores(pa.array(texts, pa.string()), weights)
    for i, text in enumerate(texts):
        total = float(weights[-1])
        for places, at in quality.features(pa.array([text], pa.string())):
            counts = Counter(places.tolist())
            total += sum(float(weights[p]) * n for p, n in counts.items()) / max(1, at[1])
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9
        assert quality.scores(pa.array([text], pa.string()), weights)[0] == got[i]  # whatever stands beside it


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.with_score(docs, quality.fit(docs, labels)).where(quality.held_out(F.col("doc_id"))).join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95


def test_quality_of_repeated_ids_and_clashing_columns(spark):
    rows = [(i % 50, f"text {'good' if i % 2 else '###'} {i}", i, "x", 0.25) for i in range(400)] + [(None, None, 1, "y", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, label string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    weights = quality.fit(df, labels, sample=30)
    got = quality.with_score(df, weights)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 401
    assert got.where("score = 0.25").count() == 0
    assert np.array_equal(weights, quality.fit(df.repartition(7), labels, sample=30))


WORDS = {"en": "the water and house with people there ", "de": "das wasser und haus mit leuten dort ", "xq": "zog vuxi kapo trin besk "}


def languages(spark):
    rows = [(i, WORDS[lang] * 9, declared, f"{lang}.example.{lang}") for i, (lang, declared) in enumerate([("en", "en"), ("de", "de-AT")] * 200)]
    rows += [(500, WORDS["xq"] * 9, "xq", None), (501, WORDS["xq"] * 5, None, None), (502, "ß", "de", "de.example.de"), (503, "", "en", "x.org"), (504, None, "en", None), (505, WORDS["de"] * 9, "klingon!", "a.b.")]
    return spark.createDataFrame([(*r, 1, "h", 0.5) for r in rows], "doc_id long, text string, lang string, source string, lang_id int, host string, row double")


def test_rare_languages_and_odd_rows(spark):
    df = languages(spark)
    out = lang_id.identify(df, "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    assert out.columns == ["doc_id", "text", "lang", "source", "host", "row", "lang_id", "lang_posterior", "lang_kept"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == df.count()
    assert got[500]["lang_id"] == got[501]["lang_id"] == "xq" and got[500]["lang_kept"]  # one document in 400 declares it
    assert got[502]["lang_id"] == "de" and got[505]["lang_id"] == "de" and got[0]["host"] == "h"
    assert got[503]["lang_id"] is None and not got[503]["lang_kept"] and got[504]["lang_id"] is None
    assert all(got[i]["lang_id"] == ("de" if i % 2 else "en") for i in range(400))
    none = lang_id.identify(df.limit(0), "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    assert none.count() == 0 and none.columns == out.columns
    undeclared = lang_id.identify(df.withColumn("lang", F.lit(None).cast("string")), "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    assert undeclared.where("lang_id IS NOT NULL OR lang_kept").count() == 0


def plain_posteriors(rows):
    """The fusion in plain Python: multinomials of trigrams, what languages declare, and host, suffix and whole smoothed by counts."""
    grams = lambda t: lang_id.trigrams(pa.array([t]))[0].tolist()
    named = lambda d: d.split("-")[0] if d and d.split("-")[0].isalpha() and 2 <= len(d.split("-")[0]) <= 3 else None
    langs = sorted({named(d) for _, _, d, _ in rows} - {None})
    counts = {k: Counter() for k in langs}
    for _, t, d, _ in rows:
        if named(d):
            counts[named(d)].update(grams(t or ""))
    places = 1 << lang_id.BITS
    log = lambda k, g: math.log((counts[k][g] + 0.5) / (counts[k].total() + 0.5 * places))

    def fused(t, prior):
        g = grams(t or "")
        if not g:
            return None
        at = [sum(log(k, x) for x in g) / len(g) * min(len(g), lang_id.TEMPER) + p for k, p in zip(langs, prior)]
        e = [math.exp(x - max(at)) for x in at]
        return [x / sum(e) for x in e]

    text = [fused(t, [0.0] * len(langs)) or [0.0] * len(langs) for _, t, _, _ in rows]
    suffix = [h.rpartition(".")[2] if h and h.rpartition(".")[2].isalpha() else "" for *_, h in rows]
    says = [named(d) or ("?" if d else None) for _, _, d, _ in rows]
    add = lambda keep: [sum(p[i] for p, k in zip(text, keep) if k) for i in range(len(langs))]
    whole = [x + 1 for x in add([True] * len(rows))]
    whole = [x / sum(whole) for x in whole]
    told = {k: add([s == k for s in says]) for k in [*langs, "?"]}
    columns = [sum(told[k][i] + 1 for k in told) for i in range(len(langs))]
    out = {}
    for (d, t, _, h), s, said in zip(rows, suffix, says):
        prior = whole
        if h is not None:
            for own in (add([x is not None and y == s for (*_, x), y in zip(rows, suffix)]) if s else add([y == "" for y in suffix]), add([x == h for *_, x in rows])):
                prior = [(c + lang_id.STRENGTH * p) / (sum(own) + lang_id.STRENGTH) for c, p in zip(own, prior)]
        out[d] = fused(t, [math.log(p) + (math.log((told[said][i] + 1) / columns[i]) if said else 0.0) for i, p in enumerate(prior)])
    return langs, out


def test_posteriors_are_those_of_the_plain_version(spark):
    rows = [tuple(r)[:4] for r in languages(spark).where("doc_id < 30 OR doc_id >= 500").collect()]
    langs, want = plain_posteriors(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in lang_id.identify(df, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect():
        p = want[r["doc_id"]]
        if p is None:
            assert r["lang_id"] is None and r["lang_posterior"] == 0
        else:
            assert r["lang_id"] == langs[int(np.argmax(p))] and r["lang_posterior"] == pytest.approx(max(p), abs=1e-4)


def test_many_declared_languages(spark, monkeypatch):
    """Three hundred declared codes: counts and priors stay rows of what occurs, and posteriors those of the plain version."""
    r = random.Random(5)
    codes = ["".join(c) for c in itertools.product("bcdfg", "aeiou", "klmnprstvxyz")]
    rows = [(i, " ".join(f"{c}{r.choice('abcdef')}{c}" for _ in range(4)), c, f"h{i % 7}.{r.choice(['org', 'com'])}") for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = []
    save = common.save
    monkeypatch.setattr(common, "save", lambda df, name: kept.append((name, out := save(df, name))) or out)
    got = lang_id.identify(df, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect()
    langs, want = plain_posteriors(rows)
    assert len(langs) == 300 and all(x["lang_id"] == langs[int(np.argmax(want[x["doc_id"]]))] and x["lang_posterior"] == pytest.approx(max(want[x["doc_id"]]), abs=1e-3) for x in got)
    counted = dict(kept)["language-counts"]
    assert counted.count() < 20 * len(rows) and set(counted.columns) == {"suffix", "host", "declared", "l", "n"}


def test_samples_are_cut_by_hash(spark):
    """Of a language of many keys as many are taken as are asked for, those of smallest hash, however often a key occurs."""
    rows = spark.range(30_000).selectExpr("cast(if(id % 3 = 0, 0, id) AS string) AS key", "if(id % 10 = 0, 'de', 'en') AS lang", "concat('text ', id % 100) AS text")
    taken = []
    beside = common.beside
    try:
        common.beside = lambda t: taken.append(t) or beside(t)
        lang_id.fit_text(rows, 500)
    finally:
        common.beside = beside
    keys = {(x["lang"], x["key"]) for x in taken[0].collect()}
    for lang in ("de", "en"):
        first = [x["key"] for x in rows.where(F.col("lang") == lang).select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(500).collect()]
        assert {k for n, k in keys if n == lang} == set(first)


def test_posteriors_of_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").limit(60).collect()
    odd = [(10_001, None, None), (10_002, "http://a.de/x", "<html lang=de></html>"), (10_003, "http://a.de/x", "<html lang='xx-long'><script>var a</script> ein Text <!-- nichts --></html>"), (10_003, "http://a.de/x", "<html lang='xx-long'><script>var a</script> ein Text <!-- nichts --></html>"), (10_004, "nowhere", "kein Markup")]
    rows = [tuple(p) for p in pages] + odd
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    bare = lambda h: re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", h)
    said = lambda h: (m := re.search(r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", h)) and m[1].lower()
    host = lambda u: "" if not (m := re.match(r"[a-z]+://([^/?#]+)", u)) else m[1].lower()
    plain = [(i, None if h is None else bare(h), None if h is None else said(h), None if u is None else host(u)) for i, (_, u, h) in enumerate(rows)]
    langs, want = plain_posteriors(plain)
    found = {}
    for r in lang_id.pages_language_id(spark, str(tmp_path)).collect():
        found.setdefault(r["page_id"], []).append((r["lang_id"], r["lang_posterior"]))
    for i, (page_id, _, _) in enumerate(rows):
        p = want[i]
        expected = (None, 0.0) if p is None else (langs[int(np.argmax(p))], max(p))
        assert all(x[0] == expected[0] and x[1] == pytest.approx(expected[1], abs=1e-3) for x in found[page_id]), page_id


def test_languages_of_pages(spark):
    got = lang_id.pages_language_id(spark, DATA)
    assert got.columns == ["page_id", "url", "lang_id", "lang_posterior", "lang_kept"]
    assert got.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert got.where("lang_kept AND (lang_id IS NULL OR lang_posterior < 0.6)").count() == 0


def test_sums_do_not_depend_on_their_neighbours():
    v = np.random.default_rng(0).random(1000)
    at = np.array([0, 0, 10, 10, 500, 1000])
    assert common.sums_of(v, at).tolist() == [0.0, v[:10].sum(), 0.0, *(common.sums_of(v[a:b], np.array([0, b - a]))[0] for a, b in ((10, 500), (500, 1000)))]
