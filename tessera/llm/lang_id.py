"""Language ID by Bayesian evidence fusion.

The evidence for a language is fused as log probabilities:
  text      hashed trigrams of letters, a multinomial for each language, the mean over a text's trigrams
            counting as TEMPER trigrams at most, since neighbours are not independent
  declared  how often texts of the language declare what this one does (markup language), counted over all rows
  host      how the host's texts are spread over languages, smoothed towards its address suffix, and that
            towards the whole corpus; counts are sums of the text's own probabilities, by grouped aggregation
A text whose language stays below KEEP, or that has no letter, is rejected.

A language is the first part of a declaration, of two or three letters ("de" of "de-AT"), so there are 18,252 at most;
other declarations are one more kind of declaration and no language. The trigram model is fitted on SAMPLE rows
at most of each language, those of smallest hashed key, however rare it is; all counts and priors are over all rows. The
model has MODEL numbers at most: many languages share fewer trigram places. Without declared languages
no row has a language and all are rejected. Shares, priors and declarations are kept as rows of (language, count) that occur; the
driver sees a number a language. Missing declarations, hosts and suffixes are no evidence; a null or empty text
is rejected. Texts have a space before and after them, so a single letter is a trigram. Rows are judged each for
itself, so repeated rows agree. The priors are a table of one row a host, joined as its size allows. The result has the input's
columns and lang_id, lang_posterior and lang_kept, which replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.chunks import pieces_of

BITS = 16
SAMPLE = 4_000
MODEL = 1 << 24
TEMPER = 50
STRENGTH = 20.0  # texts that a prior one level up counts as
KEEP = 0.6
PIECE = 500_000
NUMBERS = 1 << 21
LEAST_SHARE = 1e-6  # of a text's probability; less is not counted
SPACE = 0x20
ADDED = ("lang_id", "lang_posterior", "lang_kept")


def _letters() -> np.ndarray:
    """Each byte of lower-cased text: letters and all parts of multi-byte characters themselves, the rest a space."""
    table = np.full(256, SPACE, np.uint32)
    for b in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
        table[b] = b
    return table


LETTERS = _letters()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all texts, text after text, and where each text's begin (one more at the end)."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    texts = pc.binary_join_element_wise(space, texts, space, nothing)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    c = LETTERS[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint32)
    offsets = offsets - offsets[0]
    if len(c) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    hashed = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    hashed = (hashed ^ (hashed >> np.uint32(15))) & np.uint32((1 << BITS) - 1)
    good = (c[:-2] != SPACE) | (c[1:-1] != SPACE) | (c[2:] != SPACE)
    for edge in offsets[1:-1]:  # no trigram reaches from one text into the next
        good[max(0, edge - 2) : edge] = False
    before = np.concatenate([[0], np.cumsum(good)])
    return hashed[good].astype(np.int64), before[np.minimum(offsets, len(good))]


def declared_language(declared: Column) -> Column:
    """The language a declaration names; null if it names none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def fit_text(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and, for each of them, the log probabilities of all trigram places. rows: key, lang, text."""
    rows = rows.where("lang IS NOT NULL")
    # languages with many keys are cut by a share of the hashes first, twice the room that counting them roughly needs, so that no task sorts a language
    many = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("keys"))
    small = (F.xxhash64("key") / F.lit(2.0**64) + 0.5) * F.col("keys") <= 1.25 * sample + 50
    in_order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    keys = rows.select("key", "lang").join(F.broadcast(many), "lang").where(small).select("key", "lang").distinct()  # many: a row a language
    chosen = keys.withColumn("at", F.row_number().over(in_order)).where(F.col("at") <= sample).select("key", "lang")
    picked = rows.join(common.beside(common.save(chosen, "sampled-keys")), ["key", "lang"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in pieces_of(whole, PIECE):
                langs = np.asarray(batch["lang"].to_pylist(), object)
                for lang in set(langs):
                    places, _ = trigrams(batch["text"].filter(pa.array(langs == lang)))
                    totals[lang] = totals.get(lang, 0) + np.bincount(places, minlength=1 << BITS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([0, *n[at].tolist()], pa.int64())], names=["lang", "place", "n"])

    counted = common.save(picked.select("lang", "text").mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")), "trigram-counts")
    languages = sorted(r[0] for r in counted.where("place = -1").select("lang").collect())  # of two or three letters each
    bits = min(BITS, int(np.log2(MODEL / max(1, len(languages)))))
    numbers = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i))) if languages else F.lit(None)
    places = counted.where("place >= 0").select(numbers[F.col("lang")].alias("lang") if languages else F.lit(0).alias("lang"), F.col("place").bitwiseAND((1 << bits) - 1).alias("place"), "n")
    table = places.groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()  # MODEL rows at most
    common.drop_saved(counted)
    n = np.zeros((1 << bits, len(languages)))
    n[np.asarray(table["place"]), np.asarray(table["lang"])] = np.asarray(table["n"])
    return languages, np.ascontiguousarray(np.log((n + 0.5) / (n + 0.5).sum(axis=0)).astype(np.float32).T)


def _fuse(texts: pa.Array, model: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the languages of each text, and whether it has letters; prior: log probabilities to add."""
    out, letters = [], []
    for piece in pieces_of(pa.RecordBatch.from_arrays([texts], names=["text"]), PIECE):
        places, at = trigrams(piece["text"])
        n = np.diff(at)
        places &= model.shape[1] - 1
        mean = np.stack([common.sums_of(own[places], at) for own in model], axis=1) / np.maximum(1, n)[:, None]
        out.append(mean * np.minimum(n, TEMPER)[:, None])
        letters.append(n > 0)
    if not out:
        return np.empty((0, len(model))), np.empty(0, bool)
    total = np.concatenate(out) + prior
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True), np.concatenate(letters)


def _runs(rows: int, n: int) -> list[slice]:
    """Rows a few at a time, so that a number a row and language fits."""
    step = max(1, NUMBERS // max(1, n))
    return [slice(at, min(rows, at + step)) for at in range(0, rows, step)]


def _dense(lists: pa.Array, n: int) -> np.ndarray:
    """A row of n numbers of each list of (l, n); null is an empty list."""
    lists = pc.if_else(pc.is_valid(lists), lists, pa.scalar([], lists.type))
    out, entries = np.zeros((len(lists), n)), lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    out[row, np.asarray(entries.field("l"))] = np.asarray(entries.field("n"))
    return out


def identify(docs: DataFrame, key: str, text: Column, declared: Column, host: Column) -> DataFrame:
    """docs with lang_id (null if there is none), lang_posterior and lang_kept."""
    spark, columns = docs.sparkSession, docs.columns
    text, declared, host = text.cast("string"), F.nullif(F.lower(F.trim(declared.cast("string"))), F.lit("")), host.cast("string")
    languages, model = fit_text(docs.select(F.col(key).cast("string").alias("key"), declared_language(declared).alias("lang"), text.alias("text")))
    n = len(languages)
    docs = common.apart(docs, text.alias("text"), declared.alias("declared"), declared_language(declared).alias("lang"), host.alias("host"))
    if not n:
        return common.together(docs.select("row", F.lit(None).cast("string").alias("lang_id"), F.lit(0.0).alias("lang_posterior"), F.lit(False).alias("lang_kept")), columns, *ADDED)
    shared = spark.sparkContext.broadcast(model)  # MODEL numbers at most
    index = {lang: i for i, lang in enumerate(languages)}

    @F.arrow_udf("array<struct<l:int,p:double>>")
    def by_text(texts: pa.Array) -> pa.Array:
        parts = []
        for some in _runs(len(texts), n):
            p, letters = _fuse(texts[some], shared.value, np.zeros(n))
            row, at = np.nonzero((p > LEAST_SHARE) & letters[:, None])
            ends = np.searchsorted(row, np.arange(len(p) + 1))
            entries = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(p[row, at])], names=["l", "p"])
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("l", pa.int32()), ("p", pa.float64())])))

    suffix = F.regexp_extract("host", r"\.([A-Za-z]+)(?::\d+)?$", 1)
    known = F.coalesce("lang", F.when(F.col("declared").isNotNull(), F.lit("?")))
    first = docs.select("host", suffix.alias("suffix"), known.alias("declared"), F.explode(by_text("text")).alias("p"))
    counts = common.save(first.groupBy("suffix", "host", "declared", "p.l").agg(F.sum("p.p").alias("n")), "language-counts")
    listed = F.collect_list(F.struct("l", "n"))  # an entry a language at most

    def by_language(rows: DataFrame) -> np.ndarray:
        out = np.zeros(n)
        for r in rows.groupBy("l").agg(F.sum("n").alias("n")).collect():  # a row a language
            out[r["l"]] = r["n"]
        return out

    everywhere = by_language(counts) + 1
    everywhere /= everywhere.sum()
    told = counts.where("declared IS NOT NULL")
    base = -np.log(by_language(told) + n + 1)  # of a declaration that no text of the language has
    says = common.save(told.groupBy("declared", "l").agg(F.sum("n").alias("n")).groupBy("declared").agg(listed.alias("says")), "declarations").withColumnRenamed("declared", "known")
    by_suffix = counts.groupBy(F.coalesce("suffix", F.lit("")).alias("suffix"), "l").agg(F.sum("n").alias("n")).groupBy("suffix").agg(F.sum("n").alias("of_suffix"), listed.alias("at_suffix"))
    by_host = counts.where("host IS NOT NULL").groupBy("suffix", "host", "l").agg(F.sum("n").alias("n")).groupBy("suffix", "host").agg(F.sum("n").alias("of_host"), listed.alias("at_host"))
    priors = common.save(by_host.join(by_suffix, "suffix").drop("suffix"), "language-priors")

    @F.arrow_udf("lang_id string, lang_posterior double, lang_kept boolean")
    def judge(texts: pa.Array, declared: pa.Array, said: pa.Array, of_host: pa.Array, at_host: pa.Array, of_suffix: pa.Array, at_suffix: pa.Array) -> pa.Array:
        parts = []
        for some in _runs(len(texts), n):
            one, two = (STRENGTH / (np.asarray(pc.fill_null(x[some], 0.0))[:, None] + STRENGTH) for x in (of_host, of_suffix))
            up = (_dense(at_suffix[some], n) / STRENGTH + everywhere) * two
            prior = (_dense(at_host[some], n) / STRENGTH + np.where(np.asarray(pc.is_valid(of_host[some]))[:, None], up, everywhere)) * one
            log_prior = np.log(prior)
            log_prior[np.asarray(pc.is_valid(declared[some]))] += base
            p, letters = _fuse(texts[some], shared.value, log_prior + np.log1p(_dense(said[some], n)))
            best = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
            most = p[np.arange(len(p)), best]
            names = pa.array(np.array(languages, object)[best], pa.string(), mask=~letters)
            parts.append(pa.StructArray.from_arrays([names, pa.array(np.where(letters, most, 0.0)), pa.array(letters & (most >= KEEP))], names=["lang_id", "lang_posterior", "lang_kept"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_id", pa.string()), ("lang_posterior", pa.float64()), ("lang_kept", pa.bool_())]))

    joined = docs.withColumn("known", known).join(priors, "host", "left")
    joined = joined.join(F.broadcast(says) if counts.count() <= common.BROADCAST_ROWS else says, "known", "left")
    judged = judge("text", "known", "says", "of_host", "at_host", "of_suffix", "at_suffix").alias("got")
    return common.together(joined.select("row", judged).select("row", "got.*"), columns, *ADDED)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: lang is what they declare, source their host."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).drop("text")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the html element's lang is what they declare; the text is the markup without tags, scripts and styles."""
    pages = common.table(spark, sf_dir, "pages", "page_id", "url", "html")
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return identify(pages, "page_id", bare, F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1), F.lit("")), F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))).drop("html")
