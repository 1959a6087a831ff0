"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

A text's words are what stands between spaces and line feeds. Its features are its words (lower-cased) and
word shapes (runs of capitals, small letters and digits as one sign each, other characters once; a word that
repeats the one before is "="), singly and in pairs, and the power of two of its length; each is hashed into
2^18 places. A feature's value is its share of the features of its kind. Scoring is the sparse dot product
with the weights, which needs no grouping: it is the mean weight of each kind's occurrences.

Training takes SAMPLE labelled rows at most, those of smallest hashed doc_id, so it costs the same at any
size of the corpus; scoring reads whole texts of all documents. Rows whose crc32 of the doc_id modulo five is
zero are held out. If a doc_id has several labels, the lowest holds; if it has several rows, that of the
smallest text hash is the example, so there are SAMPLE examples at most however often an id repeats. Without any
usable label every score is 0.5. Null and empty texts are scored by their length alone; equal texts have
equal scores. Only text enters a score. The result has the input's columns and score, which replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.chunks import pieces_of

PLACES = 1 << 18
KINDS = 5
SAMPLE = 6000
THRESHOLD = 0.3
PIECE = 500_000  # bytes of text at once
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
MIX = np.uint64(0x9E3779B97F4A7C15)
_CAPITALS, _SMALL, _DIGITS, _SAME = (regex.compile(p) for p in (r"\p{Lu}+", r"\p{Ll}+", r"\p{N}+", r"(.)\1+"))


def _shape(word: str) -> str:
    word = _DIGITS.sub("9", _SMALL.sub("a", _CAPITALS.sub("A", word)))
    return _SAME.sub(r"\1", word)[:16]


_known: dict[str, tuple[int, int]] = {}


def _word(word: str) -> tuple[int, int]:
    got = _known.get(word)
    if got is None:
        if len(_known) > 50_000:
            _known.clear()
        got = _known[word] = (xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(_shape(word)))
    return got


def _place(hashes: np.ndarray, kind: int) -> np.ndarray:
    h = (hashes ^ np.uint64(kind)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - 18)).astype(np.int64)


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind the places of all occurrences, text after text, and where each text's begin (one more at the end)."""
    split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    offsets = np.asarray(split.offsets).astype(np.int64)
    offsets -= offsets[0]
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.array([_word(w) for w in words], np.uint64).reshape(-1, 2)
    index = np.asarray(coded.indices).astype(np.int64)
    # empty strings between two separators are no words
    real = np.array([bool(w) for w in words], bool)[index] if len(index) else np.empty(0, bool)
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    index = index[real]
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    word, shape = hashes[index, 0], hashes[index, 1].copy()
    follows = text_of[1:] == text_of[:-1]
    shape[1:][follows & (index[1:] == index[:-1])] = 0x3D
    pair = lambda h: (h[:-1] * np.uint64(31) + h[1:])[follows]
    pairs = np.concatenate([[0], np.cumsum(np.bincount(text_of[1:][follows], minlength=len(texts)))]).astype(np.int64)
    length = np.log2(np.diff(offsets) + 1).astype(np.uint64)
    return [(_place(word, 1), offsets), (_place(pair(word), 2), pairs), (_place(shape, 3), offsets), (_place(pair(shape), 4), pairs), (_place(length, 5), np.arange(len(texts) + 1))]


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    total = np.full(len(texts), float(weights[PLACES]))
    for places, at in features(texts):
        total += common.sums_of(weights[places], at) / np.maximum(1, np.diff(at))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) from (places, values, label) examples, in their order; each has the bias besides."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for places, values, label in examples:
            places, values = np.append(places, PLACES), np.append(values, np.float32(1)).astype(np.float64)
            w = weight(places)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
            step = (np.sqrt(n[places] + g * g) - np.sqrt(n[places])) / ALPHA
            z[places] += g - step * w
            n[places] += g * g
    return weight(np.arange(PLACES + 1)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most sample labelled rows of docs that are not held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).join(own.select("id"), "id", "left_semi")  # labels of other documents use up no part of the sample
    chosen = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = own.join(F.broadcast(chosen), "id")  # sample rows of two numbers at most

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, PIECE):
                places, values = [], []
                kinds = features(batch["text"])
                for i in range(batch.num_rows):
                    got = [np.unique(p[at[i] : at[i + 1]], return_counts=True) for p, at in kinds]
                    places.append(np.concatenate([p for p, _ in got]).astype(np.int32))
                    values.append(np.concatenate([c / max(1, c.sum()) for _, c in got]).astype(np.float32))
                hashes = pa.array([xxhash.xxh64_intdigest(t.as_py() or "") - (1 << 63) for t in batch["text"]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], hashes, pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["id", "label", "t", "places", "values"])

    each = rows.mapInArrow(extract, "id long, label int, t long, places array<int>, values array<float>")
    each = each.groupBy("id", "label").agg(F.min_by(F.struct("places", "values"), "t").alias("f")).select("id", "label", "f.places", "f.values")
    table = each.toArrow()  # sample rows at most
    places, values = (c.combine_chunks() if len(c.chunks) != 1 else c.chunk(0) for c in (table["places"], table["values"]))
    ids, given = np.asarray(table["id"]), np.asarray(table["label"])
    order = sorted(range(len(ids)), key=lambda i: (xxhash.xxh64_intdigest(str(ids[i])), i))
    examples = [(np.asarray(places[i].values), np.asarray(values[i].values), int(given[i] > 0)) for i in order]
    return train(examples)


def with_score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs and its column score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a megabyte, whatever the corpus

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [scores(b["text"], shared.value) for b in pieces_of(pa.RecordBatch.from_arrays([texts], names=["text"]), PIECE)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn("score", score(F.col("text").cast("string")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    scored = with_score(docs, fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
