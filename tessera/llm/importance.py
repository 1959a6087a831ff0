"""Target-distribution importance resampling over hashed word features, in two Arrow passes.

The first pass counts the features of a table by bucket: a task adds up np.bincount vectors of BUCKETS places and sends one,
and treeReduce merges the tasks' vectors, so the driver gets a vector of fixed length. This is done for the corpus and for
the target. From both a bucket's gain follows: how much likelier its features are in the target. The second pass gathers the
broadcast gains (BUCKETS whole numbers) of each document's features and adds them up with np.bincount. A document's score is its mean
gain and Gumbel noise that its id decides, so that the highest scores are a draw without replacement from the target's distribution.

Texts are read whole, in slices cut between words. Scores are ranked over ranges of scores; no window holds more
than a range. Null and empty texts have no features and weight 0. A document without an id has no score and isn't drawn, but counts among those of
LEAST_WORDS words. Rows that share an id have the same noise; ties go by doc_id, then number of features, then weight. An empty
table gives an empty result, an empty target gains from counts of zero. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.chunks import pieces_of
from tessera.plans.lineage import numbered

BUCKETS = 10_000
LEAST_WORDS = 20
#: In UTF-8 all bytes of characters beyond ASCII are 0x80 or more.
WORD, BETWEEN = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SLICE = 1 << 20
PIECE = 1 << 20  # bytes of text at once


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words in order, a slice of the text at a time; only A-Z are lowered."""
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def features(text: bytes, most: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of all runs of 1 to most consecutive words."""
    n, found, tail = 0, [], []
    for words in words_of(text):
        n += len(words)
        found.append(np.fromiter(map(crc32, words), np.uint32, len(words)))
        if most > 1:
            words = tail + words
            for run in range(2, most + 1):
                new = max(0, len(tail) - run + 1)  # earlier runs lie within what is carried
                found.append(np.fromiter((crc32(b" ".join(words[i : i + run])) for i in range(new, len(words) - run + 1)), np.uint32))
            tail = words[-(most - 1) :]
    return n, np.concatenate(found).astype(np.int64) % buckets if found else np.empty(0, np.int64)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for batch in pieces_of(whole, PIECE):
            yield batch, [t.encode("utf-8", "surrogatepass") for t in batch["text"].fill_null("").to_pylist()]


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of a table (text string) fall into each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, some in _texts(batches):
            counts += np.bincount(np.concatenate([features(t, most, buckets)[1] for t in some]), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()])], names=["counts"])

    vectors = texts.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln of the ratio of its smoothed shares in the target and the corpus)."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # of fixed length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, some in _texts(batches):
            found = [features(t, most, len(own)) for t in some]
            n = np.fromiter((len(b) for _, b in found), np.int64, len(found))
            doc = np.repeat(np.arange(len(found)), n)
            total = np.bincount(doc, weights=own[np.concatenate([b for _, b in found])], minlength=len(found))  # whole numbers below 2**53
            words = pa.array([w for w, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], words, pa.array(n), pa.array(total.astype(np.int64) // np.maximum(1, n))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u decided by the first 32 bits of sha256 of `seed:doc_id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of docs (doc_id, text): rank of the drawn ones, percent of the documents of least_words words, from 1 on.

    target: (text); features are runs of 1 to most words.
    """
    plain = F.col("text").cast("string").alias("text")
    docs, target = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain), target.select(plain)
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    scored = common.save(weighed(docs, gain, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    able = F.col("n_words") >= least_words
    draw = percent * scored.where(able).count() // 100
    spread = F.xxhash64(F.monotonically_increasing_id())  # rows that are equal in all need not be in one range
    keys = {"late": ~able | F.col("score").isNull(), "minus": F.when(able, -F.col("score")), "tie": F.when(able, F.col("doc_id")), "spread": spread}
    placed = numbered(scored.withColumns(keys), "place", "late", "minus", "tie", "n_features", "weight", "spread")
    common.drop_saved(scored)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(~F.col("late") & (F.col("place") < draw), F.col("place") + 1).alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "text"), 10, 2024)
