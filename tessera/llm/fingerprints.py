"""Document fingerprints by one-permutation MinHash with optimal densification, stored as packed low-order bits.

A document is its set of shingles of SHINGLE_WORDS words (64-bit hashes; a shorter text is one shingle, a text
without words the empty one). Each hash is looked at once: its high bits name one of BINS bins, and a bin keeps its least hash. An
empty bin borrows from a bin that isn't: each bin asks the others in an order of its own, the same for all documents and going through all of
them, and takes the first that holds a hash, so documents that agree borrow alike. LOW_BITS low-order bits of each bin are stored, packed to
BINS * LOW_BITS / 8 bytes. Bins of unlike documents agree by chance in one of 2**LOW_BITS cases, and likeness is corrected for that:
(agreeing share - 2**-LOW_BITS) / (1 - 2**-LOW_BITS), held at 0. Its standard error is 0.024 at a similarity of 0.5 and 0.011 at 0.

edited_fingerprints() compares each document with its successor. Documents are dealt to ranges of doc_id of
about PART_CHARS characters and sorted there; the first of a range is also sent to the range before, so each range is read
once, a piece of text at a time, with one shuffle of the texts. The order of documents is that of doc_id (null first), then
of the text's hash. Rows equal in both are one document that has several rows: all are followed by the next other
document, and get the same result. All rows of one doc_id are in one range. A single document follows itself. Null is the empty text; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.chunks import pieces_of
from tessera.llm.near_dups import mixed, shingles

SHINGLE_WORDS = 5
BINS, LOW_BITS = 512, 4
SEED = 7
PART_CHARS, MOST_PARTS = 1 << 25, 1 << 16  # with more characters than that ranges are longer
FINEST = 4  # ranges of equal numbers of documents for each of those, which are put together to equal numbers of characters
LOWEST = -(1 << 63)
PIECE = 1 << 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def borrowing(bins: int, seed: int = SEED) -> np.ndarray:
    """turn[i, j]: when bin i asks bin j. Bin i asks i's own start + a step of its own (odd, so all of a power of two are met) times 0, 1, ..."""
    own = np.random.default_rng(seed)
    step, start = 2 * own.integers(0, bins // 2, bins) + 1, own.integers(0, bins, bins)
    asked = (start[:, None] + step[:, None] * np.arange(bins)) % bins
    turn = np.empty((bins, bins), np.int16)
    np.put_along_axis(turn, asked, np.broadcast_to(np.arange(bins, dtype=np.int16), (bins, bins)), axis=1)
    return turn


TURN = borrowing(BINS)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty ones densified. hashes: at least one, in order."""
    bins = (hashes >> np.uint64(65 - BINS.bit_length())).astype(np.int64)
    full, at = np.unique(bins, return_index=True)  # the first of a bin is its least
    out = np.empty(BINS, np.uint64)
    out[full] = hashes[at]
    if len(full) < BINS:
        empty = np.ones(BINS, bool)
        empty[full] = False
        out[empty] = hashes[at[TURN[empty][:, full].argmin(axis=1)]]
    return out


def packed(text: str) -> bytes:
    """The fingerprint: bin after bin its low-order bits. They are mixed with the bin's number, so that a borrowed hash agrees by chance in each bin anew."""
    hashes = shingles(text, SHINGLE_WORDS)
    least = minima(hashes if len(hashes) else np.zeros(1, np.uint64))
    low = mixed(least, np.arange(BINS)) & np.uint64((1 << LOW_BITS) - 1)
    bits = low[:, None] >> np.arange(LOW_BITS, dtype=np.uint64) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two fingerprints' documents."""
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, LOW_BITS).any(axis=1).mean()
    chance = 2.0**-LOW_BITS
    return max(0.0, float(1 - differ - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (lowercase hex) of docs (doc_id, text), without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, PIECE):
                found = pa.array([packed(t or "").hex() for t in batch["text"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], found], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _ranges(docs: DataFrame) -> list[tuple[int | None, int]]:
    """Of each range its first document's doc_id and text hash, in order; MOST_PARTS of them at most."""
    small = common.save(docs.select("doc_id", "t", F.length("text").cast("long").alias("n")), "lengths")
    total = small.agg(F.sum("n")).first()[0] or 0
    size = max(PART_CHARS, -(-total // MOST_PARTS))
    dealt = small.repartitionByRange(FINEST * (total // size + 1), "doc_id").withColumn("part", F.spark_partition_id())
    fine = dealt.groupBy("part").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.sum("n").alias("n")).orderBy("part").collect()
    common.drop_saved(small)
    firsts, room = [], 0
    for r in fine:
        if not firsts or room + r["n"] > size and r["first"]["doc_id"] > LOWEST:
            firsts.append((r["first"]["doc_id"], r["first"]["t"]))
            room = 0
        room += r["n"]
    return firsts


def _followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order, each with what follows it. Rows of which it is said that they only follow end their range."""
    text, mark, key, waiting = "", b"", None, 0  # the last document and how many rows it has
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def closed(after: str, after_mark: bytes) -> list[tuple]:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        edited_mark = packed(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return [(key[1], len(text), sha, mark.hex(), edited_mark.hex(), likeness(mark, edited_mark), likeness(mark, after_mark))] * waiting

    for whole in batches:
        for batch in pieces_of(whole, PIECE):
            out: list[tuple] = []
            for part, doc_id, t, only, value in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "t", "only", "text"))):
                if (part, doc_id, t, only) == key:
                    waiting += not only
                    continue
                value_mark = packed(value)
                if waiting and key[0] == part:
                    out += closed(value, value_mark)
                text, mark, key, waiting = value, value_mark, (part, doc_id, t, only), int(not only)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (lowercase hex), near_edited, near_next.

    Edited: the last half of the characters replaced by the first as many of the next document.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    firsts = _ranges(docs)
    if not firsts:
        return spark.createDataFrame([], RESULT)
    bounds = np.array([d for d, _ in firsts[1:]], np.int64)

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(np.int64), "right").astype(np.int32))

    first = spark.createDataFrame([(d, t, (i - 1) % len(firsts)) for i, (d, t) in enumerate(firsts)], "fd long, ft long, before int")
    placed = docs.withColumn("part", part_of(F.coalesce("doc_id", F.lit(LOWEST))))
    placed = placed.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("t") == F.col("ft")), "left")  # MOST_PARTS rows at most
    own = F.struct("part", F.lit(False).alias("only"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(True).alias("only"))
    to = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead))).alias("to")
    sent = placed.select("doc_id", "t", "text", to).select("doc_id", "t", "text", "to.*")
    return sent.repartitionById(len(firsts), F.col("part")).sortWithinPartitions("part", "only", "doc_id", "t").mapInArrow(_followed, RESULT)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.table(spark, sf_dir, "documents", "doc_id", "text"))
