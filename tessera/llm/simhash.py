"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits, in a ring. If two
fingerprints differ in two bits or fewer, some segment is the same in both while the one after it differs
in one bit at most: if both errors are in one segment, the other two are clean and one of them follows the
other; if two segments have one error each, the third is clean. A fingerprint's keys are a segment as it is
together with each Golay key of the segment after it, about sixteen in all. Fingerprints that share a key
are compared.

Only different fingerprints are compared; documents with one fingerprint are one group from the start.
Keys that few fingerprints share give pairs. Where many share one, pairs would grow with their square:
each of those fingerprints is given the 65 words within one bit of it instead, and all that meet at a word
are linked to the smallest. Two fingerprints differ in two bits or fewer exactly if they meet at a word, so
no link is lost. Components are found by rounds of star linking over tables in the shared folder.

Null and empty texts have no words and the fingerprint zero. Rows of one doc_id are fingerprinted each for
itself. Null doc_ids are fingerprinted and linked, but never give a component its name unless it has no
other. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, golay
from tessera.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MOST_ERRORS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key of which all pairs are compared; beyond it they are linked through common neighbours.
PAIRED = 6
WORDS_AT_ONCE = 1 << 17


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bit by bit the majority of the shingles' hashes; long texts are gone through in pieces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(b" ".join(words), SEED)
    n = len(words) - shingle_words + 1
    ones = np.zeros(64, np.int64)
    for first in range(0, n, WORDS_AT_ONCE):
        some = words[first : min(n, first + WORDS_AT_ONCE) + shingle_words - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(some) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the fingerprints, and their keys."""
    words = [(fps.view(np.uint64) >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    at, found = [], []
    for i, exact in enumerate(words):
        near = golay.keys(words[(i + 1) % len(words)])
        row, column = np.nonzero(near >= 0)
        at.append(row)
        found.append((i << 40) | (exact[row] << 12) | near[row, column])
    return np.concatenate(at), np.concatenate(found)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints, two bits apart or fewer, whose components are those of all such pairs. fps: fp, each once."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch["fp"])
            at, keys = fuzzy_keys(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[at])], names=["key", "fp"])

    def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))]).astype(np.uint64).view(np.int64)
        for batch in batches:
            values = np.asarray(batch["fp"])
            yield pa.RecordBatch.from_arrays([pa.array((values[:, None] ^ flips).ravel()), pa.array(np.repeat(values, len(flips)))], names=["word", "fp"])

    keys = common.save(fps.mapInArrow(keyed, "key long, fp long"), "fuzzy-keys")
    shared = common.save(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "shared-keys")
    twos = shared.where("n = 2").select("a", "b")
    few = keys.join(shared.where(f"n > 2 and n <= {PAIRED}").select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, PAIRED)).alias("b"))
    many = keys.join(shared.where(f"n > {PAIRED}").select("key"), "key").select("fp").distinct().mapInArrow(around, "word long, fp long")
    stars = many.join(many.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "word").select("a", F.col("fp").alias("b"))
    return twos.unionByName(few).unionByName(stars).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_ERRORS)).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links lead to."""
    prints = common.save(fingerprints(docs, shingle_words), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    named = groups.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))
