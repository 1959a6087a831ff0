"""Packing documents into sequences of one length, by cutting-stock column generation.

Each document's ids, with an end id, are cut into pieces of a whole sequence and one rest. Whole pieces are
sequences by themselves. The rests are counted by size, in units of UNIT tokens (rounded up); the cutting-stock
plan over that histogram, of at most capacity / UNIT sizes, says how many of each size go together. Rests of a
size are ranked, and the plan's ranges of ranks lead each to its sequence. Within a sequence pieces stand one
after the other by their true lengths, so only what the rounding and the last patterns leave is padding.

Ranks are counted in buckets of bounded size, so a size that a third of the documents share is no task's alone;
the driver sees the histogram alone. A null or empty text is the end id. Rows of one doc_id are packed each for
itself; a null doc_id stays null. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common, cutting_stock
from tessera.llm.chunks import library_encoder, pieces_of

CAPACITY = 2048
UNIT = 4
BUCKET = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for whole in batches:
            for batch in pieces_of(whole):
                ids, counts = encoder.encode(batch["text"])
                ends = np.cumsum(counts)
                # the end ids are put in place all at once
                data = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
                first, rows = 0, []
                for doc_id, n in zip(batch["doc_id"].to_pylist(), (counts + 1).tolist()):
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        rows.append((doc_id, start, size, zlib.crc32(data[4 * (first + start) : 4 * (first + start + size)]), n))
                    first += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """The pieces with their sequence_id and offset in it."""
    spark = docs.sparkSession
    # a size of 0 stands for pieces that fill a sequence
    size = F.when(F.col("length") == capacity, 0).otherwise(F.ceil(F.col("length") / unit)).cast("int")
    pieces = common.save(cut(docs, tokenizer, end_id, capacity).withColumn("size", size), "pieces")
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    n_whole = histogram.pop(0, 0)
    ranges, n_bins = cutting_stock.plan(histogram, capacity // unit)
    ranges.append((0, 0, n_whole, 1, n_bins))
    plan = spark.createDataFrame(ranges, "size int, first long, pieces long, each long, bin long")

    buckets = max(1, (sum(histogram.values()) + n_whole) // BUCKET)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    in_bucket = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    skipped = dealt.groupBy("size", "bucket").count().select("size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    ranked = dealt.withColumn("own", F.row_number().over(in_bucket)).join(skipped, ["size", "bucket"]).withColumn("rank", F.col("own") + F.col("skip") - 1)
    # the plan has a few rows for each of at most capacity / unit sizes, whatever the corpus
    at = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.size") == F.col("p.size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces")))
    sequence = F.col("bin") + F.expr("(rank - first) div each")
    placed = at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), F.col("r.size").alias("size"), "rank")
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).drop("size", "rank")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 1)
