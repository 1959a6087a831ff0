"""A corpus pipeline: quality classifier, language ID, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of documents; the last returns the packed pieces. run() writes each stage's result as Parquet
in the shared folder and reads it back as the next one's docs; what stages write on the way is deleted once their result is written.

Rows are judged each for itself, so repeated ids and null ids lose no other row; rows that are equal in doc_id and text
are one document to the near-dedup, of which one row stays. Null and empty texts pass the classifier or not by their
score, and go with the language stage, as texts without a letter. Further columns, whatever their names, are
handed on as they are. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, lang_id, line_dedup, near_dups, packing, quality
from tessera.plans.lineage import scratch

USED = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame) -> DataFrame:
    """The columns that stages use, and all others as one, so that none can clash with what an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in USED]
    return docs.select(*(c for c in docs.columns if c in USED), *([F.struct(*rest).alias("rest")] if rest else []))


def as_before(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs."""
    return kept.select(*(F.col(c) if c in USED else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by labels of the documents at hand, does not reject."""
    labels = common.table(spark, sf_dir, "labels", "doc_id", "quality")
    scored = quality.with_score(aside(docs), quality.fit(docs, labels))
    return as_before(scored.where(F.col("score") >= quality.THRESHOLD), docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence settles; lang is what they declare, source their host."""
    found = lang_id.identify(aside(docs), "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    return as_before(found.where("lang_kept"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; a document of which nothing is left goes. n_chars follows the text."""
    left = line_dedup.dedup_lines(aside(docs)).where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n", " ")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return as_before(left, docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: SimHash candidates whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Of rows equal in doc_id and text, all of them one document, one stays: that of the smallest other columns' hash.
    """
    each = common.save(near_dups.near_duplicates(docs).select(F.col("doc_id").alias("group_id"), F.col("t").alias("group_t"), "copies", "is_first"), "groups")
    gone, repeated = (common.save(each.where(f).select("group_id", "group_t"), name) for f, name in (("NOT is_first OR copies > 1", "gone"), ("is_first AND copies > 1", "repeated")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("group_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("group_t"))
    own = aside(docs)
    kept = own.join(common.beside(gone), same, "left_anti")
    if not repeated.isEmpty():
        order = F.xxhash64(*(F.col(c) for c in own.columns if c != "text"))
        kept = kept.unionByName(own.join(common.beside(repeated), same, "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct(*own.columns), order).alias("one")).select("one.*"))
    return as_before(kept, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("packing", pack),
]

#: The classifier, the trigram model and the linear program are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = common.save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            made[-1:], before = before, made[-1:]  # the stage's own table stays until the next one is there
    return docs
