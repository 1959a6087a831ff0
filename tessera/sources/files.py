"""Text sources: chromosome sizes, and lists of features in four formats."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import features, genome

#: Attribute names in older files and what they are called now.
RENAMED = {"o": "observed", "e_bl": "expectedBL", "e_donut": "expectedDonut", "e_h": "expectedH", "e_v": "expectedV", "fdr_bl": "fdrBL", "fdr_donut": "fdrDonut", "fdr_h": "fdrH", "fdr_v": "fdrV", "num_collapsed": "numCollapsed"}
#: Places of chr1, start1, end1, chr2, start2, end2, the color (None: none) and the first attribute.
LAYOUTS = {
    "bedpe": ((0, 1, 2, 3, 4, 5), 10, 11),
    "px2": ((0, 1, 2, 0, 1, 2), None, 3),
    "px": ((0, 1, 1, 2, 3, 3), 4, 5),
    "loops": ((0, 1, 2, 3, 4, 5), 6, 7),
}
PX_WIDTH = 5000
UNKNOWN = "unknown chromosome"
LOGGED = 100
LOG = logging.getLogger(__name__)


def read_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """idx (from 1, in the order of the file), name, length; lines of other than two tokens are skipped.

    A genome's chromosomes are few: they are numbered in one task.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") == 2)
    return lines.select(F.row_number().over(Window.orderBy("at")).alias("idx"), F.col("t")[0].alias("name"), F.col("t")[1].cast("long").alias("length"))


def read_genomes(spark: SparkSession, folder: str, ending: str = ".chrom.sizes") -> DataFrame:
    """genome, ord, name, length of every file of sizes in a folder, for genome.infer_genome(): a genome is called as its file, and they are tried in the order of their names."""
    lines = spark.read.option("pathGlobFilter", f"*{ending}").text(folder).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") == 2)
    genome_name = F.substring(F.col("file"), F.lit(1), F.length("file") - len(ending))
    return lines.select(genome_name.alias("genome"), genome_name.alias("ord"), F.col("t")[0].alias("name"), F.col("t")[1].try_cast("long").alias("length")).where("length IS NOT NULL")


def feature_type(path: Column) -> Column:
    return F.when(path.contains("block") | path.contains("domain"), "DOMAIN").when(path.contains("peak") | path.contains("loop"), "PEAK").otherwise("GENERIC")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of feature lists but the first of each file, comments and empty ones: feature_id, file, value and names, the first line's columns. Files are split as Spark splits text."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("feature_id"), "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    first = raw.groupBy("file").agg(F.min(F.struct("block", "feature_id", "value")).alias("h"))
    renamed = F.create_map(*(F.lit(x) for pair in RENAMED.items() for x in pair))
    names = F.transform(F.split(F.trim(F.replace("h.value", F.lit("#"), F.lit(""))), "\t"), lambda n: F.coalesce(F.try_element_at(renamed, n), n))
    heads = first.select("file", F.col("h.feature_id").alias("top"), names.alias("names"))
    body = raw.join(F.broadcast(heads), "file").where((F.col("feature_id") != F.col("top")) & ~F.col("value").startswith("#") & (F.trim("value") != ""))  # a row a file
    return body.select("feature_id", "file", "value", "names")


def parse_features(spark: SparkSession, path: str | list[str], chromosomes: DataFrame, layout: str | None = None) -> DataFrame:
    """Every line of feature lists as a feature, oriented, with _corrupt_record and reason, which are null where it is one.

    path: files and folders, of any layout; a file's layout is told by its ending unless it is given. A line is none if it has too few columns or
    more than the first line, if its bounds are no whole numbers, or if the genome has no such chromosome. Of attributes of one name the last counts.
    """
    end = F.lower(F.substring_index("file", ".", -1))
    lines = _lines(spark, path).withColumn("kind", F.lit(layout) if layout else F.when(end.isin(*LAYOUTS), end).otherwise("loops"))
    by_kind = lambda f: F.coalesce(*(F.when(F.col("kind") == kind, f(*at)) for kind, at in LAYOUTS.items()))
    lines = lines.withColumns({"t": F.split(F.regexp_replace("value", "\t+$", ""), "\t"), "first": by_kind(lambda places, color, first: F.lit(first))})
    token = lambda i: by_kind(lambda places, color, first: F.get("t", F.lit(places[i])))
    whole = lambda x: F.when(x.rlike(r"^[+-]?\d{1,18}$"), x.cast("long"))
    wide = F.when(F.col("kind") == "px", PX_WIDTH).otherwise(0)
    rgb = F.split(by_kind(lambda places, color, first: F.lit(None).cast("string") if color is None else F.get("t", F.lit(color))), ",")
    part = lambda i: F.coalesce(F.get(rgb, F.lit(i)).try_cast("int"), F.lit(0))
    keys, values = F.slice("names", F.col("first") + 1, F.size("names")), F.slice("t", F.col("first") + 1, F.size("t"))
    pairs = F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    rows = lines.withColumns({"n1": token(0), "start1": whole(token(1)), "end1": whole(token(2)) + wide, "n2": token(3), "start2": whole(token(4)), "end2": whole(token(5)) + wide, "color": F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")), "attributes": F.map_from_entries(last)})
    known = chromosomes.where("idx > 0").select(genome.name_key(F.col("name")).alias("k"), "idx", "name").dropDuplicates(["k"])
    for i in (1, 2):
        own = known.select(F.col("k").alias(f"k{i}"), F.col("idx").alias(f"chr{i}_idx"), F.col("name").alias(f"chr{i}"))
        rows = rows.join(F.broadcast(own), genome.name_key(F.col(f"n{i}")) == F.col(f"k{i}"), "left").drop(f"k{i}")  # a row a chromosome
    few = F.size("t") < by_kind(lambda places, color, first: F.lit(max(places) + 1))
    no_numbers = F.greatest(*(F.col(c).isNull() for c in ("start1", "end1", "start2", "end2")))
    unknown = F.col("chr1_idx").isNull() | F.col("chr2_idx").isNull()
    reason = F.when(few, "too few columns").when(F.size("t") > F.size("names"), "more columns than the first line").when(no_numbers, "bounds are not whole numbers").when(unknown, UNKNOWN)
    rows = rows.withColumn("reason", reason).withColumn("_corrupt_record", F.when(F.col("reason").isNotNull(), F.col("value")))
    kept = ["feature_id", "chr1_idx", "start1", "end1", "chr2_idx", "start2", "end2", "chr1", "chr2", "color", "attributes", "file", "_corrupt_record", "reason"]
    rows = rows.select(*kept, feature_type(F.col("file")).alias("feature_type"))
    return features.orient(rows.where("reason IS NULL")).unionByName(rows.where("reason IS NOT NULL"))


def read_features(spark: SparkSession, path: str | list[str], chromosomes: DataFrame, layout: str | None = None, mode: str = "strict") -> DataFrame:
    """The features of feature lists, oriented; each set of bounds once; features of unknown chromosomes are skipped.

    mode strict: any other line that is no feature is an error when it is read; permissive: it is skipped. bad_lines() has what was skipped.
    """
    rows = parse_features(spark, path, chromosomes, layout)
    if mode == "strict":
        broken = F.raise_error(F.concat(F.col("file"), F.lit(": "), F.col("reason"), F.lit(": "), F.col("_corrupt_record")))
        wrong = F.col("reason").isNotNull() & (F.col("reason") != UNKNOWN)
        rows = rows.where(F.coalesce(F.col("reason") != UNKNOWN, F.lit(True)) & F.when(wrong, broken.cast("boolean")).otherwise(True))
    elif mode != "permissive":
        raise ValueError(f"mode is strict or permissive, not {mode}")
    return features.dedup(rows.where("reason IS NULL").drop("_corrupt_record", "reason", "file"))


def bad_lines(spark: SparkSession, path: str | list[str], chromosomes: DataFrame, layout: str | None = None) -> DataFrame:
    """file, _corrupt_record, reason of the lines that are no features."""
    return parse_features(spark, path, chromosomes, layout).where("reason IS NOT NULL").select("file", "_corrupt_record", "reason")


def log_bad_lines(bad: DataFrame, most: int = LOGGED) -> int:
    """Logs up to most bad lines, and that there are more; returns how many it logged."""
    some = bad.limit(most + 1).collect()
    for r in some[:most]:
        LOG.warning("%s: %s: %s", r["file"], r["reason"], r["_corrupt_record"])
    if len(some) > most:
        LOG.warning("there are more bad lines, which are not logged")
    return min(most, len(some))
