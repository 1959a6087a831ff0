"""Contact maps written as binary files and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lineage import new_folder
from tessera.plans.register import query
from tessera.sinks import contact_file as sink
from tessera.sources import contact_file, derived
from tessera.sources.derived import CONTACTS, MONTHS


def _files(spark: SparkSession, d: str, version: int) -> str:
    chromosomes = [("ALL", 0), *((name, derived.LENGTH) for name in derived.NAMES)]
    written = sink.write_contacts(derived.contacts(spark, d), chromosomes, new_folder(spark), "events", version, 64)
    return json.dumps([r[0] for r in written.collect()])  # a row a file


@query(f"WITH {CONTACTS} SELECT chr1_idx, chr2_idx, 'BP' AS unit, bin_size, bin_x, bin_y, counts FROM contacts")
def contact_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every record of every map of files of version 8."""
    return contact_file.read(spark, _files(spark, d, 8)).withColumn("counts", F.col("counts").cast("double"))


@query(f"WITH {CONTACTS} SELECT bin_x, bin_y, counts FROM contacts WHERE chr1_idx = 2 AND chr2_idx = 2 AND bin_x BETWEEN 100 AND 300 AND bin_y BETWEEN 200 AND 450")
def contact_file_region(spark: SparkSession, d: str) -> DataFrame:
    """A region of one map of files of version 9; the filters leave out other maps and blocks."""
    region = contact_file.read(spark, _files(spark, d, 9)).where("chr1_idx = 2 AND chr2_idx = 2 AND unit = 'BP' AND bin_size = 3600 AND bin_x BETWEEN 100 AND 300 AND bin_y BETWEEN 200 AND 450")
    return region.select("bin_x", "bin_y", F.col("counts").cast("double").alias("counts"))


@query(f"WITH {CONTACTS} SELECT chr1_idx, chr2_idx, bin_size, sum(counts) AS sum_counts FROM contacts GROUP BY ALL")
def contact_file_matrices(spark: SparkSession, d: str) -> DataFrame:
    """The maps that the files hold; a map's files each have a part of its sum."""
    return contact_file.read(spark, _files(spark, d, 9), "matrices").groupBy("chr1_idx", "chr2_idx", "bin_size").agg(F.sum("sum_counts").alias("sum_counts"))


@query(f"WITH {MONTHS} SELECT 0 AS idx, 'ALL' AS name, 0::BIGINT AS length UNION ALL SELECT * FROM chromosomes")
def contact_file_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    """The genome of months, as the headers of files have it."""
    months = [(r["name"], r["length"]) for r in derived.months(spark, d).orderBy("idx").collect()]  # a row a chromosome
    written = sink.write_contacts(derived.contacts(spark, d), [("ALL", 0), *months], new_folder(spark), "months", 8, 64)
    return contact_file.read(spark, [r[0] for r in written.collect()], "chromosomes").distinct()
