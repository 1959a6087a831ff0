"""The chromosome dimension and resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import genome
from tessera.plans.register import query
from tessera.sources import derived
from tessera.sources.derived import CHROMOSOMES, MONTHS, ZOOMS


@query(f"WITH {MONTHS} SELECT 0 AS idx, 'All' AS name, sum(length)::BIGINT // 1000 AS length FROM chromosomes UNION ALL SELECT * FROM chromosomes")
def genome_handler(spark: SparkSession, d: str) -> DataFrame:
    return genome.with_all(derived.months(spark, d))


@query(f"WITH {MONTHS} SELECT * FROM chromosomes UNION ALL SELECT max(idx) + 1, 'pseudoassembly', sum(length)::BIGINT FROM chromosomes")
def genome_assembly(spark: SparkSession, d: str) -> DataFrame:
    return genome.with_assembly(derived.months(spark, d))


_OFFSETS = f"""{MONTHS}, offsets AS (
  SELECT idx, name, length, coalesce(sum(length // 3600 + 1) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bin_offset,
    (sum(length // 1000) OVER (ORDER BY idx))::BIGINT AS boundary FROM chromosomes)"""


@query(f"WITH {_OFFSETS} SELECT * FROM offsets")
def genome_offsets(spark: SparkSession, d: str) -> DataFrame:
    return genome.offsets(derived.months(spark, d), 3600)


@query(f"WITH {_OFFSETS} SELECT a.idx AS chr1_idx, a.bin_offset AS offset_x, b.idx AS chr2_idx, b.bin_offset AS offset_y FROM offsets a JOIN offsets b ON a.idx < b.idx")
def chromosome_pairs(spark: SparkSession, d: str) -> DataFrame:
    return genome.pairs(derived.months(spark, d), 3600, intra=False)


@query(f"""WITH {MONTHS}, autosomes AS (SELECT * FROM chromosomes WHERE NOT regexp_matches(lower(name), '[xym]'))
SELECT idx, name, length, CASE WHEN idx % 2 = 1 THEN 1 ELSE 2 END AS parity,
  CASE WHEN 2 * coalesce(sum(length) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(length) OVER () THEN 1 ELSE 2 END AS halves,
  CASE WHEN n = 0 THEN 1 WHEN ((n - 1) // 2) % 2 = 0 THEN 2 ELSE 1 END AS twos FROM (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS n FROM autosomes)""")
def autosome_split(spark: SparkSession, d: str) -> DataFrame:
    own = derived.months(spark, d)
    parts = {"parity": genome.split_parity, "halves": genome.split_halves, "twos": genome.split_twos}
    out = genome.autosomes(own)
    for name, split in parts.items():
        out = out.join(split(own).select("idx", F.col("part").alias(name)), "idx")
    return out


@query("SELECT i AS wanted, bin_size FROM (SELECT w.i, z.bin_size, row_number() OVER (PARTITION BY w.i ORDER BY abs(w.i - z.bin_size), z.bin_size) AS r FROM (SELECT DISTINCT p_size * 500 AS i FROM part) w CROSS JOIN (VALUES (1000), (5000), (10000), (25000)) z(bin_size)) WHERE r = 1")
def nearest_resolution(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size").cast("int") * 500).alias("bin_size")).distinct()
    return genome.nearest_resolution(wanted, spark.createDataFrame([(x,) for x in (1000, 5000, 10000, 25000)], "bin_size int"))


@query(f"WITH {ZOOMS}, z AS (SELECT DISTINCT unit, bin_size FROM zooms) SELECT unit, bin_size, coalesce(lead(bin_size) OVER w, bin_size) AS finer, coalesce(lag(bin_size) OVER w, bin_size) AS coarser, (row_number() OVER w - 1)::INTEGER AS position FROM z WINDOW w AS (PARTITION BY unit ORDER BY bin_size DESC)")
def next_zoom(spark: SparkSession, d: str) -> DataFrame:
    return genome.next_zoom(derived.zooms(spark, d).select("unit", "bin_size").distinct())


@query(f"WITH {ZOOMS} SELECT unit, bin_size FROM zooms WHERE p_brand = 'Brand#11' INTERSECT SELECT unit, bin_size FROM zooms WHERE p_brand <> 'Brand#11'")
def zoom_intersection(spark: SparkSession, d: str) -> DataFrame:
    """The zooms that one brand's parts and some other's share."""
    every = derived.zooms(spark, d)
    return genome.zoom_intersection(every.where("p_brand = 'Brand#11'"), every.where("p_brand <> 'Brand#11'"))


@query(f"WITH {CHROMOSOMES} SELECT event_type AS asked, idx, name, length, count(*) AS n FROM events JOIN chromosomes ON name = event_type GROUP BY ALL")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of events, written with a prefix, found in the genome."""
    names = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("chr"), F.upper("event_type")).alias("name"))
    found = genome.resolve_names(names, derived.chromosomes(spark))
    return found.groupBy(F.lower(F.substring("asked", 4, 99)).alias("asked"), "idx", "name", "length").agg(F.count("*").alias("n"))


@query(f"WITH {MONTHS}, kept AS (SELECT * FROM chromosomes WHERE idx > 2) SELECT 0 AS idx, 'All' AS name, sum(length)::BIGINT // 1000 AS length FROM kept UNION ALL SELECT * FROM kept")
def chromosome_intersection(spark: SparkSession, d: str) -> DataFrame:
    own = derived.months(spark, d)
    return genome.intersection(genome.with_all(own), own.where("idx > 2"))


_KNOWN = f"""{MONTHS}, known AS (
  SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'own' ELSE c_mktsegment END AS genome, CASE WHEN c_mktsegment = 'BUILDING' THEN 9 ELSE 1 END AS ord, name,
    length + CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS length
  FROM chromosomes, (SELECT DISTINCT c_mktsegment FROM customer))"""


@query(f"WITH {_KNOWN} SELECT arg_min(k.genome, k.ord) AS genome FROM known k JOIN chromosomes c ON c.name = k.name AND c.length = k.length")
def infer_genome(spark: SparkSession, d: str) -> DataFrame:
    """A genome for each market segment, all but one of them longer than the one asked for."""
    months = derived.months(spark, d)
    segments = spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment").distinct()
    own = F.col("c_mktsegment") == "BUILDING"
    known = months.join(F.broadcast(segments), F.lit(True)).select(F.when(own, "own").otherwise(F.col("c_mktsegment")).alias("genome"), F.when(own, 9).otherwise(1).alias("ord"), "name", (F.col("length") + F.when(own, 0).otherwise(1)).alias("length"))
    return genome.infer_genome(months, known)  # segments: five rows
