"""Contact maps, features and matrices derived from the driver's tables.

Five event types are the chromosomes; consecutive events of one user are a contact between their places in
seconds since 2024. Each function has the SQL of the same relation beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ["click", "error", "purchase", "signup", "view"]
LENGTH = 2_592_000
BIN = 3600


def chromosomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, LENGTH) for i, name in enumerate(NAMES, 1)], "idx int, name string, length long")


CHROMOSOMES = "chromosomes AS (SELECT idx::INTEGER AS idx, name, 2592000::BIGINT AS length FROM (VALUES (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'view')) t(idx, name))"


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genome whose chromosomes are the months of orders, as long as they have orders; Decembers stand for sex chromosomes."""
    ym = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(ym.alias("ym")).agg((F.count("*") * 10007).alias("length"))
    name = F.concat(F.when(F.col("ym") % 100 == 12, "X").otherwise("chr"), F.col("ym").cast("string"))
    return n.select(F.row_number().over(Window.orderBy("ym")).alias("idx"), name.alias("name"), "length")  # a row a month


MONTHS = """chromosomes AS (
  SELECT (row_number() OVER (ORDER BY ym))::INTEGER AS idx, CASE WHEN ym % 100 = 12 THEN 'X' ELSE 'chr' END || ym AS name, n * 10007 AS length
  FROM (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS ym, count(*)::BIGINT AS n FROM orders GROUP BY 1)
)"""


def zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, bin_size: the sizes of parts, those of even keys in base pairs, those of odd ones in fragments."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.when(F.col("p_partkey") % 2 == 0, "BP").otherwise("FRAG").alias("unit"), (F.col("p_size").cast("int") * 500).alias("bin_size"), "p_brand").dropDuplicates()


ZOOMS = "zooms AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'BP' ELSE 'FRAG' END AS unit, (p_size * 500)::INTEGER AS bin_size, p_brand FROM part)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, chr1_idx, pos1, chr2_idx, pos2, the lower chromosome (or place) first."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    chr_idx = F.array_position(F.array(*map(F.lit, NAMES)), F.col("event_type")).cast("int")
    at = events.select("user_id", "event_id", chr_idx.alias("c1"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("p1"))
    order = Window.partitionBy("user_id").orderBy("p1", "event_id")
    both = at.withColumns({"c2": F.lead("c1").over(order), "p2": F.lead("p1").over(order)}).where("c2 IS NOT NULL")
    swap = (F.col("c1") > F.col("c2")) | ((F.col("c1") == F.col("c2")) & (F.col("p1") > F.col("p2")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return both.select("event_id", pick("c1", "c2").alias("chr1_idx"), pick("p1", "p2").alias("pos1"), pick("c2", "c1").alias("chr2_idx"), pick("p2", "p1").alias("pos2"))


PAIRS = """events_at AS (
  SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS c1,
    (epoch_us(ts) - 1704067200000000) // 1000000 AS p1
  FROM events
), both_ends AS (
  SELECT *, lead(c1) OVER w AS c2, lead(p1) OVER w AS p2 FROM events_at WINDOW w AS (PARTITION BY user_id ORDER BY p1, event_id)
), pairs AS (
  SELECT event_id, least(c1, c2) AS chr1_idx, CASE WHEN c1 > c2 OR (c1 = c2 AND p1 > p2) THEN p2 ELSE p1 END AS pos1,
    greatest(c1, c2) AS chr2_idx, CASE WHEN c1 > c2 OR (c1 = c2 AND p1 > p2) THEN p1 ELSE p2 END AS pos2
  FROM both_ends WHERE c2 IS NOT NULL
)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr1_idx, chr2_idx, bin_size, bin_x, bin_y, counts."""
    bins = pairs(spark, sf_dir).select("chr1_idx", "chr2_idx", F.lit(BIN).alias("bin_size"), F.expr(f"cast(pos1 div {BIN} as int)").alias("bin_x"), F.expr(f"cast(pos2 div {BIN} as int)").alias("bin_y"))
    return bins.groupBy(*bins.columns).agg(F.count("*").cast("double").alias("counts"))


CONTACTS = f"""{PAIRS}, contacts AS (
  SELECT chr1_idx, chr2_idx, 3600 AS bin_size, (pos1 // 3600)::INTEGER AS bin_x, (pos2 // 3600)::INTEGER AS bin_y, count(*)::DOUBLE AS counts
  FROM pairs GROUP BY ALL
), intra AS (SELECT * FROM contacts WHERE chr1_idx = chr2_idx)"""


def intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).where("chr1_idx = chr2_idx")


COVERAGE = f"""{CONTACTS}, both_triangles AS (
  SELECT chr1_idx AS chr_idx, bin_x AS bin, counts FROM intra UNION ALL SELECT chr1_idx, bin_y, counts FROM intra WHERE bin_x <> bin_y
), row_sums AS (SELECT chr_idx, bin, sum(counts) AS s FROM both_triangles GROUP BY ALL
), vc AS (SELECT chr_idx, bin, s / avg(s) OVER (PARTITION BY chr_idx) AS value FROM row_sums)"""

FACTORS_SQL = "factors AS (SELECT i::INTEGER AS chr_idx, 1 + i / 10.0::DOUBLE AS factor FROM range(1, 5) t(i))"


def factors(spark: SparkSession) -> DataFrame:
    """Chromosome 5 has none, so that 1 stands for it."""
    return spark.createDataFrame([(i, 1 + i / 10.0) for i in range(1, 5)], "chr_idx int, factor double")


EXPECTED = f"""{CONTACTS}, {FACTORS_SQL}, mean AS (SELECT bin_y - bin_x AS d, avg(counts) AS v FROM intra GROUP BY 1
), expected AS (SELECT i::INTEGER AS dist, coalesce(v, 0.0) AS value FROM range(720) t(i) LEFT JOIN mean ON d = i)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of six hours around the ends of pairs within a chromosome."""
    own = pairs(spark, sf_dir).where("chr1_idx = chr2_idx")
    start = lambda p: F.expr(f"{p} div {BIN} * {BIN}")
    return own.select(F.col("event_id").alias("feature_id"), "chr1_idx", start("pos1").alias("start1"), (start("pos1") + 6 * BIN).alias("end1"), "chr2_idx", start("pos2").alias("start2"), (start("pos2") + 6 * BIN).alias("end2"))


FEATURES = f"""{PAIRS}, features AS (
  SELECT event_id AS feature_id, chr1_idx, pos1 // 3600 * 3600 AS start1, pos1 // 3600 * 3600 + 21600 AS end1,
    chr2_idx, pos2 // 3600 * 3600 AS start2, pos2 // 3600 * 3600 + 21600 AS end2
  FROM pairs WHERE chr1_idx = chr2_idx
), a AS (SELECT * FROM features WHERE feature_id % 2 = 0), b AS (SELECT * FROM features WHERE feature_id % 2 = 1)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one matrix: row, col, value."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "value")).select("row", "col", F.col("value").cast("double").alias("value"))


MATRIX = "m AS (SELECT vec_id::INTEGER AS row, (unnest(range(1, len(embedding) + 1)) - 1)::INTEGER AS col, unnest(embedding)::DOUBLE AS value FROM embeddings)"
COLUMNS = 64
