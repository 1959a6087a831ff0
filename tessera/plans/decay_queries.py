"""Distance decay: means, expected values, smoothing, moments and splines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import semantics
from tessera.operators import decay
from tessera.plans.register import query
from tessera.sources import derived
from tessera.sources.derived import CONTACTS, EXPECTED


def _dist() -> Column:
    return F.abs(F.col("bin_x") - F.col("bin_y"))


def _vector(spark: SparkSession, d: str) -> DataFrame:
    return decay.densify(decay.mean_by_distance(derived.intra(spark, d)), 720)


@query(f"WITH {CONTACTS} SELECT bin_y - bin_x AS dist, count(*) AS n, round(avg(counts), 6) AS value FROM intra GROUP BY ALL")
def decay_mean_by_distance(spark: SparkSession, d: str) -> DataFrame:
    return decay.mean_by_distance(derived.intra(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {CONTACTS} SELECT bin_y - bin_x AS dist, count(*) AS n, round(exp(avg(ln(1 + counts))) - 1, 6) AS value FROM intra WHERE bin_y - bin_x < 50 GROUP BY ALL")
def decay_log_mean(spark: SparkSession, d: str) -> DataFrame:
    return decay.mean_by_distance(derived.intra(spark, d), 50, use_log=True).withColumn("value", F.round("value", 6))


@query(
    f"WITH {EXPECTED} SELECT chr1_idx, bin_x, bin_y, round(value / coalesce(factor, 1.0), 6) AS expected "
    "FROM (SELECT *, least(bin_y - bin_x, 39) AS d FROM intra) JOIN expected ON dist = d LEFT JOIN factors ON chr_idx = chr1_idx"
)
def expected_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Distances beyond the end of the vector take its last value."""
    got = decay.with_expected(derived.intra(spark, d), _vector(spark, d).where("dist < 40"), derived.factors(spark))
    return got.select("chr1_idx", "bin_x", "bin_y", F.round("expected", 6).alias("expected"))


_BY_CHR = f"{EXPECTED}, v AS (SELECT chr_idx, dist, value * (1.0 / factor) AS value FROM expected CROSS JOIN factors)"


@query(f"WITH {_BY_CHR} SELECT chr_idx, dist, round(value, 6) AS value FROM v")
def expected_by_chromosome(spark: SparkSession, d: str) -> DataFrame:
    return decay.with_factors(_vector(spark, d), derived.factors(spark)).withColumn("value", F.round("value", 6))


@query(
    f"""WITH {_BY_CHR} SELECT a.chr_idx, a.dist, round(median(b.value::FLOAT)::DOUBLE, 4) AS value FROM v a JOIN v b ON b.chr_idx = a.chr_idx
AND b.dist BETWEEN CASE WHEN a.dist < 5 THEN 0 ELSE a.dist - 5 END AND CASE WHEN a.dist < 5 THEN 2 * a.dist ELSE a.dist + 5 END GROUP BY a.chr_idx, a.dist"""
)
def expected_corrected(spark: SparkSession, d: str) -> DataFrame:
    smooth = decay.corrected(decay.with_factors(_vector(spark, d), derived.factors(spark)), 18_000, 3600, "chr_idx")
    return smooth.withColumn("value", F.round("value", 4))


@query(f"WITH {_BY_CHR} SELECT chr_idx, dist, round(CASE WHEN dist >= 10 THEN avg(value) OVER (PARTITION BY chr_idx ORDER BY dist ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) ELSE value END, 6) AS value FROM v")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return decay.rolling_mean(decay.with_factors(_vector(spark, d), derived.factors(spark)), 4, 10, "chr_idx").withColumn("value", F.round("value", 6))


_BUCKETS = f"{CONTACTS}, b AS (SELECT *, CASE WHEN bin_x = bin_y THEN 0 ELSE 1 + floor(ln(1 + bin_y - bin_x))::INTEGER END AS bucket FROM intra)"
_MOMENTS = "SELECT bucket, count(*) AS n, avg(counts) AS mean, CASE WHEN count(*) > 2 THEN stddev_samp(counts) ELSE 0.0 END AS std, min(counts) AS min, greatest(max(counts), 0.0) AS max FROM b GROUP BY bucket"


@query(f"WITH {_BUCKETS} SELECT bucket, n, round(mean, 6) AS mean, round(std, 6) AS std, min, max, max - min AS range FROM ({_MOMENTS})")
def welford_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    got = decay.moments(derived.intra(spark, d).withColumn("bucket", decay.log_bucket(_dist())), "bucket", "counts")
    return got.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"WITH {_BUCKETS}, s AS ({_MOMENTS}) SELECT chr1_idx, bin_x, bin_y, CASE WHEN std > 0 THEN round((counts - mean) / std, 6) END AS z FROM b JOIN s USING (bucket)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    own = derived.intra(spark, d).withColumn("bucket", decay.log_bucket(_dist()))
    stats = decay.moments(own, "bucket", "counts").select("bucket", "mean", "std")
    z = decay.zscore(F.col("counts"), F.col("mean"), F.col("std"))
    return own.join(F.broadcast(stats), "bucket").select("chr1_idx", "bin_x", "bin_y", F.when(F.col("std") > 0, F.round(z, 6)).alias("z"))  # a row a bucket, which are logarithms of the distance


@query(
    f"""WITH {CONTACTS}, per AS (SELECT bin_y - bin_x AS d, count(*) AS n, sum(ln(1 + counts)) AS s FROM intra WHERE bin_y - bin_x < 90 GROUP BY 1
), tiers AS (SELECT k, floor(ln(0.4 * k + 1) / ln(5) + 1e-9) AS tier FROM range(90) t(k)
), placed AS (SELECT k, tier, 10 * tier + floor((k - 10 * (5 ** tier - 1) / 4) / 5 ** tier) AS g FROM tiers
), groups AS (SELECT g, any_value(tier) AS tier, count(*) AS places, coalesce(sum(n), 0) AS n, sum(s) AS s, avg(ln(1 + k)) AS x FROM placed LEFT JOIN per ON d = k GROUP BY g
), tail AS (SELECT sum(n) AS n, sum(s) AS s FROM per WHERE d >= 67)
SELECT round(x, 6) AS x, round(s / n, 6) AS y FROM groups WHERE n > 0 AND (places = 5 ** tier OR (places > 10 AND n > 100))
UNION ALL SELECT round(ln(91) + 1, 6), round(s / n, 6) FROM tail WHERE n > 0"""
)
def log_bucket_knots(spark: SparkSession, d: str) -> DataFrame:
    return decay.knots(derived.intra(spark, d), 90).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def spline_expected(spark: SparkSession, d: str) -> DataFrame:
    """The log spline's expected counts and percent contact of every record."""
    own = derived.intra(spark, d)
    model = decay.LogSpline(own, 90)
    return own.select("chr1_idx", "bin_x", "bin_y", F.round(model.expected(_dist()), 6).alias("expected"), F.round(model.percent_contact(F.col("counts"), _dist()), 6).alias("percent_contact"))


@query()
def spline_zscore(spark: SparkSession, d: str) -> DataFrame:
    own = derived.intra(spark, d)
    model = decay.ZSpline(own, 90)
    z = model.z(F.col("counts"), _dist())
    return own.select("chr1_idx", "bin_x", "bin_y", F.round(z, 6).alias("z"), F.round(model.expected(_dist()), 6).alias("expected"))


@query(
    f"WITH {CONTACTS} SELECT chr1_idx, bin_x, bin_y, round(ln(counts + 0.5), 6) AS log_value, CASE WHEN counts = 1 THEN NULL ELSE round(ln(counts), 6) END AS clean_log, "
    "round(ln(counts + 1) / ln(3.0), 6) AS log_oe FROM intra"
)
def log_helpers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("counts")
    clean = semantics.simple_log_clean(c)
    return derived.intra(spark, d).select("chr1_idx", "bin_x", "bin_y", F.round(semantics.simple_log(c, 0.5), 6).alias("log_value"), F.when(~F.isnan(clean), F.round(clean, 6)).alias("clean_log"), F.round(semantics.log_oe_plus(c, F.lit(2.0), 1.0), 6).alias("log_oe"))
