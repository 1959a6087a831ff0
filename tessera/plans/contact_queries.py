"""Scans, regions, normalisation and aggregation of contact maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.operators import contacts as C
from tessera.operators import correlate, genome, oe
from tessera.plans.register import query
from tessera.sources import derived
from tessera.sources.derived import CHROMOSOMES, CONTACTS, COVERAGE, EXPECTED


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {CONTACTS} SELECT * FROM contacts WHERE chr1_idx = 1 AND chr2_idx = 2")
def contacts_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.scan(derived.contacts(spark, d), 2, 1, 3600)


@query(f"WITH {CONTACTS} SELECT * FROM intra WHERE (bin_x BETWEEN 100 AND 300 AND bin_y BETWEEN 120 AND 400) OR (bin_x BETWEEN 120 AND 400 AND bin_y BETWEEN 100 AND 300)")
def region_query(spark: SparkSession, d: str) -> DataFrame:
    return C.region(derived.intra(spark, d), 100, 120, 300, 400, below=True)


@query(f"WITH {CONTACTS} SELECT chr1_idx, chr2_idx, bin_size, bin_x, bin_y, counts, bin_x::BIGINT * 3600 AS x, bin_y::BIGINT * 3600 AS y FROM contacts WHERE counts > 0")
def positive_positions(spark: SparkSession, d: str) -> DataFrame:
    return C.to_positions(C.positive(derived.contacts(spark, d)))


@query(f"WITH {CONTACTS} SELECT * FROM intra UNION ALL SELECT chr1_idx, chr2_idx, bin_size, bin_y, bin_x, counts FROM intra WHERE bin_x <> bin_y")
def mirror(spark: SparkSession, d: str) -> DataFrame:
    return C.mirror(derived.intra(spark, d))


_CELLS = "(SELECT bin_x - 100 AS row, bin_y - 120 AS col, counts, 1 AS way FROM intra WHERE chr1_idx = 1 UNION ALL SELECT bin_y - 100, bin_x - 120, counts, CASE WHEN bin_x = bin_y THEN 2 ELSE 1 END FROM intra WHERE chr1_idx = 1)"


@query(f"WITH {CONTACTS} SELECT row, col, sum(counts) AS value FROM {_CELLS} WHERE row BETWEEN 0 AND 299 AND col BETWEEN 0 AND 399 GROUP BY ALL")
def region_clip_sum(spark: SparkSession, d: str) -> DataFrame:
    return C.clip_sum(C.scan(derived.contacts(spark, d), 1, 1, 3600), 100, 120, 300, 400)


@query(f"WITH {CONTACTS} SELECT row, col, counts AS value FROM {_CELLS} WHERE way = 1 AND row BETWEEN 0 AND 299 AND col BETWEEN 0 AND 399")
def region_clip_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return C.clip_overwrite(C.scan(derived.contacts(spark, d), 1, 1, 3600), 100, 120, 300, 400)


@query(f"WITH {CONTACTS} SELECT CASE WHEN bin_x BETWEEN 100 AND 299 THEN bin_x ELSE bin_y END - 100 AS row, sum(counts) AS value FROM intra WHERE chr1_idx = 3 AND (bin_x BETWEEN 100 AND 299 OR bin_y BETWEEN 100 AND 299) GROUP BY ALL")
def region_row_sums(spark: SparkSession, d: str) -> DataFrame:
    return C.region_row_sums(C.scan(derived.contacts(spark, d), 3, 3, 3600), 100, 299)


@query(f"WITH {CONTACTS} SELECT chr1_idx, chr2_idx, bin_size, count(*) AS n, count(*) FILTER (WHERE counts > 0) AS n_positive, sum(counts * CASE WHEN bin_x <> bin_y THEN 2 ELSE 1 END) AS total FROM contacts GROUP BY ALL")
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.summary(derived.contacts(spark, d))


@query(f"WITH {CONTACTS} SELECT chr1_idx, chr2_idx, bin_size, round(sum(counts) / 720 / 720, 9) AS average FROM contacts GROUP BY ALL")
def average_count(spark: SparkSession, d: str) -> DataFrame:
    return C.average_count(derived.contacts(spark, d), derived.chromosomes(spark)).withColumn("average", F.round("average", 9))


@query(f"WITH {CONTACTS} SELECT chr1_idx, chr2_idx, 21600 AS bin_size, bin_x // 6 AS bin_x, bin_y // 6 AS bin_y, sum(counts) AS counts FROM contacts GROUP BY ALL")
def coarsen(spark: SparkSession, d: str) -> DataFrame:
    return C.coarsen(derived.contacts(spark, d), 21600, C.source_resolution([3600, 7000], 21600))


@query(f"WITH {CONTACTS} SELECT chr1_idx, chr2_idx, bin_x + (chr1_idx - 1) * 721::BIGINT AS bin_x, bin_y + (chr2_idx - 1) * 721::BIGINT AS bin_y, counts FROM contacts")
def genome_wide_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.with_offsets(derived.contacts(spark, d), genome.pairs(derived.chromosomes(spark), 3600))


_NORMED = "FROM intra i JOIN {0} v ON v.chr_idx = chr1_idx AND v.bin = bin_x JOIN {0} w ON w.chr_idx = chr1_idx AND w.bin = bin_y"


@query(f"WITH {COVERAGE} SELECT 'VC' AS norm, chr_idx, 3600 AS bin_size, bin, round(value, 6) AS value FROM vc")
def coverage_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.coverage_vectors(derived.intra(spark, d)), "value")


@query(f"WITH {COVERAGE} SELECT chr1_idx, chr2_idx, bin_size, bin_x, bin_y, round(counts / (v.value * w.value), 6) AS counts {_NORMED.format('vc')}")
def normalize_vc(spark: SparkSession, d: str) -> DataFrame:
    own = derived.intra(spark, d)
    return _rounded(C.normalise(own, C.vector(C.coverage_vectors(own), "vc")), "counts")


@query(
    f"WITH {COVERAGE}, odd AS (SELECT chr_idx, bin, CASE WHEN bin % 97 = 0 THEN 0.0 ELSE value END AS value FROM vc WHERE bin % 89 <> 0) "
    f"SELECT chr1_idx, chr2_idx, bin_size, bin_x, bin_y, v.value * w.value = 0 AS infinite, CASE WHEN v.value * w.value <> 0 THEN round(counts / (v.value * w.value), 6) END AS counts {_NORMED.format('odd')}"
)
def normalize_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Zero factors give infinities, which stay; NaN factors drop records."""
    own = derived.intra(spark, d)
    value = F.when(F.col("bin") % 89 == 0, F.lit(float("nan"))).when(F.col("bin") % 97 == 0, 0.0).otherwise(F.col("value"))
    normed = C.normalise(own, C.coverage_vectors(own).withColumn("value", value))
    infinite = F.col("counts") == float("inf")
    return normed.select("chr1_idx", "chr2_idx", "bin_size", "bin_x", "bin_y", infinite.alias("infinite"), F.when(~infinite, F.round("counts", 6)).alias("counts"))


@query(f"WITH {COVERAGE}, r AS (SELECT chr_idx, bin, sqrt(value) AS value FROM vc) SELECT chr1_idx, chr2_idx, bin_size, bin_x, bin_y, round(counts / (v.value * w.value), 6) AS counts {_NORMED.format('r')}")
def normalize_vc_sqrt_fallback(spark: SparkSession, d: str) -> DataFrame:
    own = derived.intra(spark, d)
    return _rounded(C.normalise(own, C.vector(C.coverage_vectors(own), "VC_SQRT")), "counts")


@query(f"WITH {COVERAGE} SELECT chr_idx, 3600 AS bin_size, bin - 100 AS bin, round(value, 6) AS value FROM vc WHERE bin BETWEEN 100 AND 200")
def norm_slice(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.vector_slice(C.vector(C.coverage_vectors(derived.intra(spark, d)), "VC"), 100, 200), "value")


@query(
    f"WITH {COVERAGE}, n AS (SELECT chr1_idx, bin_x, bin_y, counts / (v.value * w.value) AS c {_NORMED.format('vc')}) "
    "SELECT chr1_idx, chr1_idx AS chr2_idx, 3600 AS bin_size, bin, round(sum(c), 6) AS value FROM (SELECT chr1_idx, bin_x AS bin, c FROM n UNION ALL SELECT chr1_idx, bin_y, c FROM n WHERE bin_x <> bin_y) GROUP BY ALL"
)
def norm_row_sums(spark: SparkSession, d: str) -> DataFrame:
    own = derived.intra(spark, d)
    return _rounded(C.symmetric_row_sums(C.normalise(own, C.coverage_vectors(own).drop("norm"))), "value")


@query(f"WITH {CONTACTS} SELECT chr1_idx, (bin_y // 50 * 15 + bin_x // 50)::INTEGER AS block, (floor(log2(1 + abs(bin_x - bin_y) / sqrt(2) / 50)) * 15 + floor((bin_x + bin_y) / 2 / 50))::INTEGER AS diagonal_block, count(*) AS n FROM intra GROUP BY ALL")
def block_numbers(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("bin_x"), F.col("bin_y")
    return derived.intra(spark, d).groupBy("chr1_idx", C.block_number(x, y, 50, 15).alias("block"), C.diagonal_block_number(x, y, 50, 15).alias("diagonal_block")).agg(F.count("*").alias("n"))


_OE = """, oe AS (
  SELECT i.*, x.value / coalesce(f.factor, 1.0) AS e FROM (SELECT chr1_idx, bin_x, bin_y, counts, least(bin_y - bin_x, 719) AS d FROM intra) i
  JOIN expected x ON x.dist = d LEFT JOIN factors f ON f.chr_idx = chr1_idx
)"""


def _with_expected(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import decay

    own = derived.intra(spark, d)
    return decay.with_expected(own, decay.densify(decay.mean_by_distance(own), 720), derived.factors(spark))


def _oe_query(kind: str, name: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return oe.with_oe(_with_expected(spark, d), kind, threshold=0.3).select("chr1_idx", "bin_x", "bin_y", F.round("oe", 6).alias("oe"))

    run.__name__ = name
    query(f"WITH {EXPECTED}{_OE} SELECT chr1_idx, bin_x, bin_y, round({sql}, 6) AS oe FROM oe")(run)


_LOG = "ln((counts + 1) / (e + 1))"
_BOUNDED = f"greatest(-0.3, least(0.3, {_LOG}))"
for _kind, _name, _sql in (
    ("TRUE_OE", "oe_true", "(counts + 1) / (e + 1)"),
    ("TRUE_OE_LOG", "oe_log", _LOG),
    ("LOG_OE_BOUNDED", "oe_log_bounded", _BOUNDED),
    ("LOG_OE_BOUNDED_SCALED_BTWN_ZERO_ONE", "oe_log_scaled", f"({_BOUNDED} + 0.3) / 0.6"),
    ("TRUE_OE_LINEAR", "oe_linear", "CASE WHEN (counts + 1) / (e + 1) < 1 THEN 1 - (e + 1) / (counts + 1) ELSE (counts + 1) / (e + 1) - 1 END"),
    ("LOG_BASE_EXP_OF_OBS", "oe_log_base", "ln(counts + 1) / ln(e + 1)"),
):
    _oe_query(_kind, _name, _sql)


@query(f"WITH {EXPECTED} SELECT (i // 60)::INTEGER AS row, (i % 60)::INTEGER AS col, round(value, 6) AS value FROM range(2400) t(i) JOIN expected ON dist = abs((i // 60 + 10) - (i % 60 + 20))")
def expected_region(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import decay

    return _rounded(oe.expected_region(spark, decay.densify(decay.mean_by_distance(derived.intra(spark, d)), 720), 10, 20, 40, 60), "value")


@query(
    f"WITH {EXPECTED}{_OE} SELECT chr1_idx, bin_x, bin_y, round(counts / e, 6) AS oe, round(ln(counts / e), 6) AS oev2, round(counts - e, 6) AS ome, round(ln(counts + 1) / ln(e + 1), 6) AS logeo, "
    "round((counts / e) / (2.0 / 1.5), 6) AS oeratio, round((counts / 2.0) * (2.5 / 1.25), 6) AS ratio, round(counts - 2.0, 6) AS diff FROM oe"
)
def matrix_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Matrix kinds by their labels, with constants for the control's values."""
    values = {"o": F.col("counts"), "e": F.col("expected"), "c": F.lit(2.0), "ec": F.lit(1.5), "avg_o": F.lit(1.25), "avg_c": F.lit(2.5), "e0": F.lit(1.0), "ec0": F.lit(1.0)}
    kinds = {"oe": "oe", "oev2": "OEV2", "ome": "OME", "logeo": "LOGEO", "oeratio": "OERATIO", "ratio": "RATIO", "diff": "DIFF"}
    return _with_expected(spark, d).select("chr1_idx", "bin_x", "bin_y", *(F.round(catalog.matrix_kind(k, values), 6).alias(n) for n, k in kinds.items()))


_COARSE = "coarse AS (SELECT chr1_idx, bin_x // 6 AS bin_x, bin_y // 6 AS bin_y, sum(counts) AS counts FROM intra GROUP BY ALL)"


def _coarse_oe(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import decay

    coarse = C.coarsen(derived.intra(spark, d), 21600, 3600)
    expected = decay.with_expected(coarse, decay.densify(decay.mean_by_distance(coarse), 120), derived.factors(spark))
    return oe.with_oe(expected, "TRUE_OE", pseudocount=0.0)


@query(
    f"""WITH {CONTACTS}, {derived.FACTORS_SQL}, {_COARSE}, mean AS (SELECT bin_y - bin_x AS d, avg(counts) AS v FROM coarse GROUP BY 1
), oe AS (SELECT chr1_idx AS c, bin_x, bin_y, counts / (v / coalesce(factor, 1.0)) AS a FROM coarse JOIN mean ON d = bin_y - bin_x LEFT JOIN factors ON chr_idx = chr1_idx
), full_map AS (SELECT c, bin_x AS i, bin_y AS k, a FROM oe UNION ALL SELECT c, bin_y, bin_x, a FROM oe WHERE bin_x <> bin_y
), dense AS (SELECT c, i, k, coalesce(a, 0.0) AS a FROM (SELECT DISTINCT c, i FROM full_map) CROSS JOIN (SELECT r::INTEGER AS k FROM range(120) t(r)) LEFT JOIN full_map USING (c, i, k)
), filled AS (SELECT d.c, d.i, d.k, d.a - coalesce(m.m, 0.0) AS a FROM dense d LEFT JOIN (SELECT c, k, sum(a) / 120 AS m FROM full_map GROUP BY c, k) m USING (c, k))
SELECT x.c AS chr_idx, x.i AS row, y.i AS col, round(CASE WHEN x.i = y.i THEN 1.0 ELSE corr(x.a, y.a) END, 6) AS value FROM filled x JOIN filled y USING (c, k) GROUP BY x.c, x.i, y.i"""
)
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(correlate.pearson(_coarse_oe(spark, d), 120, 32), "value")


@query()
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    """The leading eigenvector of each chromosome's Pearson matrix; SQL has no such iteration (tested against a dense decomposition)."""
    return _rounded(correlate.eigenvector(_coarse_oe(spark, d), 120), "value")
