"""Interval features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features as X
from tessera.plans.register import query
from tessera.sources import derived
from tessera.sources.derived import FEATURES


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Features of even and of odd events: two lists to compare."""
    every = derived.features(spark, d)
    return every.where("feature_id % 2 = 0"), every.where("feature_id % 2 = 1")


_BOUNDS = "chr1_idx, start1, end1, chr2_idx, start2, end2"


@query(f"WITH {FEATURES} SELECT * FROM features")
def feat_orient(spark: SparkSession, d: str) -> DataFrame:
    """Reflected features find back to their orientation."""
    return X.orient(X.reflect(derived.features(spark, d)))


@query(
    f"WITH {FEATURES} SELECT *, end1 - start1 AS width1, end2 - start2 AS width2, start1 + 10800 AS mid1, start2 + 10800 AS mid2, start1 = start2 AS on_diagonal, start2 > start1 AS lower_left, start2 < start1 AS upper_right FROM features"
)
def feat_geometry(spark: SparkSession, d: str) -> DataFrame:
    return X.with_geometry(derived.features(spark, d))


@query(f"WITH {FEATURES} SELECT abs((start1 + 10800) // 5000 - (start2 + 10800) // 5000) AS distance, count(*) AS n FROM features GROUP BY ALL")
def feat_distance(spark: SparkSession, d: str) -> DataFrame:
    return derived.features(spark, d).groupBy(X.distance(5000).alias("distance")).agg(F.count("*").alias("n"))


@query(f"WITH {FEATURES} SELECT min(feature_id) AS feature_id, {_BOUNDS} FROM features GROUP BY ALL")
def feat_dedup(spark: SparkSession, d: str) -> DataFrame:
    return X.dedup(derived.features(spark, d))


_MEET = "x.chr1_idx = y.chr1_idx AND x.chr2_idx = y.chr2_idx AND x.start1 + 10800 BETWEEN y.start1 - 10800 AND y.end1 + 10800 AND x.start2 + 10800 BETWEEN y.start2 - 10800 AND y.end2 + 10800"


@query(f"WITH {FEATURES} SELECT * FROM a x WHERE EXISTS (SELECT 1 FROM b y WHERE {_MEET})")
def feat_overlap(spark: SparkSession, d: str) -> DataFrame:
    return X.overlap(*_lists(spark, d))


@query(
    f"WITH {FEATURES}, hit AS (SELECT * FROM a x WHERE EXISTS (SELECT 1 FROM b y WHERE x.chr1_idx = y.chr1_idx AND x.chr2_idx = y.chr2_idx AND abs(x.start1 - y.start1) <= 3600 AND abs(x.end1 - y.end1) <= 3600 AND abs(x.start2 - y.start2) <= 3600 AND abs(x.end2 - y.end2) <= 3600)) "
    f"SELECT min(feature_id) AS feature_id, {_BOUNDS} FROM hit GROUP BY ALL"
)
def feat_intersection(spark: SparkSession, d: str) -> DataFrame:
    return X.intersection(*_lists(spark, d), tolerance=3600)


@query()
def feat_add_unique(spark: SparkSession, d: str) -> DataFrame:
    """What is accepted depends on what was before it: checked against brute force in the tests."""
    return X.add_unique(*_lists(spark, d))


@query(
    f"WITH {FEATURES}, points AS (SELECT event_id AS point_id, chr1_idx, chr2_idx, pos1 AS x, pos2 AS y FROM pairs) "
    "SELECT p.point_id, f.feature_id FROM points p JOIN features f ON f.chr1_idx = p.chr1_idx AND f.chr2_idx = p.chr2_idx AND x BETWEEN start1 AND end1 AND y BETWEEN start2 AND end2"
)
def feat_containing(spark: SparkSession, d: str) -> DataFrame:
    points = derived.pairs(spark, d).select(F.col("event_id").alias("point_id"), "chr1_idx", "chr2_idx", F.col("pos1").alias("x"), F.col("pos2").alias("y"))
    return X.containing(derived.features(spark, d), points)


@query(f"WITH {FEATURES}, n AS (SELECT *, row_number() OVER (PARTITION BY {_BOUNDS} ORDER BY feature_id) AS r FROM a) SELECT feature_id, {_BOUNDS} FROM n WHERE r > 1 OR ({_BOUNDS}) NOT IN (SELECT ({_BOUNDS}) FROM b)")
def feat_delete(spark: SparkSession, d: str) -> DataFrame:
    return X.without_first(*_lists(spark, d))


@query(f"WITH {FEATURES} SELECT * FROM a UNION ALL SELECT * FROM b")
def feat_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    return a.unionByName(b)


@query(
    f"WITH {FEATURES} SELECT feature_id, concat_ws(chr(9), 'chr' || chr1_idx, start1, end1, 'chr' || chr2_idx, start2, end2, '.', '.', '.', '.', '0,0,255', feature_id % 7, 'yes') AS line FROM features"
)
def feat_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text with two attributes, one of them set where it is missing."""
    own = derived.features(spark, d).withColumns({"color": F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(255).alias("b")), "attributes": F.create_map(F.lit("score"), (F.col("feature_id") % 7).cast("string"))})
    own = X.set_attribute(own, "seen", F.lit("yes"), only_if_missing=True)
    # "score" before "seen"
    return own.select("feature_id", X.text_line(F.concat(F.lit("chr"), "chr1_idx"), F.concat(F.lit("chr"), "chr2_idx")).alias("line"))


@query(f"SELECT idx::INTEGER AS chr_idx, feature_id, start1 FROM (WITH {FEATURES} SELECT i AS idx, feature_id, start1 FROM range(1, 6) t(i) LEFT JOIN features ON chr1_idx = i)")
def feat_one_dimension(spark: SparkSession, d: str) -> DataFrame:
    own = derived.features(spark, d).select(F.col("chr1_idx").alias("chr_idx"), "feature_id", "start1")
    return X.genome_wide_list(derived.chromosomes(spark), own)
