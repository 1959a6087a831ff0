"""Matrices in coordinate form: all embeddings, a row a vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matrix as M
from tessera.plans.register import query
from tessera.sources import derived
from tessera.sources.derived import COLUMNS, MATRIX


def _m(spark: SparkSession, d: str) -> DataFrame:
    return derived.matrix(spark, d)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def _simple(name: str, function: Callable[[DataFrame], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(function(_m(spark, d)))

    run.__name__ = f"mat_{name}"
    query(f"WITH {MATRIX} {sql}")(run)


_AHEAD = "lead(value, {0}) OVER (PARTITION BY row ORDER BY col)"
_DERIVED = f"d AS (SELECT row, col, value - {_AHEAD.format(1)} AS value FROM m QUALIFY {_AHEAD.format(1)} IS NOT NULL)"

for _name, _function, _sql in (
    ("flatten", lambda m: M.flatten(m, COLUMNS), "SELECT row * 64::BIGINT + col AS pos, round(value, 6) AS value FROM m"),
    ("reshape", lambda m: M.reshape(M.flatten(m, COLUMNS), 32), "SELECT ((row * 64 + col) // 32)::INTEGER AS row, ((row * 64 + col) % 32)::INTEGER AS col, round(value, 6) AS value FROM m"),
    ("cut", lambda m: M.cut(m, 10, 300, 5, 40), "SELECT row - 10 AS row, col - 5 AS col, round(value, 6) AS value FROM m WHERE row BETWEEN 10 AND 299 AND col BETWEEN 5 AND 39"),
    ("transpose", M.transpose, "SELECT col AS row, row AS col, round(value, 6) AS value FROM m"),
    ("flip_left_right", lambda m: M.flip_left_right(m, COLUMNS), "SELECT row, 63 - col AS col, round(value, 6) AS value FROM m"),
    ("flip_top_bottom", lambda m: M.flip_top_bottom(m, 5000), "SELECT 4999 - row AS row, col, round(value, 6) AS value FROM m"),
    ("flip_anti_diagonal", lambda m: M.flip_anti_diagonal(m, 5000), "SELECT 4999 - col AS row, 4999 - row AS col, round(value, 6) AS value FROM m"),
    ("diagonal", M.diagonal, "SELECT row, round(value, 6) AS value FROM m WHERE row = col"),
    ("symmetric_from_upper", M.symmetric_from_upper, "SELECT row, col, round(value, 6) AS value FROM m WHERE row <= col UNION ALL SELECT col, row, round(value, 6) FROM m WHERE row < col"),
    ("multiply", lambda m: M.multiply_cells(m, M.flip_left_right(m, COLUMNS)), "SELECT a.row, a.col, round(a.value * b.value, 6) AS value FROM m a JOIN m b ON a.row = b.row AND b.col = 63 - a.col"),
    ("divide", lambda m: M.divide_cells(m, M.flip_left_right(m.withColumn("value", F.col("value") + 10), COLUMNS)), "SELECT a.row, a.col, round(a.value / (b.value + 10), 6) AS value FROM m a JOIN m b ON a.row = b.row AND b.col = 63 - a.col"),
    ("replace", lambda m: M.replace(M.sign(m), -1.0, 7.0), "SELECT row, col, CASE WHEN value < 0 THEN 7.0 WHEN value > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM m"),
    ("sign", M.sign, "SELECT row, col, sign(value)::DOUBLE AS value FROM m"),
    ("nan_to", lambda m: M.nan_to(m.withColumn("value", F.when(F.col("value") < 0, F.lit(float("nan"))).otherwise(F.col("value")))), "SELECT row, col, round(CASE WHEN value < 0 THEN 0.0 ELSE value END, 6) AS value FROM m"),
    ("threshold_upper", lambda m: M.threshold_upper(m, 0.1), "SELECT row, col, round(least(value, 0.1::DOUBLE), 6) AS value FROM m"),
    ("threshold_both", lambda m: M.threshold_both(m, 0.1), "SELECT row, col, round(greatest(-0.1::DOUBLE, least(value, 0.1::DOUBLE)), 6) AS value FROM m"),
    ("measures", M.measures, "SELECT round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(min(value) FILTER (WHERE value > 0), 6) AS min_positive FROM m"),
    ("divide_by_max", M.divide_by_max, "SELECT row, col, round(value / (SELECT max(value) FROM m), 6) AS value FROM m"),
    ("row_sums", M.row_sums, "SELECT row, round(sum(value), 6) AS value FROM m GROUP BY row"),
    ("abs_column_sums", M.abs_column_sums, "SELECT col, round(sum(abs(value)), 6) AS value FROM m GROUP BY col"),
    ("row_medians", M.row_medians, "SELECT row, round(median(value), 6) AS value FROM m GROUP BY row"),
    (
        "normalise_by_sums",
        lambda m: M.normalise_by_sums(m.withColumn("value", F.floor(F.abs("value") * 100) + F.when(F.col("col") == 0, 1).otherwise(0)), "row"),
        ", w AS (SELECT row, col, floor(abs(value) * 100)::BIGINT + (col = 0)::BIGINT AS v FROM m) SELECT row, col, v // (sum(v) OVER (PARTITION BY row))::BIGINT AS value FROM w",
    ),
    (
        "percentile_bounds",
        M.percentile_bounds,
        ", r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM m), p AS (SELECT 5 * (n + 1) / 100.0 AS a, 95 * (n + 1) / 100.0 AS b, n FROM r LIMIT 1), "
        "picked AS (SELECT (SELECT value FROM r WHERE k = floor(a)) AS a0, (SELECT value FROM r WHERE k = floor(a) + 1) AS a1, a - floor(a) AS da, (SELECT value FROM r WHERE k = floor(b)) AS b0, (SELECT value FROM r WHERE k = floor(b) + 1) AS b1, b - floor(b) AS db FROM p) "
        "SELECT round(a0 + (a1 - a0) * da::DOUBLE, 6) AS lower, round(b0 + (b1 - b0) * db::DOUBLE, 6) AS upper FROM picked",
    ),
    ("paste", lambda m: M.paste(m, M.transpose(M.cut(m, 0, 20, 0, 30)), 3, 4), "SELECT row, col, round(value, 6) AS value FROM m WHERE NOT (row BETWEEN 3 AND 32 AND col BETWEEN 4 AND 23) UNION ALL SELECT col + 3, row + 4, round(value, 6) FROM m WHERE row < 20 AND col < 30"),
    ("stitch", lambda m: M.stitch_rows([(m, 5000), (m, 5000)]), "SELECT row, col, round(value, 6) AS value FROM m UNION ALL SELECT row + 5000, col, round(value, 6) FROM m"),
    ("composite", lambda m: M.composite(m, M.transpose(m), m, 5000), "SELECT row, col, round(value, 6) AS value FROM m UNION ALL SELECT col, row + 5000, round(value, 6) FROM m UNION ALL SELECT row + 5000, col, round(value, 6) FROM m UNION ALL SELECT row + 5000, col + 5000, round(value, 6) FROM m"),
    ("label_region", lambda m: M.label_region(m, 5, 50, 6, 60), "SELECT row, col, CASE WHEN row BETWEEN 5 AND 49 AND col BETWEEN 6 AND 59 THEN 1.0 ELSE round(value, 6) END AS value FROM m"),
    (
        "label_above_average",
        lambda m: M.label_above_average(m, m, 5, 50, 6, 60),
        "SELECT row, col, CASE WHEN row BETWEEN 5 AND 49 AND col BETWEEN 6 AND 59 AND value > (SELECT avg(value) FROM m WHERE row BETWEEN 5 AND 49 AND col BETWEEN 6 AND 59) THEN 1.0 ELSE round(value, 6) END AS value FROM m",
    ),
    ("derivative", M.derivative, f", {_DERIVED} SELECT row, col, round(value, 6) AS value FROM d"),
    ("convolve", lambda m: M.convolve(m, [1.0, 0.0, -2.0]), f"SELECT row, col, round(value - 2 * {_AHEAD.format(2)}, 6) AS value FROM m QUALIFY {_AHEAD.format(2)} IS NOT NULL"),
    ("with_derivative", lambda m: M.with_derivative(m, COLUMNS, 0.5), f", {_DERIVED} SELECT row, col, round(greatest(-0.5::DOUBLE, least(value, 0.5::DOUBLE)), 6) AS value FROM m UNION ALL SELECT row, col + 64, round(value, 6) FROM d"),
    (
        "smoothed_with_derivative",
        lambda m: M.smoothed_with_derivative(m, COLUMNS, [1.0, 1.0]),
        f", s AS (SELECT row, col, value + {_AHEAD.format(1)} AS value FROM m QUALIFY {_AHEAD.format(1)} IS NOT NULL) SELECT row, col, round(value, 6) AS value FROM s UNION ALL (SELECT row, col + 63, round(value - {_AHEAD.format(1)}, 6) FROM s QUALIFY {_AHEAD.format(1)} IS NOT NULL)",
    ),
    ("relevant_derivative", lambda m: M.relevant_derivative(m, 2.0, 0.2, positive=True), f", {_DERIVED} SELECT row, col, round(greatest(-0.2::DOUBLE, least(value * 2, 0.2::DOUBLE)) + 0.2, 6) AS value FROM d"),
    ("over_row_mean", lambda m: M.over_row_statistic(m.withColumn("value", F.abs("value")), "mean", 2.0), "SELECT row, col, round(least(abs(value) / avg(abs(value)) OVER (PARTITION BY row), 2.0), 6) AS value FROM m"),
    ("over_row_median", lambda m: M.over_row_statistic(m.withColumn("value", F.abs("value")), "median", 2.0), "SELECT row, col, round(least(abs(value) / median(abs(value)) OVER (PARTITION BY row), 2.0), 6) AS value FROM m"),
    (
        "normed",
        lambda m: M.normed(m, M.row_sums(m).withColumnRenamed("row", "bin"), M.abs_column_sums(m).withColumnRenamed("col", "bin")),
        ", r AS (SELECT row, sum(value) AS s FROM m GROUP BY row), c AS (SELECT col, sum(abs(value)) AS s FROM m GROUP BY col) SELECT row, col, CASE WHEN r.s * c.s > 0 THEN round(value / (r.s * c.s), 6) ELSE 0.0 END AS value FROM m JOIN r USING (row) JOIN c USING (col)",
    ),
):
    _simple(_name, _function, _sql)
