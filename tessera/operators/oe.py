"""Observed over expected, six ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import clamp, finite_or, ieee_div, ieee_ln

KINDS = ("LOG_BASE_EXP_OF_OBS", "TRUE_OE_LOG", "LOG_OE_BOUNDED", "LOG_OE_BOUNDED_SCALED_BTWN_ZERO_ONE", "TRUE_OE", "TRUE_OE_LINEAR")


def oe_value(kind: str, observed: Column, expected: Column, threshold: float = 5.0, pseudocount: float = 1.0, invalid: float = 0.0) -> Column:
    """The pseudocount is added to both; results that are not finite become invalid."""
    o, e = observed.cast("double") + pseudocount, expected.cast("double") + pseudocount
    ratio = ieee_div(o, e)
    match kind:
        case "LOG_BASE_EXP_OF_OBS":
            value = ieee_div(ieee_ln(o), ieee_ln(e))
        case "TRUE_OE_LOG":
            value = ieee_ln(ratio)
        case "LOG_OE_BOUNDED":
            value = clamp(ieee_ln(ratio), -threshold, threshold)
        case "LOG_OE_BOUNDED_SCALED_BTWN_ZERO_ONE":
            value = (clamp(ieee_ln(ratio), -threshold, threshold) + threshold) / (2 * threshold)
        case "TRUE_OE":
            value = ratio
        case "TRUE_OE_LINEAR":
            value = F.when(ratio < 1, 1 - ieee_div(F.lit(1.0), ratio)).otherwise(ratio - 1)
        case _:
            raise ValueError(f"{kind} is none of {KINDS}")
    return finite_or(value, invalid)


def with_oe(contacts: DataFrame, kind: str, **options: float) -> DataFrame:
    """contacts with expected, and its column oe."""
    return contacts.withColumn("oe", oe_value(kind, F.col("counts"), F.col("expected"), **options))


def inter_expected(average: Column) -> Column:
    """An inter map's expected value is its average count, or 1 if that is not above 0."""
    return F.when(average > 0, average).otherwise(1.0)


def expected_region(spark, vector: DataFrame, x0: int, y0: int, rows: int, cols: int) -> DataFrame:
    """The expected value of every cell of a region, looked up by |x - y|."""
    end = vector.agg(F.max("dist").alias("__n"))  # one row
    cells = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    at = cells.join(F.broadcast(end), F.lit(True)).withColumn("dist", F.least(F.abs((F.col("row") + x0) - (F.col("col") + y0)), F.col("__n")))
    return at.join(vector.select("dist", "value"), "dist", "left").select("row", "col", "value")
