"""Text sinks: matrices a row a line, and lists of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import features


#: Fixed value: the columns of a feature list before its attributes.
FEATURE_HEADER = ("#chr1", "x1", "x2", "chr2", "y1", "y2", "name", "score", "strand1", "strand2", "color")


def _cells(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("cells"))


def matrix_lines(matrix: DataFrame, separator: str = ", ", brackets: bool = False) -> DataFrame:
    """row, line: the values of a row in the order of their columns, in brackets if asked for; a row is as long as the matrix is wide."""
    line = F.concat_ws(separator, F.transform("cells", lambda c: c["value"].cast("string")))
    return _cells(matrix).select("row", (F.concat(F.lit("["), line, F.lit("]")) if brackets else line).alias("line"))


def rounded_lines(matrix: DataFrame, closing_zero: bool = True) -> DataFrame:
    """row, line: values of three decimals at most, half to even; each line ends in one more 0, as such files have it, unless that is turned off."""
    text = lambda v: F.when(F.isnan(v), "NaN").otherwise(F.bround(v, 3).cast("string"))
    line = F.array_join(F.transform("cells", lambda c: text(c["value"])), ", ")
    return _cells(matrix).select("row", (F.concat(line, F.lit(", 0")) if closing_zero else line).alias("line"))


def write_matrix(matrix: DataFrame, path: str, separator: str = ", ", mode: str = "error", brackets: bool = False) -> None:
    """Text files whose order is that of the rows."""
    matrix_lines(matrix, separator, brackets).orderBy("row").select("line").write.mode(mode).text(path)


def feature_header(rows: DataFrame) -> str:
    """The header line: the fixed columns, and the attributes of the first feature by name."""
    first = rows.orderBy("feature_id").select(features.attribute_keys().alias("k")).first()
    return "\t".join([*FEATURE_HEADER, *(first["k"] if first else [])])


def write_features(rows: DataFrame, path: str, mode: str = "error", header: bool = True) -> None:
    """The header, then a line a feature, in order; mode append adds to what is there, and goes without a header."""
    lines = features.in_order(rows).select(features.text_line(F.col("chr1"), F.col("chr2")).alias("line"))
    if header and mode != "append":
        order = F.struct(*features.KEY, "start1", "start2", "end1", "end2")
        body = rows.select(F.lit(1).alias("part"), order.alias("place"), features.text_line(F.col("chr1"), F.col("chr2")).alias("line"))
        top = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(body.schema["place"].dataType).alias("place"), F.lit(feature_header(rows)).alias("line"))
        lines = top.unionByName(body).orderBy("part", "place").select("line")
    lines.write.mode(mode).text(path)


def write_one_dimensional(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A line a 1-D feature, its columns separated by tabs, in the order of chromosomes and starts."""
    rows.orderBy("chr_idx", "start").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns))).write.mode(mode).text(path)
