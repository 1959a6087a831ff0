"""Matrices in coordinate form: (row, col, value), every cell present; sizes are given where they matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.semantics import clamp, ieee_div, signum_clean
from tessera.plans.lineage import cumulated, in_ranges


def _v() -> Column:
    return F.col("value")


def filled(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.lit(float(value)).alias("value"))


def random_unit(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> DataFrame:
    return filled(spark, rows, cols).withColumn("value", F.rand(seed))


def flatten(m: DataFrame, cols: int) -> DataFrame:
    return m.select((F.col("row").cast("long") * cols + F.col("col")).alias("pos"), "value")


def reshape(flat: DataFrame, cols: int) -> DataFrame:
    return flat.select(F.expr(f"cast(pos div {cols} as int)").alias("row"), (F.col("pos") % cols).cast("int").alias("col"), "value")


def cut(m: DataFrame, r1: int, r2: int, c1: int, c2: int) -> DataFrame:
    """Rows r1 to r2 and columns c1 to c2, without the last ones, counted anew."""
    return m.where(F.col("row").between(r1, r2 - 1) & F.col("col").between(c1, c2 - 1)).select((F.col("row") - r1).alias("row"), (F.col("col") - c1).alias("col"), "value")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def flip_left_right(m: DataFrame, cols: int) -> DataFrame:
    return m.withColumn("col", cols - 1 - F.col("col"))


def flip_top_bottom(m: DataFrame, rows: int) -> DataFrame:
    return m.withColumn("row", rows - 1 - F.col("row"))


def flip_anti_diagonal(m: DataFrame, n: int) -> DataFrame:
    return m.select((n - 1 - F.col("col")).alias("row"), (n - 1 - F.col("row")).alias("col"), "value")


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("row = col").select("row", "value")


def symmetric_from_upper(m: DataFrame) -> DataFrame:
    """The upper triangle, mirrored."""
    both = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col"))).otherwise(F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))))
    return m.where("row <= col").select(F.explode(both).alias("c"), "value").select("c.row", "c.col", "value")


def multiply_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Over the shape that both have."""
    return a.join(b.withColumnRenamed("value", "other"), ["row", "col"]).select("row", "col", (_v() * F.col("other")).alias("value"))


def divide_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "other"), ["row", "col"]).select("row", "col", ieee_div(_v(), F.col("other")).alias("value"))


def nan_to(m: DataFrame, value: float = 0.0) -> DataFrame:
    return m.withColumn("value", F.nanvl(_v(), F.lit(value)))


def replace(m: DataFrame, old: float, new: float) -> DataFrame:
    return m.withColumn("value", F.when(_v() == old, F.lit(new)).otherwise(_v()))


def sign(m: DataFrame) -> DataFrame:
    return m.withColumn("value", signum_clean(_v()))


def threshold_upper(m: DataFrame, most: float) -> DataFrame:
    return m.withColumn("value", F.when(_v() > most, F.lit(most)).otherwise(_v()))


def threshold_both(m: DataFrame, limit: float) -> DataFrame:
    return m.withColumn("value", clamp(_v(), -limit, limit))


def _numbers(m: DataFrame) -> DataFrame:
    return m.where(~F.isnan("value"))


def measures(m: DataFrame) -> DataFrame:
    """Sum and mean over all cells, least and greatest number, and the least above zero (0 if there is none)."""
    number = F.when(~F.isnan("value"), _v())
    return m.agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min(number).alias("min"), F.max(number).alias("max"), F.coalesce(F.min(F.when(number > 0, number)), F.lit(0.0)).alias("min_positive"))


def divide_by_max(m: DataFrame) -> DataFrame:
    most = _numbers(m).agg(F.max("value").alias("most"))
    return m.join(F.broadcast(most), F.lit(True)).select("row", "col", ieee_div(_v(), F.col("most")).alias("value"))  # one row


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("row").agg(F.sum("value").alias("value"))


def abs_column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("col").agg(F.sum(F.abs("value")).alias("value"))


def row_medians(m: DataFrame) -> DataFrame:
    """Of an even number of cells the mean of the two in the middle; NaN counts as above all numbers.

    Different values of a row with their counts are dealt to ranges of (row, value). A value's rank is the number of cells in lower
    ranges and the running count within its own, less what lower rows have; so a row may be spread over many tasks, and none holds its values.
    """
    per = cumulated(m.where("value IS NOT NULL").groupBy("row", "value").agg(F.count("*").alias("c")), "c", "before", "row", "value")
    rows = per.groupBy("row").agg(F.min("before").alias("first"), F.sum("c").alias("n"))
    low, high = F.col("first") + F.expr("(n - 1) div 2"), F.col("first") + F.expr("n div 2")
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("c"))
    middle = per.join(rows, "row").select("row", F.when(holds(low), _v()).alias("a"), F.when(holds(high), _v()).alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    return middle.groupBy("row").agg(F.max("a").alias("a"), F.max("b").alias("b")).select("row", ((F.col("a") + F.col("b")) / 2).alias("value"))


def normalise_by_sums(m: DataFrame, by: str = "row") -> DataFrame:
    """Whole numbers over their row's or column's sum, in whole numbers; a sum of zero is an error."""
    sums = m.groupBy(by).agg(F.sum(_v().cast("long")).alias("s"))
    return m.join(sums, by).select("row", "col", F.expr("cast(value as long) div s").alias("value"))


def percentile_bounds(m: DataFrame, low: float = 5.0, high: float = 95.0) -> DataFrame:
    """Percentiles at p (n + 1) / 100, between the two ranks next to it, over the numbers.

    Different values with their counts are dealt to ranges; a value's rank is the number of values in lower ranges, a sum
    over a row a range, and the running count within its own.
    """
    counts = in_ranges(_numbers(m).groupBy("value").agg(F.count("*").alias("c")), "value")
    sizes = counts.groupBy("range").agg(F.sum("c").alias("n"))
    lower = sizes.select("range", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("lower"))  # a row a range
    within = F.sum("c").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    upto = counts.join(F.broadcast(lower), "range").select("value", (within + F.coalesce("lower", F.lit(0))).alias("last"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    if not n:
        return m.sparkSession.createDataFrame([(None, None)], "lower double, upper double")

    def at(p: float) -> Column:
        pos = p * (n + 1) / 100
        k = min(max(1, int(pos)), n)
        d = 0.0 if pos < 1 or pos >= n else pos - int(pos)
        pick = lambda r: F.min(F.when(F.col("last") >= r, _v()))
        return pick(k) + (pick(min(n, k + 1)) - pick(k)) * d

    return upto.agg(at(low).alias("lower"), at(high).alias("upper"))


def paste(m: DataFrame, block: DataFrame, row: int, col: int) -> DataFrame:
    """block laid over m at a place; the block wins."""
    moved = block.select((F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), "value")
    return m.join(moved.select("row", "col"), ["row", "col"], "left_anti").unionByName(moved)


def stitch_rows(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices one below the other; each with its number of rows."""
    out, at = None, 0
    for m, rows in parts:
        moved = m.withColumn("row", F.col("row") + at)
        out, at = moved if out is None else out.unionByName(moved), at + rows
    return out


def composite(a: DataFrame, x: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """[[a, x], [x transposed, b]] with NaN as 0; n: the rows of a."""
    right = x.withColumn("col", F.col("col") + n)
    low = transpose(x).withColumn("row", F.col("row") + n)
    corner = b.select((F.col("row") + n).alias("row"), (F.col("col") + n).alias("col"), "value")
    return nan_to(a.unionByName(right).unionByName(low).unionByName(corner))


def label_region(m: DataFrame, r1: int, r2: int, c1: int, c2: int) -> DataFrame:
    """1 within the region (ends excluded)."""
    return m.withColumn("value", F.when(F.col("row").between(r1, r2 - 1) & F.col("col").between(c1, c2 - 1), 1.0).otherwise(_v()))


def label_above_average(m: DataFrame, source: DataFrame, r1: int, r2: int, c1: int, c2: int) -> DataFrame:
    """1 in m where source, within the region, is above its average there."""
    inside = source.where(F.col("row").between(r1, r2 - 1) & F.col("col").between(c1, c2 - 1))
    mean = inside.agg(F.avg("value").alias("mean"))
    hit = inside.join(F.broadcast(mean), _v() > F.col("mean")).select("row", "col", F.lit(1).alias("hit"))  # one row
    return m.join(hit, ["row", "col"], "left").select("row", "col", F.when(F.col("hit") == 1, 1.0).otherwise(_v()).alias("value"))


def _ahead(k: int) -> Column:
    return F.lead("value", k).over(Window.partitionBy("row").orderBy("col"))


def derivative(m: DataFrame) -> DataFrame:
    """Each cell less its right neighbour; a column fewer."""
    return m.withColumn("value", _v() - _ahead(1)).where("value IS NOT NULL")


def convolve(m: DataFrame, kernel: list[float]) -> DataFrame:
    """The kernel over each row where it lies wholly within."""
    total = None
    for k, w in enumerate(kernel):
        term = (_v() if k == 0 else _ahead(k)) * F.lit(float(w))
        total = term if total is None else total + term
    return m.withColumn("value", total).where("value IS NOT NULL")


def append_columns(a: DataFrame, b: DataFrame, cols: int) -> DataFrame:
    """b to the right of a, which has so many columns."""
    return a.unionByName(b.withColumn("col", F.col("col") + cols))


def with_derivative(m: DataFrame, cols: int, main_limit: float | None = None) -> DataFrame:
    """m, clamped to main_limit if that is given, and its derivative to the right."""
    main = m if main_limit is None else threshold_both(m, main_limit)
    return append_columns(main, derivative(m), cols)


def smoothed_with_derivative(m: DataFrame, cols: int, kernel: list[float]) -> DataFrame:
    smooth = convolve(m, kernel)
    return append_columns(smooth, derivative(smooth), cols - len(kernel) + 1)


def relevant_derivative(m: DataFrame, scale: float, limit: float, positive: bool = False, discrete: bool = False) -> DataFrame:
    """The derivative without columns that are zero throughout, scaled and clamped; discrete: rounded before those columns are sought.

    positive adds the limit, so that values start at 0.
    """
    d = derivative(m)
    finish = lambda x: clamp(x * scale, -limit, limit)
    if discrete:
        d = d.withColumn("value", F.round(finish(_v())))
    live = d.groupBy("col").agg(F.sum(F.abs("value")).alias("s")).where("s > 0")
    at = live.select("col", (F.row_number().over(Window.orderBy("col")) - 1).alias("to"))  # a row a column
    kept = d.join(at, "col").select("row", F.col("to").alias("col"), "value")
    value = _v() if discrete else finish(_v())
    return kept.withColumn("value", value + (limit if positive else 0.0))


def over_row_statistic(m: DataFrame, statistic: str, limit: float) -> DataFrame:
    """Cells over their row's mean or median, held at limit."""
    per = row_medians(m) if statistic == "median" else m.groupBy("row").agg(F.avg("value").alias("value"))
    return threshold_upper(m.join(per.withColumnRenamed("value", "s"), "row").select("row", "col", ieee_div(_v(), F.col("s")).alias("value")), limit)


def normed(m: DataFrame, v1: DataFrame, v2: DataFrame) -> DataFrame:
    """value / (v1[row] * v2[col]) where that product is above zero, otherwise 0."""
    both = m.join(v1.select(F.col("bin").alias("row"), F.col("value").alias("a")), "row").join(v2.select(F.col("bin").alias("col"), F.col("value").alias("b")), "col")
    return both.select("row", "col", F.when(F.col("a") * F.col("b") > 0, _v() / (F.col("a") * F.col("b"))).otherwise(0.0).alias("value"))


def partitions(n: int, size: int) -> list[tuple[int, int]]:
    """n places in so many equal runs, what is left over going to the last."""
    step = n // size
    return [(i * step, n if i == size - 1 else (i + 1) * step) for i in range(size)]


def monotone(points: DataFrame) -> DataFrame:
    """(x, y) in the order of ord without those whose x is not above the one before."""
    dealt = in_ranges(points, "ord")
    lasts = dealt.groupBy("range").agg(F.max_by("x", "ord").alias("x"))
    carried = lasts.select("range", F.lag("x").over(Window.orderBy("range")).alias("carried"))  # a row a range
    within = F.lag("x").over(Window.partitionBy("range").orderBy("ord"))
    joined = dealt.join(F.broadcast(carried), "range").withColumn("before", F.coalesce(within, "carried"))
    return joined.where("before IS NULL OR x > before").select(points.columns)
