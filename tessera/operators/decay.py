"""Distance decay: expected values by bin distance, rolling smoothing, moments by bucket and spline models."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.semantics import ieee_div
from tessera.plans.lineage import numbered


def distance(x: Column, y: Column) -> Column:
    return F.abs(x - y)


def mean_by_distance(contacts: DataFrame, max_dist: int | None = None, use_log: bool = False) -> DataFrame:
    """The mean of the records present at each distance; with use_log exp(mean(ln(1 + c))) - 1."""
    dist = contacts.select(F.abs(F.col("bin_x") - F.col("bin_y")).alias("dist"), F.col("counts").cast("double").alias("c"))
    if max_dist is not None:
        dist = dist.where(F.col("dist") < max_dist)
    value = F.expm1(F.avg(F.log1p("c"))) if use_log else F.avg("c")
    return dist.groupBy("dist").agg(F.count("*").alias("n"), value.alias("value"))


def densify(vector: DataFrame, n: int) -> DataFrame:
    """A vector with 0 for the distances below n that have no record."""
    every = vector.sparkSession.range(n).select(F.col("id").cast("int").alias("dist"))
    return every.join(vector.select("dist", "value"), "dist", "left").select("dist", F.coalesce("value", F.lit(0.0)).alias("value"))


def with_expected(contacts: DataFrame, vector: DataFrame, factors: DataFrame) -> DataFrame:
    """contacts and expected: the vector at the distance, beyond its end at the last place, over the chromosome's factor (1 without one)."""
    end = vector.agg(F.max("dist").alias("__n"))  # one row
    last = F.coalesce("__n", F.raise_error(F.lit("the expected vector is empty")).cast("int"))
    at = contacts.join(F.broadcast(end), F.lit(True)).withColumn("dist", F.least(F.abs(F.col("bin_x") - F.col("bin_y")), last)).drop("__n")
    joined = at.join(vector.select("dist", F.col("value").alias("__e")), "dist", "left").join(F.broadcast(factors.select(F.col("chr_idx").alias("chr1_idx"), "factor")), "chr1_idx", "left")  # a row a chromosome
    return joined.withColumn("expected", ieee_div(F.col("__e"), F.coalesce("factor", F.lit(1.0)))).drop("__e", "factor")


def with_factors(vector: DataFrame, factors: DataFrame) -> DataFrame:
    """The vector of each chromosome: values times the inverse of its factor."""
    return vector.join(F.broadcast(factors), F.lit(True)).select("chr_idx", "dist", (F.col("value") * ieee_div(F.lit(1.0), F.col("factor"))).alias("value"))  # factors: a row a chromosome


def _medians(values: np.ndarray, first: int, z: np.ndarray, w: int, n: int) -> np.ndarray:
    """Medians around places z of a vector of n places, of which values are those from first on."""
    out = np.empty(len(z), np.float32)
    low = np.where(z < w, 0, z - w)
    high = np.minimum(np.where(z < w, 2 * z, z + w), n - 1)
    size = high - low + 1
    for k in np.unique(size).tolist():
        windows = np.lib.stride_tricks.sliding_window_view(values, k)
        at = np.flatnonzero(size == k)
        for some in np.array_split(at, max(1, len(at) * k // 4_000_000)):
            own = np.sort(windows[low[some] - first], axis=1).astype(np.float64)
            out[some] = (own[:, (k - 1) // 2] + own[:, k // 2]) / 2
    return out


def rolling_median(vector: DataFrame, w: int, *keys: str, run: int = 65_536) -> DataFrame:
    """Medians over w places on both sides, single precision; near the start over as many as there are on the left.

    Places are numbered by ranges of key and distance and dealt to runs, which overlap by w on both sides, so neither a frame a place
    nor a whole vector is held; w below 1 or not below the length leaves it as it is.
    """
    if w < 1:
        return vector
    run = max(run, 2 * w)
    counted = numbered(vector, "__at", *keys, "dist")
    if keys:
        each = counted.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
        alike = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        placed = counted.join(each, alike).select(*vector.columns, "__n", (F.col("__at") - F.col("__first")).alias("__z"))
    else:
        placed = counted.withColumns({"__n": F.lit(counted.count()), "__z": F.col("__at")}).drop("__at")
    home = F.floor(F.col("__z") / run).cast("int")
    runs = F.sequence(F.greatest(F.lit(0), F.floor((F.col("__z") - w) / run)).cast("int"), F.floor((F.col("__z") + w) / run).cast("int"))
    dealt = placed.withColumn("__own", home).withColumn("__run", F.explode(runs))

    columns = vector.columns

    def medians(table: pa.Table) -> pa.Table:
        table = table.sort_by("__z")
        z, n = np.asarray(table["__z"]).astype(np.int64), int(table["__n"][0].as_py())
        mine = np.asarray(table["__own"]) == np.asarray(table["__run"])
        kept = table.filter(pa.array(mine))
        if w < n and kept.num_rows:
            values = np.asarray(table["value"]).astype(np.float32)
            found = _medians(values, int(z[0]), z[mine], w, n).astype(np.float64)
            kept = kept.set_column(kept.schema.get_field_index("value"), "value", pa.array(found))
        return kept.select(columns)

    schema = vector.withColumn("value", F.col("value").cast("double")).schema
    return dealt.withColumn("value", F.col("value").cast("double")).groupBy(*keys, "__run").applyInArrow(medians, schema)


def rolling_mean(vector: DataFrame, w: int, start: int, *keys: str) -> DataFrame:
    """From start on the mean of w places before and w - 1 after."""
    order = Window.partitionBy(*keys).orderBy("dist")
    mean = F.avg("value").over(order.rowsBetween(-w, w - 1))
    return vector.withColumn("value", F.when(F.col("dist") >= start, mean).otherwise(F.col("value")))


def corrected(vector: DataFrame, window: int, bin_size: int, *keys: str) -> DataFrame:
    """The expected vector smoothed by a median over a window in base pairs."""
    return rolling_median(vector, window // bin_size, *keys)


def log_bucket(dist: Column) -> Column:
    """0 for the diagonal, beyond it one more than the whole part of ln(1 + d)."""
    return F.when(dist == 0, 0).otherwise(1 + F.floor(F.log1p(dist.cast("double")))).cast("int")


def moments(values: DataFrame, bucket: str, value: str, lengths: DataFrame | None = None) -> DataFrame:
    """Count, mean, deviation (0 unless there are more than two), least, greatest (never below 0) and range by bucket.

    lengths (bucket, length): a bucket of fewer values than its length is filled up with zeros; one without values but with a length is all zeros.
    """
    v = F.col(value).cast("double")
    per = values.groupBy(bucket).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"))
    if lengths is not None:
        per = per.join(lengths.select(bucket, "length"), bucket, "full")
        n, mean = F.coalesce("n", F.lit(0)), F.coalesce("mean", F.lit(0.0))
        total = F.greatest(n, F.coalesce("length", F.lit(0))).cast("long")
        zeros = total - n
        # what n values and as many zeros spread around the mean of both
        var = (F.coalesce("var", F.lit(0.0)) * n + mean * mean * n * zeros / total) / total
        edge = lambda f, c: F.when(zeros > 0, f(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c))
        per = per.select(bucket, total.alias("n"), (mean * n / total).alias("mean"), var.alias("var"), edge(F.least, "min").alias("min"), edge(F.greatest, "max").alias("max")).where("n > 0")
    std = F.when(F.col("n") > 2, F.sqrt(F.col("var") * F.col("n") / (F.col("n") - 1))).otherwise(0.0)
    most = F.greatest(F.col("max"), F.lit(0.0))
    return per.select(bucket, "n", "mean", std.alias("std"), "min", most.alias("max"), (most - F.col("min")).alias("range"))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return ieee_div(value - mean, std)


def value_at_z(z: Column, mean: Column, std: Column) -> Column:
    return mean + z * std


def tier_group(position: Column) -> Column:
    """Positions counted from 0 fall into tiers of ten groups, a group of the next tier being five times as long."""
    p = position.cast("double")
    tier = F.floor(F.ln(4 * p / 10 + 1) / F.ln(F.lit(5.0)) + 1e-9)
    start = 10 * (F.pow(F.lit(5.0), tier) - 1) / 4
    return (10 * tier + F.floor((p - start) / F.pow(F.lit(5.0), tier))).cast("int")


LEAST_OF_PARTIAL = (10, 100)


def knots(contacts: DataFrame, max_bin: int) -> DataFrame:
    """(x, y): mean ln(1 + d) and mean ln(1 + c) of each group of distances up to max_bin, and one for the tail.

    A group is cut off by the last distance if it is not whole; such a one needs over ten distances and over a
    hundred records. The tail is the last quarter of the distances, placed at ln(1 + max) + 1.
    """
    spark = contacts.sparkSession
    per = contacts.select(F.abs(F.col("bin_x") - F.col("bin_y")).alias("dist"), F.log1p(F.col("counts").cast("double")).alias("lc")).where(F.col("dist") < max_bin).groupBy("dist").agg(F.count("*").alias("n"), F.sum("lc").alias("s"))
    every = spark.range(max_bin).select(F.col("id").cast("int").alias("dist"), tier_group(F.col("id")).alias("g"))
    joined = every.join(per, "dist", "left").select("g", "dist", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))
    tier = F.floor(F.col("g") / 10)
    whole = F.pow(F.lit(5.0), tier)
    groups = joined.groupBy("g").agg(F.count("*").alias("places"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.avg(F.log1p(F.col("dist").cast("double"))).alias("x"))
    least_places, least_records = LEAST_OF_PARTIAL
    kept = groups.where((F.col("n") > 0) & ((F.col("places") == whole) | ((F.col("places") > least_places) & (F.col("n") > least_records))))
    tail = per.where(F.col("dist") >= int(0.75 * max_bin)).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    return kept.select("x", (F.col("s") / F.col("n")).alias("y")).unionByName(tail.select(F.lit(float(np.log1p(max_bin)) + 1).alias("x"), (F.col("s") / F.col("n")).alias("y")))


@dataclass
class Spline:
    """A natural cubic spline through a few dozen knots; its value is a column expression over their segments."""

    x: np.ndarray
    y: np.ndarray

    def __post_init__(self) -> None:
        x, y = self.x, self.y
        n = len(x)
        if n < 2:
            raise ValueError("a spline needs two knots")
        h = np.diff(x)
        m = np.zeros(n)
        if n > 2:
            a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
            m[1:-1] = np.linalg.solve(a, 6 * (np.diff(y[1:]) / h[1:] - np.diff(y[:-1]) / h[:-1]))
        self.parts = [(x[i], y[i], (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6, m[i] / 2, (m[i + 1] - m[i]) / (6 * h[i])) for i in range(n - 1)]

    @classmethod
    def through(cls, knots: DataFrame) -> Spline:
        rows = sorted((r["x"], r["y"]) for r in knots.select("x", "y").collect())  # fifty at most
        kept = []
        for x, y in rows:
            if not kept or x > kept[-1][0]:
                kept.append((x, y))
        return cls(np.array([k[0] for k in kept]), np.array([k[1] for k in kept]))

    def at(self, x: Column, highest: float | None = None) -> Column:
        """Within the knots; x is held at the ends, and at highest."""
        top = float(self.x[-1]) if highest is None else min(float(self.x[-1]), highest)
        x = F.greatest(F.least(x, F.lit(top)), F.lit(float(self.x[0])))
        out = None
        for x0, *c in reversed(self.parts):
            d = x - F.lit(float(x0))
            part = F.lit(float(c[0])) + d * (F.lit(float(c[1])) + d * (F.lit(float(c[2])) + d * F.lit(float(c[3]))))
            out = part if out is None else F.when(x < F.lit(float(self._end(x0))), part).otherwise(out)
        return out

    def _end(self, x0: float) -> float:
        return float(self.x[int(np.searchsorted(self.x, x0)) + 1])


class LogSpline:
    """Expected counts as exp(f(ln(1 + d))) - 1."""

    def __init__(self, contacts: DataFrame, max_bin: int) -> None:
        self.spline = Spline.through(knots(contacts, max_bin))
        self.highest = float(int(np.log1p(max_bin)))

    def expected(self, dist: Column) -> Column:
        return F.expm1(self.spline.at(F.log1p(dist.cast("double")), max(self.highest, float(self.spline.x[0]))))

    def near_diagonal(self) -> Column:
        return F.expm1(self.spline.at(F.lit(0.5)))

    def percent_contact(self, observed: Column, dist: Column) -> Column:
        """(O - E) / (S - E), S being the signal next to the diagonal."""
        e = self.expected(dist)
        return ieee_div(observed - e, self.near_diagonal() - e)

    def reasonable(self, observed: Column, dist: Column, low: float, high: float) -> Column:
        p = self.percent_contact(observed, dist)
        return (p > low) & (p < high)

    def enriched(self, observed: Column, dist: Column, least: float) -> Column:
        return ieee_div(observed, self.expected(dist)) > least


class ZSpline:
    """Mean and deviation of ln(1 + c) over the mean ln(1 + d) of each log bucket, as splines."""

    def __init__(self, contacts: DataFrame, max_bin: int) -> None:
        dist = F.abs(F.col("bin_x") - F.col("bin_y"))
        logs = contacts.where(dist < max_bin).select(log_bucket(dist).alias("bucket"), dist.alias("d"), F.log1p(dist.cast("double")).alias("x"), F.log1p(F.col("counts").cast("double")).alias("v"))
        far = logs.groupBy("bucket").agg(F.avg("x").alias("x"), F.max("d").alias("d"))
        rows = moments(logs, "bucket", "v").join(far, "bucket").orderBy("bucket").collect()  # a row a bucket
        x = np.array([r["x"] for r in rows])
        self.mean, self.std = Spline(x, np.array([r["mean"] for r in rows])), Spline(x, np.array([r["std"] for r in rows]))
        farthest = max(int(np.expm1(x.max())), max(r["d"] for r in rows))
        self.highest = float(int(np.log1p(min(max_bin, farthest))))

    def _at(self, dist: Column) -> Column:
        return F.least(F.log1p(dist.cast("double")), F.lit(self.highest))

    def z(self, observed: Column, dist: Column) -> Column:
        x = self._at(dist)
        return zscore(F.log1p(observed.cast("double")), self.mean.at(x), self.std.at(x))

    def value(self, z: Column, dist: Column) -> Column:
        x = self._at(dist)
        return F.expm1(value_at_z(z, self.mean.at(x), self.std.at(x)))

    def expected(self, dist: Column) -> Column:
        return self.value(F.lit(0.0), dist)
