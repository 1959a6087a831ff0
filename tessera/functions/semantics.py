"""Column expressions with IEEE results where Spark SQL raises or gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with 0/0 as NaN and x/0 as a signed infinity; null if either is null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((b != 0) | F.isnan(b), F.try_divide(a, b)).when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))


def ieee_ln(a: Column) -> Column:
    """Natural logarithm: minus infinity at zero, NaN below it."""
    a = a.cast("double")
    return F.when(a == 0, F.lit(-INF)).when(F.isnan(a) | (a < 0), F.lit(NAN)).otherwise(F.ln(a))


def finite_or(a: Column, replacement: float) -> Column:
    return F.when(F.isnan(a) | (F.abs(a) == INF), F.lit(replacement)).otherwise(a)


def is_number(a: Column) -> Column:
    return a.isNotNull() & ~F.isnan(a.cast("double"))


def clamp(a: Column, low: float, high: float) -> Column:
    """NaN stays NaN."""
    return F.when(F.isnan(a), a).otherwise(F.least(F.greatest(a, F.lit(low)), F.lit(high)))


def simple_log(v: Column, pseudocount: float = 0.0) -> Column:
    return ieee_ln(v + F.lit(pseudocount))


def simple_log_clean(v: Column, pseudocount: float = 0.0) -> Column:
    """Infinities and logarithms within 1e-10 of zero become NaN."""
    x = simple_log(v, pseudocount)
    return F.when(F.isnan(x) | (F.abs(x) == INF) | (F.abs(x) < 1e-10), F.lit(NAN)).otherwise(x)


def log_oe_plus(v: Column, average: Column, e: float) -> Column:
    return ieee_div(ieee_ln(v + F.lit(e)), ieee_ln(average + F.lit(e)))


def signum_clean(v: Column) -> Column:
    """-1, 0 or 1; NaN counts as 0."""
    return F.when(F.isnan(v), F.lit(0.0)).otherwise(F.signum(v))


def middle_ellipsis(text: Column, n: int) -> Column:
    """The first and last n characters around "..." where a text is longer than both."""
    return F.when(F.length(text) > 2 * n, F.concat(F.substring(text, 1, n), F.lit("..."), F.substring(text, -n, n))).otherwise(text)


def token_from_end(text: Column, i: int) -> Column:
    """The i-th tab-separated token counted from the end, from 1; null beyond the first."""
    return F.try_element_at(F.split(text, "\t"), F.lit(-i))
