"""Arithmetic with IEEE results, safe in ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(name: str) -> Column:
    """A column whose name may hold dots, colons or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def ieee_div(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def floor_div(a: Column, b: Column) -> Column:
    q = ieee_div(a, b)
    return F.when(F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(q).cast("double"))


def strict_max(a: Column, b: Column) -> Column:
    """Null if either is; NaN counts as largest."""
    return F.when(a.isNull() | (a > b), a).otherwise(b)


def strict_min(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (a < b), a).otherwise(b)


def as_bits(a: Column) -> Column:
    return F.nanvl(a.cast("double"), F.lit(0.0)).cast("bigint")


def nan_min(c: Column) -> Column:
    """Least value apart from NaN."""
    return F.min(F.when(~F.isnan(c), c))


def nan_max(c: Column) -> Column:
    return F.max(F.when(~F.isnan(c), c))


def p95(c: Column, accuracy: int | None = None) -> Column:
    """Interpolated 95th percentile apart from null and NaN; approximate if an accuracy is given."""
    some = F.when(~F.isnan(c), c)
    return F.percentile_approx(some, 0.95, accuracy) if accuracy else F.percentile(some, 0.95)


def variation(c: Column) -> Column:
    """Population standard deviation by mean; 0 for one value, null for none."""
    return F.when(F.count(c) == 0, F.lit(None)).when(F.count(c) < 2, 0.0).otherwise(ieee_div(F.stddev_pop(c), F.avg(c)))


def normalized(value: Column, tsc: Column, ref_tsc: float, name: Column | None = None) -> Column:
    """A count as a rate per second; pseudo events stay as they are."""
    from ..schema import UNSCALED

    rate = ieee_div(value, tsc) * F.lit(float(ref_tsc))
    return rate if name is None else F.when(name.isin(*UNSCALED), value).otherwise(rate)
