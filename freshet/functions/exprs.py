"""Column expressions with the missing-value rules that every operator obeys.

Missing is null, never NaN.  Comparisons with null are false in conditions, arithmetic carries
null on, and ratios with a zero divisor are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    """Text with a decimal point or comma as a number; anything else is null."""
    text = F.regexp_replace(as_col(c).cast("string"), ",", ".")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    x = as_col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def at_least(c: Column | str, low: float) -> Column:
    """Clip from below; null stays null, which greatest() would not keep."""
    x = as_col(c)
    return F.when(x < low, F.lit(float(low))).otherwise(x)


def clip01(c: Column) -> Column:
    return F.when(c < 0, F.lit(0.0)).when(c > 1, F.lit(1.0)).otherwise(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or either is missing."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def excess(x: Column | str, threshold: Column | str) -> Column:
    """Amount over a positive threshold; where there is none the value itself; never negative."""
    x, t = as_col(x), as_col(threshold)
    return at_least(F.when(t > 0, x - t).otherwise(x), 0.0)


def over(x: Column | str, threshold: Column | str) -> Column:
    """Amount over any threshold, null where either is missing."""
    return at_least(as_col(x) - as_col(threshold), 0.0)


def all_greatest(*cols: Column) -> Column:
    """The greatest value, null if any is missing."""
    there = cols[0].isNotNull()
    for c in cols[1:]:
        there = there & c.isNotNull()
    return F.when(there, F.greatest(*cols))


def epoch(c: Column | str) -> Column:
    """Whole seconds of a timestamp."""
    return F.unix_micros(as_col(c).cast("timestamp")) / F.lit(1_000_000)


def step_count(hours: float, dt_hours: float | Column) -> int | Column:
    """Rows that a span of hours covers: rounded half to even, one at least; of a column of intervals a column."""
    if isinstance(dt_hours, Column):
        return F.greatest(F.bround(F.lit(float(hours)) / dt_hours), F.lit(1.0)) if hours and hours > 0 else F.lit(1.0)
    hours = hours if hours and hours > 0 else dt_hours
    return max(int(round(hours / dt_hours)), 1)


def doy_distance(a: Column, b: Column) -> Column:
    """Distance of days of the year around a circle of 366 days, in every year."""
    d = F.abs(a - b)
    return F.least(d, 366 - d)
