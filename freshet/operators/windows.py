"""Row-step operators on ordered series, and exponential memory without a row loop.

Numbers of rows may be columns that are constant per key, so that keys of different resolution
share a plan.  Frames of rows have literal bounds, so the rows are then ordered by their number
(ROW, which the data must have) in parts of the steps: the steps are UNIT, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_col, at_least


#: Column with the number of a row in its key, from ``numbered_rows``, and what steps are in the order by parts; more than any steps.
ROW, UNIT = "_row", 1_000_000


def _w(key, ts):
    return Window.partitionBy(key).orderBy(ts)


def numbered_rows(df: DataFrame, key: str = "guid", ts: str = "ts") -> DataFrame:
    return df.withColumn(ROW, F.row_number().over(_w(key, ts)))


def _by_steps(steps: Column, key: str):
    """Rows by their number in parts of the steps, in whole numbers: steps rows are exactly UNIT apart, others more or less."""
    return Window.partitionBy(key).orderBy(F.call_function("div", F.col(ROW).cast("long") * UNIT, steps.cast("long")))


def _back(x: Column, steps: int | Column, key: str, ts: str) -> Column:
    """The value some rows before."""
    if not isinstance(steps, Column):
        return F.lag(x, steps).over(_w(key, ts))
    return F.first(x).over(_by_steps(steps, key).rangeBetween(-UNIT, -UNIT))


def lag_rate(x: Column | str, steps: int | Column, hours: float | Column, key: str = "guid", ts: str = "ts") -> Column:
    """Change per day over some rows, by the nominal hours."""
    x = as_col(x)
    days = hours / F.lit(24.0) if isinstance(hours, Column) else F.lit(hours / 24.0)
    return (x - _back(x, steps, key, ts)) / days


def rolling_sum(x: Column | str, steps: int | Column, key: str = "guid", ts: str = "ts") -> Column:
    """Sum of the last rows, missing values as zero, short at the start."""
    x = F.coalesce(as_col(x), F.lit(0.0))
    if not isinstance(steps, Column):
        return F.sum(x).over(_w(key, ts).rowsBetween(1 - steps, 0))
    return F.sum(x).over(_by_steps(steps, key).rangeBetween(1 - UNIT, 0))


def positive_drop(x: Column | str, steps: int | Column, key: str = "guid", ts: str = "ts") -> Column:
    """How much the value fell over some rows."""
    x = as_col(x)
    return at_least(_back(x, steps, key, ts) - x, 0.0)


def rolling_memory(x: Column | str, steps: int | Column, dt_hours: float | Column, key: str = "guid", ts: str = "ts") -> Column:
    return rolling_sum(x, steps, key, ts) * (dt_hours / F.lit(24.0) if isinstance(dt_hours, Column) else F.lit(dt_hours / 24.0))


#: Largest exponent inside a block of the exponential memory.
SPAN = 500.0


def exp_memory(df: DataFrame, columns: dict[str, tuple[str, float]], dt_hours: float | Column, key: str = "guid", ts: str = "ts") -> DataFrame:
    """m[i] = exp(-dt/tau) m[i-1] + x[i] dt, for several columns: {new name: (column, tau in days)}.

    Rows are taken in blocks in which exp(k i) stays finite: a running sum inside the block, plus
    the decayed end of the block before.  Earlier blocks are below exp(-SPAN).
    """
    dt = dt_hours / F.lit(24.0) if isinstance(dt_hours, Column) else F.lit(dt_hours / 24.0)
    out = df.withColumn("_i", F.row_number().over(_w(key, ts)) - 1)
    for name, (x, tau) in columns.items():
        k = dt / F.lit(float(tau)) if tau and tau > 0 else F.lit(1.0)
        size = F.greatest(F.lit(1.0), F.floor(F.lit(SPAN) / k).cast("double"))
        out = out.withColumn("_b", F.floor(F.col("_i") / size).cast("long")).withColumn("_o", F.col("_i") - F.col("_b") * size)
        inside = Window.partitionBy(key, "_b").orderBy("_i")
        out = out.withColumn("_local", F.exp(-k * F.col("_o")) * F.sum(F.coalesce(F.col(x), F.lit(0.0)) * dt * F.exp(k * F.col("_o"))).over(inside))
        before = F.max_by("_local", "_o").over(Window.partitionBy(key).orderBy("_b").rangeBetween(-1, -1))
        out = out.withColumn(name, F.col("_local") + F.coalesce(F.exp(-k * (F.col("_o") + 1)) * before, F.lit(0.0)))
    return out.drop("_i", "_b", "_o", "_local")


def is_peak_over(x: Column | str, threshold: Column, key: str = "guid", ts: str = "ts") -> Column:
    """Higher than the row before, not lower than the next, and over the threshold; never at an end."""
    x, w = as_col(x), _w(key, ts)
    return F.coalesce((x > F.lag(x).over(w)) & (x >= F.lead(x).over(w)) & (x > threshold), F.lit(False))
