"""Thresholds, normalisation and empirical ranks per key.

All of them are window aggregates over the key, so a plan that is hash-partitioned by the key
once is never shuffled again for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_col, clip01, epoch, ratio


def median_dt_hours(df: DataFrame, key: str = "guid", ts: str = "ts") -> DataFrame:
    """(key, dt_hours): the median interval between rows in hours; 1 if there is none above zero."""
    gap = epoch(ts) - F.lag(epoch(ts)).over(Window.partitionBy(key).orderBy(ts))
    median = df.filter(F.col(ts).isNotNull()).select(key, gap.alias("gap")).groupBy(key).agg((F.percentile("gap", F.lit(0.5)) / 3600).alias("m"))
    return median.select(key, F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(1.0)).alias("dt_hours"))


def quantile(x: Column | str, q: float, key: str = "guid") -> Column:
    """Exact quantile with linear interpolation over the key's values."""
    return F.percentile(as_col(x), F.lit(float(q))).over(Window.partitionBy(key))


def fraction_of_max(x: Column | str, fraction: float, key: str = "guid") -> Column:
    return F.lit(float(fraction)) * F.max(as_col(x)).over(Window.partitionBy(key))


def capacity(x: Column | str, ts: str = "ts", key: str = "guid") -> Column:
    """The value of the key's first row in time, be it missing or not."""
    return F.min_by(F.struct(as_col(x).alias("v")), F.col(ts)).over(Window.partitionBy(key))["v"]


def threshold(x: Column | str, *, cap: Column | None = None, cap_fraction: float | None = None, q: float | None = None, key: str = "guid") -> Column:
    """A share of a positive capacity, else a quantile, else missing."""
    low = F.lit(None).cast("double")
    if q is not None:
        low = quantile(x, q, key)
    if cap is not None and cap_fraction is not None:
        return F.when(cap > 0, F.lit(float(cap_fraction)) * cap).otherwise(low)
    return low


def robust_minmax(x: Column | str, q_low: float | None, q_high: float | None, key: str = "guid") -> Column:
    """Scale to 0..1 between two quantiles (None: extremes).

    All missing stays missing; without a spread everything is 0, missing values too.
    """
    x, w = as_col(x), Window.partitionBy(key)
    lo = F.min(x).over(w) if q_low in (None, 0, 0.0) else quantile(x, q_low, key)
    hi = F.max(x).over(w) if q_high in (None, 1, 1.0) else quantile(x, q_high, key)
    return F.when(lo.isNull() | hi.isNull(), F.lit(None).cast("double")).when(hi == lo, F.lit(0.0)).otherwise(clip01((x - lo) / F.when(hi != lo, hi - lo)))


def ecdf(x: str, key: list[str]) -> Column:
    """Share of the key's values that are not larger; missing values have no rank."""
    there = F.col(x).isNotNull()
    return F.when(there, F.cume_dist().over(Window.partitionBy(*key, there).orderBy(x)))


def rank_in(reference: DataFrame, probes: DataFrame, key: list[str], value: str = "x", probe: str = "p", sign: int = 0) -> DataFrame:
    """Probes with ``rank``: the share of the reference's values that are not larger than the probe.

    ``sign``: 1 ranks among positive values only, -1 among negative ones; an empty reference
    gives no rank.  Probes and reference are merged in one sorted pass per key.
    """
    ref = reference.filter(F.col(value).isNotNull())
    if sign:
        ref = ref.filter(F.col(value) > 0 if sign > 0 else F.col(value) < 0)
    names = probes.columns
    a = ref.select(*key, F.col(value).alias("_v"), F.lit(1).alias("_ref"), F.lit(None).cast(probes.select(F.struct(*names)).schema[0].dataType).alias("_row"))
    b = probes.select(*key, F.col(probe).alias("_v"), F.lit(0).alias("_ref"), F.struct(*names).alias("_row"))
    w = Window.partitionBy(*key)
    below = F.sum("_ref").over(w.orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = a.unionByName(b).withColumn("_n", F.sum("_ref").over(w)).withColumn("_below", below)
    return both.filter("_ref = 0").select("_row.*", F.when(F.col("_v").isNotNull(), ratio("_below", "_n")).alias("rank"))


def percent_of_max(x: Column | str, key: str = "guid", absolute: bool = False) -> Column:
    top = F.max(F.abs(as_col(x)) if absolute else as_col(x)).over(Window.partitionBy(key))
    return ratio(x, top) * 100


def zscore(x: Column | str, key: str = "guid") -> Column:
    """Distance from the mean in population standard deviations; missing under two values or without spread."""
    w = Window.partitionBy(key)
    x = as_col(x)
    return F.when((F.count(x).over(w) >= 2) & (F.stddev_pop(x).over(w) != 0), (x - F.avg(x).over(w)) / F.stddev_pop(x).over(w))


def info_score(df: DataFrame, columns: list[str]) -> Column:
    """How many of the columns are there."""
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNotNull().cast("int")
    return out


def histogram(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows per combination of keys; missing keys are combinations too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def run_summary(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows, and distinct present values of each column as ``n_<column>``, of the whole table or per combination of keys.

    Distinct values are counted exactly; without keys an empty table gives one row of zeros.
    """
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])
