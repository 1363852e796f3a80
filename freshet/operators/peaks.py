"""Peaks, threshold crossings and steepest slopes in windows around anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch
from .asof import around
from .cells import before


def nearest_peak(anchors: DataFrame, series: DataFrame, before_h: int, after_h: int, key: list[str], at: str = "t0", ts: str = "ts", value: str = "x") -> DataFrame:
    """Anchors with the local peak nearest to them: ``pk_t`` (hours before t0) and ``pk_0``.

    Inside the window a peak isn't lower than its neighbours and is higher than one of them; at
    its ends it isn't lower than the one neighbour.  Of equally near peaks the higher, then the
    earlier.  Anchors without a value in the window have none.
    """
    rows = around(anchors, series.filter(F.col(value).isNotNull()).select(*key, F.col(ts).alias("_ts"), F.col(value).alias("_x")), before_h * 3600, after_h * 3600, key, at, "_ts")
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in anchors.columns]).orderBy("_ts")
    prev, nxt, x = F.lag("_x").over(w), F.lead("_x").over(w), F.col("_x")
    peak = (prev.isNull() | (x >= prev)) & (nxt.isNull() | (x >= nxt)) & (prev.isNull() | nxt.isNull() | (x > prev) | (x > nxt))
    peaks = rows.withColumn("_peak", peak).filter("_peak")
    order = F.struct(F.abs(epoch("_ts") - epoch(at)), -F.col("_x"), F.col("_ts"))
    best = peaks.groupBy(*anchors.columns).agg(F.min_by(F.struct("_ts", "_x"), order).alias("_b"))
    found = best.select(*anchors.columns, ((epoch(at) - epoch("_b._ts")) / 3600).alias("pk_t"), F.col("_b._x").alias("pk_0"))
    return _kept(anchors, found)


def _kept(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """Anchors without a result keep a row of missing values."""
    new = [c for c in found.columns if c not in anchors.columns]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in anchors.columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return anchors.distinct().alias("l").join(found.alias("r"), on, "left").select("l.*", *[F.col(f"r.{c}") for c in new])


def _limited(anchors: DataFrame, series: DataFrame, key: list[str], ts: str, value: str, threshold: str) -> tuple[DataFrame, list[str]]:
    """Rows (_key, _limit, _ts, _x) of the series, once for each different limit of its key's anchors; few, as limits are quantiles of series."""
    limits = anchors.select(*key, F.col(threshold).cast("double").alias("_limit")).filter("_limit is not null").distinct()
    rows = series.filter(F.col(value).isNotNull()).select(*key, F.col(ts).alias("_ts"), F.col(value).alias("_x"))
    return limits.join(rows, key), [*key, "_limit"]


def _over(anchors: DataFrame, found: DataFrame, key: list[str], at: str, threshold: str, columns: list[str]) -> DataFrame:
    """Anchors with what was found for their key, time and limit."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*key, at]] + [F.col(f"a.{threshold}").cast("double") == F.col("f._limit")]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return anchors.distinct().alias("a").join(found.alias("f"), condition, "left").select("a.*", *[F.col(f"f.{c}").alias(c) for c in columns])


def first_crossing(anchors: DataFrame, series: DataFrame, before_h: int, key: list[str], at: str = "t0", ts: str = "ts", value: str = "x", threshold: str = "thr", name: str = "cross") -> DataFrame:
    """Anchors with the first time in the closed window before them at which the value reaches their threshold."""
    rows, wide = _limited(anchors, series, key, ts, value, threshold)
    probes = anchors.select(*key, at, F.col(threshold).cast("double").alias("_limit")).filter("_limit is not null")
    found = before(probes, rows.filter("_x >= _limit"), before_h, wide, {name: (F.col("_ts"), "min")}, at, "_ts")
    return _over(anchors, found, key, at, threshold, [name])


def hours_over(anchors: DataFrame, series: DataFrame, hours: Column | float, key: list[str], at: str = "t0", ts: str = "ts", value: str = "x", threshold: str = "thr", more: tuple[str, ...] = (), most_hours: float | None = None) -> DataFrame:
    """Anchors with the rows over their threshold in the last hours (open at the start) and the summed excess; missing where the window is empty."""
    rows, wide = _limited(anchors, series, key, ts, value, threshold)
    probes = anchors.withColumn("_limit", F.col(threshold).cast("double")).filter("_limit is not null")
    over = F.col("_x") - F.col("_limit")
    values = {"hours_high": (F.when(over > 0, 1.0).otherwise(0.0), "sum"), "excess_sum": (F.when(over > 0, over).otherwise(0.0), "sum")}
    found = before(probes, rows, hours, wide, values, at, "_ts", open_start=True, more=more, most_hours=most_hours)
    return _over(anchors, found, [*key, *more], at, threshold, list(values))


def max_before(anchors: DataFrame, sums: DataFrame, before_h: int, lag_h: Column | int, key: list[str], at: str = "t0", ts: str = "ts", value: str = "s", most_hours: float | None = None) -> DataFrame:
    """Anchors with the greatest rolling sum whose span lies in the window before them; the lag may be a column of theirs."""
    rows = sums.filter(F.col(value).isNotNull()).select(*key, F.col(ts).alias("_ts"), F.col(value).alias("_x"))
    hours = F.lit(before_h) - F.greatest(F.lit(0), lag_h - 1) if isinstance(lag_h, Column) else before_h - max(0, lag_h - 1)
    if not isinstance(hours, Column) and hours < 0:
        return _kept(anchors, anchors.limit(0).withColumn("max_sum", F.lit(None).cast("double")))
    fits = anchors.filter(hours >= 0) if isinstance(hours, Column) else anchors
    return _kept(anchors, anchors.distinct().join(before(fits, rows, hours, key, {"max_sum": (F.col("_x"), "max")}, at, "_ts", most_hours=most_hours or before_h), [*key, at]))


def steepest_by_span(anchors: DataFrame, series: DataFrame, before_h: int, after_h: int, spans_h: tuple[int, ...], key: list[str], at: str = "t0", ts: str = "ts", value: str = "x", digits: int | None = None) -> DataFrame:
    """Anchors with the steepest rise and fall per hour between two rows of the window, for every span that the rows may be apart at most.

    Adds span_h and, for rise and fall, slope, end_h (hours from t0 to its end, negative before),
    end_value and end_rank (of the value within the window).  A slope between two rows is a mean of
    those between the rows from one to the other, so the steepest lies between neighbours: each row
    is compared with the one before it, once for the series, and all spans are read off one pass
    over a window.  Of equal slopes that with the first start; slopes that agree in ``digits``
    decimals are equal, without it only equal doubles are.  Windows of less than two rows have no result; one side of the window must be empty, and is closed at t0 and open at its far end.
    """
    side = "before" if after_h == 0 else "after"
    points = series.filter(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*key, F.col(ts).alias("_ts"), F.col(value).alias("_x"))
    w = Window.partitionBy(*key).orderBy("_ts")
    points = points.withColumns({"_t": F.unix_micros("_ts"), "_b": F.unix_micros(F.lag("_ts").over(w)), "_y": F.lag("_x").over(w)})
    rows = around(anchors, points, before_h * 3600, after_h * 3600, key, at, "_ts", open_start=side == "before", open_end=side == "after")
    # The neighbour before must lie in the window too.
    inside = (F.col("_b") > F.unix_micros(at) - before_h * 3_600_000_000) if side == "before" else (F.col("_b") >= F.unix_micros(at))
    hours = F.when(inside, (F.col("_t") - F.col("_b")) / F.lit(3_600_000_000.0))
    per_window = Window.partitionBy(*[F.col(f"`{c}`") for c in anchors.columns])
    rows = rows.withColumns({"_q": F.cume_dist().over(per_window.orderBy("_x")), "_h": hours, "_s": (F.col("_x") - F.col("_y")) / hours})
    rows = rows.withColumn("_k", F.col("_s") if digits is None else F.round("_s", digits))
    end = F.struct(F.col("_s").alias("slope"), ((F.col("_t") - F.unix_micros(at)) / F.lit(3_600_000_000.0)).alias("end_h"), F.col("_x").alias("end_value"), F.col("_q").alias("end_rank"))
    picks = []
    for span in spans_h:
        fits = (F.col("_h") > 0) & (F.col("_h") <= span)
        for name, sign in (("rise", -1), ("fall", 1)):
            picks.append(F.min_by(F.when(fits, end), F.when(fits, F.struct(F.col("_k") * sign, F.col("_b")))).alias(f"_{name}{span}"))
    best = rows.groupBy(*anchors.columns).agg(*picks, F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    each = F.explode(F.array(*[F.struct(F.lit(span).alias("span_h"), F.col(f"_rise{span}").alias("rise"), F.col(f"_fall{span}").alias("fall")) for span in spans_h]))
    return best.select(*anchors.columns, each.alias("_e")).select(*anchors.columns, "_e.*")


def steepest(anchors: DataFrame, series: DataFrame, before_h: int, after_h: int, span_h: int, key: list[str], fall: bool = False, at: str = "t0", ts: str = "ts", value: str = "x") -> DataFrame:
    """Anchors with slope, end_h, end_value and end_rank of the steepest rise (or fall) within one span; missing where there is none."""
    found = steepest_by_span(anchors, series, before_h, after_h, (span_h,), key, at, ts, value)
    return _kept(anchors, found.select(*anchors.columns, ("fall" if fall else "rise") + ".*"))
