"""Nearest values in time, rates over hours and sums on a regular grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch


#: Least width in seconds of the time cells in which probes meet values, and its share of the tolerance.
CELL_S, CELL_TOLERANCES = 86_400, 20


def _neighbours(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, _t, _p or null) with the last ``_p`` up to their time and the first one from it on.

    Both are running values, one for each direction of time, so the work is linear in the rows.
    """
    upwards, downwards = Window.partitionBy(*key).orderBy("_t"), Window.partitionBy(*key).orderBy(F.desc("_t"))
    so_far = lambda w: F.last("_p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_before", so_far(upwards)).withColumn("_after", so_far(downwards))


def nearest(probes: DataFrame, series: DataFrame, tolerance_s: float, key: list[str], at: str = "t", ts: str = "ts", value: str = "x", name: str = "near") -> DataFrame:
    """Probes with the value nearest in time within the tolerance; of two equally near the later.

    Probes meet values per key and cell of time, in which both are scanned once in each direction.
    Values go to all cells from which they are within the tolerance, so cells need nothing of each
    other and a long series is many tasks.
    """
    names = probes.columns
    kind = probes.select(F.struct(*names)).schema[0].dataType
    width = max(CELL_S, CELL_TOLERANCES * float(tolerance_s))
    cell = lambda t, shift=0.0: F.floor((epoch(t) + shift) / width)
    point = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    a = series.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*key, F.explode(F.sequence(cell(ts, -tolerance_s), cell(ts, tolerance_s))).alias("_cell"), F.col(ts).alias("_t"), point.alias("_p"), F.lit(None).cast(kind).alias("_row"))
    b = probes.select(*key, cell(at).alias("_cell"), F.col(at).alias("_t"), F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), F.struct(*names).alias("_row"))
    both = _neighbours(a.unionByName(b), [*key, "_cell"])
    t = epoch("_t")
    before, after = t - epoch("_before.t"), epoch("_after.t") - t
    later = before.isNull() | (after <= before)
    distance = F.when(after.isNotNull() & later, after).otherwise(before)
    found = F.when(distance <= tolerance_s, F.when(after.isNotNull() & later, F.col("_after.v")).otherwise(F.col("_before.v")))
    return both.filter("_row is not null").select("_row.*", found.alias(name))


#: Width in seconds of the cells in which a series meets the values some hours before, at least, and in longest lags.
RATE_CELL_S, RATE_CELL_LAGS = 30 * 86_400, 8


def _rates_of_cell(lags: tuple[int, ...], tolerance_us: int):
    """Rates of the rows of one cell, from its rows and those that reach into it, sorted by time once for all lags."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("own").to_numpy(zero_copy_only=False), t := table.column("t").to_numpy()))
        t, x = t[order], table.column("x").to_numpy()[order]
        own = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False)[order])
        columns = {}
        for lag in lags:
            target = t[own] - lag * 3_600_000_000
            after = np.searchsorted(t, target, "left")
            gap_after = np.where(after < len(t), t[np.minimum(after, len(t) - 1)] - target, np.iinfo(np.int64).max)
            gap_before = np.where(after > 0, target - t[np.maximum(after - 1, 0)], np.iinfo(np.int64).max)
            later = gap_after <= gap_before
            near = np.minimum(gap_after, gap_before) <= tolerance_us
            was = x[np.where(later, np.minimum(after, len(t) - 1), np.maximum(after - 1, 0))]
            columns[f"r{lag}"] = pa.array(np.where(near, (x[own] - was) / lag, 0.0), mask=~near)
        names = table.column_names[: len(key) - 1]
        keys = {n: pc.take(table.column(n), pa.array(order[own])) for n in names}
        return pa.table(keys | {"t": pa.array(t[own])} | columns)

    return run


def lag_rates(series: DataFrame, lags: tuple[int, ...], tolerance_s: float, key: list[str], ts: str = "ts", value: str = "x") -> DataFrame:
    """(key, ts, r3, r6 ...): for every row and lag the change per hour against the value nearest to so many hours before; of two equally near the later.

    One shuffle for all lags: rows go to their cell of time and, where they lie within the longest
    lag of the next ones, to these too; in a cell all lags are pointers into one sorted series.
    """
    reach = max(lags) * 3600 + float(tolerance_s)
    width = max(RATE_CELL_S, int(RATE_CELL_LAGS * reach))
    kinds = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in key)
    near = series.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
    cell = F.floor(epoch(ts) / width)
    # A row that lies after another's cell may still be the nearest to its time before, by the tolerance.
    cells = F.explode(F.sequence(F.floor((epoch(ts) - float(tolerance_s)) / width), F.floor((epoch(ts) + reach) / width)))
    rows = near.select(*key, cells.alias("_cell"), cell.alias("_own"), F.unix_micros(ts).alias("t"), F.col(value).cast("double").alias("x")).withColumn("own", F.col("_cell") == F.col("_own")).drop("_own")
    schema = ", ".join([kinds, "t long", *[f"r{h} double" for h in lags]])
    found = rows.groupBy(*key, "_cell").applyInArrow(_rates_of_cell(tuple(lags), int(tolerance_s * 1_000_000)), schema)
    return found.select(*key, F.timestamp_micros("t").alias("ts"), *[f"r{h}" for h in lags])


def rate_series(series: DataFrame, hours: int, tolerance_s: float, key: list[str], ts: str = "ts", value: str = "x") -> DataFrame:
    """(key, ts, r): change per hour against the value nearest to some hours before; missing where there is none."""
    return lag_rates(series, (hours,), tolerance_s, key, ts, value).withColumnRenamed(f"r{hours}", "r")


def regular_sum(series: DataFrame, rows: int, tolerance_s: float, key: list[str], ts: str = "ts", value: str = "x", step_s: int = 3600) -> DataFrame:
    """(key, ts, s): sums of the last ``rows`` points of a regular grid, where all of them are there."""
    cell = lambda c: F.floor(epoch(c) / step_s)
    span = series.filter(F.col(ts).isNotNull()).groupBy(*key).agg(F.min(cell(ts)).alias("a"), F.max(F.ceil(epoch(ts) / step_s)).alias("b"))
    grid = span.select(*key, F.explode(F.sequence("a", "b")).alias("_c")).select(*key, F.timestamp_seconds(F.col("_c") * step_s).alias("ts"))
    near = nearest(grid, series, tolerance_s, key, "ts", ts, value, "_x")
    w = Window.partitionBy(*key).orderBy("ts").rowsBetween(1 - rows, 0)
    return near.select(*key, "ts", F.when(F.count("_x").over(w) == rows, F.sum("_x").over(w)).alias("s"))


def snapped(anchors: DataFrame, series: DataFrame, key: list[str], at: str = "t", ts: str = "ts", name: str = "t0", by_hour: bool = True) -> DataFrame:
    """Anchors with the time of their hour's row if the series has one, else of the nearest row (of two the earlier).

    ``by_hour`` cuts that time to the hour, so it may itself be missing from the series.  Rows and
    anchors meet in cells of time, to which each cell without rows gets the nearest of other cells:
    a running value over a key's cells, not over its rows.
    """
    names, width = anchors.columns, CELL_S
    kind = anchors.select(F.struct(*names)).schema[0].dataType
    hour = F.date_trunc("HOUR", at)
    cell = lambda c: F.floor(epoch(c) / width).cast("long")
    points = series.filter(F.col(ts).isNotNull()).select(*key, cell(ts).alias("_cell"), F.col(ts).alias("_t")).distinct()
    asked = anchors.select(*key, cell(hour).alias("_cell"), hour.alias("_t"), F.struct(*names).alias("_row"))
    # Of each cell in which something is asked the last row before it and the first one after it.
    ends = points.groupBy(*key, "_cell").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    cells = ends.join(asked.select(*key, "_cell").distinct().withColumn("_asked", F.lit(True)), [*key, "_cell"], "full_outer")
    up, down = Window.partitionBy(*key).orderBy("_cell"), Window.partitionBy(*key).orderBy(F.desc("_cell"))
    before = F.last("_last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    near = cells.withColumns({"_p": before, "_q": after}).filter("_asked")
    reach = near.select(*key, "_cell", F.explode(F.array("_p", "_q")).alias("_t")).filter("_t is not null")
    none = F.lit(None).cast(kind)
    a = points.unionByName(reach).select(*key, "_cell", "_t", F.col("_t").alias("_p"), none.alias("_row"))
    b = asked.select(*key, "_cell", "_t", F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), "_row")
    both = _neighbours(a.unionByName(b), [*key, "_cell"])
    earlier = F.col("_after").isNull() | (epoch("_t") - epoch("_before") <= epoch("_after") - epoch("_t"))
    found = F.when(F.col("_before").isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after"))
    return both.filter("_row is not null").select("_row.*", (F.date_trunc("HOUR", found) if by_hour else found).alias(name))


def around(anchors: DataFrame, series: DataFrame, before_s: int, after_s: int, key: list[str], at: str = "t0", ts: str = "ts", *, open_start: bool = False, open_end: bool = False) -> DataFrame:
    """Anchors joined with the series' rows in their window.

    Rows meet in time cells as wide as the window, so each anchor is compared with the rows of
    two cells only, however long the series is.
    """
    width = max(1, before_s + after_s)
    cells = F.sequence(F.floor((epoch(at) - before_s) / width), F.floor((epoch(at) + after_s) / width))
    a = anchors.withColumn("_cell", F.explode(cells))
    b = series.withColumn("_cell", F.floor(epoch(ts) / width))
    low, high = epoch(ts) - (epoch(at) - before_s), (epoch(at) + after_s) - epoch(ts)
    joined = a.join(b, [*key, "_cell"])
    return joined.filter((low > 0 if open_start else low >= 0) & (high > 0 if open_end else high >= 0)).drop("_cell")
