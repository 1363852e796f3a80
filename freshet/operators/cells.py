"""Aggregates over windows of time before anchors, from summaries of nested cells.

A series is summarised once in cells of BASE_S seconds and in cells twice, four times ... as wide.
A window is two cut base cells at its ends, of which the rows are looked at, and between them the
fewest whole cells, two of each width at most.  So an anchor meets some summaries, whose number
grows with the logarithm of the window, and the rows of two base cells; how many rows lie between,
and how many anchors' windows overlap there, does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the narrowest cells.
BASE_S = 3600
MICROS = 1_000_000


def _cover(first: Column, end: Column, levels: int) -> Column:
    """The fewest whole cells (level, cell) that cover the base cells from ``first`` to before ``end``.

    Of a width those cells are taken that lie in the window but in no wider cell that does: the one
    before and the one after the wider ones, or all where there are none.
    """
    low = [F.shiftright(first + ((1 << k) - 1), k) for k in range(levels + 1)]
    high = [F.shiftright(end, k) for k in range(levels + 1)]
    out = []
    for k in range(levels):
        cells = F.sequence(low[k], high[k] - 1)
        if k < levels - 1:
            edges = F.filter(F.array(F.when(low[k] < low[k + 1] * 2, low[k]), F.when(high[k] > high[k + 1] * 2, high[k] - 1)), lambda x: x.isNotNull())
            cells = F.when(low[k + 1] < high[k + 1], edges).otherwise(cells)
        cells = F.when(low[k] < high[k], cells).otherwise(F.array().cast("array<bigint>"))
        level = F.lit(k).alias("level")
        out.append(F.transform(cells, lambda x: F.struct(level, x.alias("cell"))))  # noqa: B023
    return F.concat(*out)


def before(anchors: DataFrame, series: DataFrame, hours: Column | float, key: list[str], values: dict[str, tuple[Column, str]], at: str = "t0", ts: str = "ts", open_start: bool = False, more: tuple[str, ...] = (), most_hours: float | None = None) -> DataFrame:
    """(key, at, more, values): of each anchor the aggregates over the series' rows in the hours before it, its own time included.

    ``values`` has for each name an expression of a row and how it is aggregated: ``sum``, ``min``,
    ``max`` or ``count``.  ``hours`` may be an expression of the anchors, ``most_hours`` at most;
    ``more`` names columns of theirs that tell apart windows of one key and time.  Anchors without
    a row in the window have no row here.
    """
    levels = max(1, int((most_hours or hours) * 3600 // BASE_S).bit_length())
    span = hours if isinstance(hours, Column) else F.lit(float(hours))
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    start = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    micros, width = F.unix_micros(ts), BASE_S * MICROS
    rows = series.filter(F.col(ts).isNotNull()).select(*key, micros.alias("_t"), F.floor(micros / width).alias("_base"), *[x.alias(n) for n, (x, _) in values.items()])
    base = rows.groupBy(*key, "_base").agg(*[start[how](n).alias(n) for n, (_, how) in values.items()])
    nested = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("_base") / (1 << k)).cast("long").alias("cell")) for k in range(levels)])
    summary = base.select(*key, F.explode(nested).alias("_c"), *values).groupBy(*key, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).agg(*[merge[how](n).alias(n) for n, (_, how) in values.items()])

    # A window is [_low, _high] in micros, an open start being the next one.
    own = [*key, at, *more]
    high = F.unix_micros(at)
    low = high - (span * (3600 * MICROS)).cast("long") + int(open_start)
    probes = anchors.select(*own, low.alias("_low"), high.alias("_high")).distinct().select(*own, "_low", "_high", F.floor(F.col("_low") / width).cast("long").alias("_a"), F.floor(F.col("_high") / width).cast("long").alias("_b"))
    whole = probes.select(*own, F.explode(_cover(F.col("_a") + 1, F.col("_b"), levels)).alias("_c")).select(*own, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    middle = whole.join(summary, [*key, "_level", "_cell"]).select(*own, *values)
    ends = probes.select(*own, "_low", "_high", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_base")).join(rows, [*key, "_base"]).filter("_t >= _low and _t <= _high")
    ends = ends.groupBy(*own).agg(*[start[how](n).alias(n) for n, (_, how) in values.items()])
    return middle.unionByName(ends).groupBy(*own).agg(*[merge[how](n).alias(n) for n, (_, how) in values.items()])
