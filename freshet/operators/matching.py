"""State-matched control times: candidate pool, distances to events, and greedy selection.

``greedy`` follows an observation about the tolerance ladder: a pick's tier is always the
tightest tolerance that covers its distance, so all rows can be ranked once and chosen in one
ordered pass per key, of which ``folds`` holds no more than the picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_greatest, doy_distance, epoch, ratio
from .folds import picked
from .stats import capacity, quantile
from .windows import is_peak_over

#: Tolerances from strict to loose, by mode, of the published runs.
TOLERANCES = {"value_pct": (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30), "quantile": (0.005, 0.01, 0.02, 0.05, 0.10)}
TARGETS = ("gw", "q", "prsum", "both", "both_qweighted", "all3")
DAY = 86_400


def pool(candidates: DataFrame, events: DataFrame, season_days: int, buffer_days: int, key: str = "guid", ts: str = "t_anchor", at: str = "event_time") -> DataFrame:
    """Candidates in the season of any event of their key and outside the buffer of all of them.

    Only the days of the year of a key's events matter to the season, and buffers meet in cells.
    """
    days = events.select(F.col(key).alias("_k"), F.dayofyear(at).alias("_d")).distinct()
    near = days.select("_k", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("_doy"), "_d").filter(doy_distance(F.col("_doy"), F.col("_d")) <= season_days).select("_k", "_doy").distinct()
    inside = candidates.join(near, (F.col(key) == F.col("_k")) & (F.dayofyear(ts) == F.col("_doy")), "left_semi")
    width = max(1, buffer_days) * DAY
    cell = F.floor(epoch(F.date_trunc("HOUR", at)) / width)
    around = events.select(F.col(key).alias("_k"), F.date_trunc("HOUR", at).alias("_e"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"))
    close = (F.col(key) == F.col("_k")) & (F.floor(epoch(ts) / width) == F.col("_cell")) & (F.abs(epoch(ts) - epoch("_e")) <= buffer_days * DAY)
    return inside.join(around, close, "left_anti")


def distance(a: Column, b: Column, mode: str) -> Column:
    """Relative to the event's value, or the difference of ranks; missing where it can't be told."""
    if mode not in TOLERANCES:
        raise ValueError(f"unknown match mode {mode!r}")
    return F.abs(a - b) if mode == "quantile" else ratio(F.abs(a - b), F.abs(b))


def distances(candidates: DataFrame, events: DataFrame, mode: str, key: str = "guid", ts: str = "t_anchor", q_weight: float = 0.1) -> DataFrame:
    """Candidates with the least distance per target over their key's events, and the event behind it.

    ``candidates`` has gw, q and prsum; ``events`` has event_ord and the same with _event.
    Minima are taken per measure, so the parts of a combined distance may belong to different
    events; the matched event is that of gw except for q and prsum.
    """
    if q_weight < 0:
        raise ValueError("q_weight must not be negative")
    measures = ("gw", "q", "prsum")
    # The catalogue's events of a key travel as one array, so candidates aren't multiplied.
    e = events.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("event_ord", *[F.col(f"{v}_event").cast("double").alias(v) for v in measures])).alias("_e"))
    out = candidates.join(e, F.col(key) == F.col("_k"))

    def least(v: str) -> Column:
        far = F.lit(float("inf"))
        return F.array_min(F.transform("_e", lambda x: F.struct(F.coalesce(distance(F.col(v), x[v], mode), far).alias("d"), x["event_ord"].alias("o"))))

    out = out.withColumns({f"_{v}": least(v) for v in measures})
    there = lambda v: F.when(F.col(f"_{v}.d") < float("inf"), F.col(f"_{v}.d"))
    out = out.select(*[F.col(c) for c in candidates.columns], *[there(v).alias(f"{v}_dist") for v in measures], *[F.col(f"_{v}.o").alias(f"{v}_event_ord") for v in measures])
    gw, q, pr = F.col("gw_dist"), F.col("q_dist"), F.col("prsum_dist")
    return out.withColumns({"both_dist": all_greatest(gw, pr), "all3_dist": all_greatest(gw, pr, q)}).withColumn("both_qweighted_dist", F.col("both_dist") + F.lit(float(q_weight)) * q)


def greedy(ranked: DataFrame, n_controls: int, min_per_year: int, separation_days: float, tolerances: tuple[float, ...], key: str = "guid", ts: str = "t_anchor", dist: str = "dist", seed: int | None = None) -> DataFrame:
    """(key, t_anchor, dist, year, tier, tolerance, rank): chosen controls per key.

    Equal distances are taken by time, or with ``seed`` in the order of a hash of the time.

    Phase 1 goes through tiers and years and takes up to ``min_per_year`` per tier and year while
    the key lacks controls at the start of the year; phase 2 fills up by tier; rows beyond the
    loosest tolerance come last, as tier n + 1 without a tolerance.  Chosen times lie at least
    ``separation_days`` apart.  At last the best ``n_controls`` by tier, distance and time stay.
    """
    tier = F.lit(len(tolerances) + 1)
    for i, t in reversed(list(enumerate(tolerances, 1))):
        tier = F.when(F.col(dist) <= t, F.lit(i)).otherwise(tier)
    rows = ranked.filter(F.col(dist).isNotNull()).select(key, F.unix_micros(F.date_trunc("HOUR", ts)).alias("h"), F.unix_micros(ts).alias("t"), F.col(dist).alias("d"), F.year(ts).alias("y"), tier.alias("tier"), (F.lit(0).cast("long") if seed is None else F.xxhash64(F.lit(seed), F.unix_micros(ts))).alias("o"))
    first = rows.filter(F.col("tier") <= len(tolerances)).withColumns({"phase": F.lit(1), "g": F.col("y")})
    second = rows.withColumns({"phase": F.lit(2), "g": F.lit(0)})
    chosen = picked(first.unionByName(second), [key], n_controls, min_per_year, int(separation_days * DAY * 1_000_000))
    limit = F.lit(None).cast("double")
    for i, t in enumerate(tolerances, 1):
        limit = F.when(F.col("tier") == i, F.lit(float(t))).otherwise(limit)
    out = chosen.select(key, F.timestamp_micros("t").alias("t_anchor"), F.col("d").alias("dist"), F.col("y").alias("year"), "tier")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("tier", "dist", "t_anchor"))
    return out.withColumn("tolerance", limit).withColumn("rank", rank).filter(F.col("rank") <= n_controls)


def controls(matched: DataFrame, target: str, mode: str = "value_pct", n_controls: int = 25, min_per_year: int = 2, separation_days: float = 7, tolerances: tuple[float, ...] | None = None, key: str = "guid", seed: int | None = None) -> DataFrame:
    """Controls from ``distances`` for one target, with the matched event."""
    if target not in TARGETS:
        raise ValueError(f"unknown match target {target!r}")
    if mode not in TOLERANCES:
        raise ValueError(f"unknown match mode {mode!r}")
    event = f"{target}_event_ord" if target in ("gw", "q", "prsum") else "gw_event_ord"
    picked = greedy(matched.select(key, "t_anchor", F.col(f"{target}_dist").alias("dist")), n_controls, min_per_year, separation_days, tolerances or TOLERANCES[mode], key, seed=seed)
    more = matched.select(key, "t_anchor", F.col(event).alias("event_ord"), *[c for c in matched.columns if c.endswith("_dist")])
    source = F.when(F.col("tolerance").isNull(), F.lit(f"{target}_best_extra")).otherwise(F.lit(target))
    return picked.join(more, [key, "t_anchor"]).withColumns({"match_target": F.lit(target), "match_mode": F.lit(mode), "match_source": source})


def pot_peaks(series: DataFrame, events: DataFrame, *, q: float = 0.95, cap: str | None = None, cap_fraction: float | None = None, buffer_days: int = 3, separation_days: float = 7, per_year: int = 2, key: str = "guid", ts: str = "ts", value: str = "x") -> DataFrame:
    """Peaks over a threshold outside event buffers, declustered per year from the highest down.

    Peaks are found on the rows as they are; their times and those of events then count by the hour.
    """
    thr = quantile(value, q, key)
    if cap is not None and cap_fraction is not None:
        c = capacity(cap, ts, key)
        thr = F.when(c > 0, F.lit(float(cap_fraction)) * c).otherwise(thr)
    peaks = series.withColumn("_thr", thr).withColumn("_peak", is_peak_over(value, F.col("_thr"), key, ts)).filter("_peak").withColumn(ts, F.date_trunc("HOUR", ts))
    width = max(1, buffer_days) * DAY
    cell = F.floor(epoch(F.date_trunc("HOUR", "event_time")) / width)
    near = events.select(F.col(key).alias("_k"), F.date_trunc("HOUR", "event_time").alias("_e"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"))
    close = (F.col(key) == F.col("_k")) & (F.floor(epoch(ts) / width) == F.col("_cell")) & (F.abs(epoch(ts) - epoch("_e")) <= buffer_days * DAY)
    micros = F.unix_micros(ts)
    left = peaks.join(near, close, "left_anti").select(key, F.year(ts).alias("y"), F.year(ts).alias("_year"), (-F.col(value)).alias("d"), micros.alias("t"), micros.alias("h"), F.lit(0).cast("long").alias("o"), F.lit(2).alias("phase"), F.lit(0).alias("tier"), F.lit(0).alias("g"))
    chosen = picked(left, [key, "_year"], per_year, per_year, int(separation_days * DAY * 1_000_000))
    return chosen.select(key, F.timestamp_micros("t").alias("t_anchor"), (-F.col("d")).alias("peak_value"), F.col("y").alias("year"), F.col("n").alias("rank_in_year"))
