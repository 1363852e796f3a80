"""Matched non-event anchors, and the episode table of events and controls together.

A catchment's state is its groundwater signal, its runoff and the rain of the last hours.  Events
have the values nearest in time, candidates (all rows of the signal in season and outside the
events' buffers) those of their own time; both have the values' ranks in the catchment's series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import matching
from ..operators.asof import nearest, regular_sum, snapped
from ..operators.series import groundwater_signal, long_series
from ..operators.stats import ecdf, rank_in
from ..sources.sinks import settled
from . import episodes as ep

KEY = ["guid"]
MEASURES = ("gw", "q", "prsum")
#: Measure: names of its value and rank, as exported, without _anchor or _event.
NAMES = {"gw": ("gw0", "gwq"), "q": ("q0", "qq"), "prsum": ("prsum", "prsum_q")}


def states(sim: DataFrame, gw_def: str = "gw", gw_sm_weight: float = 1.0, prsum_lag_h: int = 72, tolerance_s: float = 1800) -> dict[str, DataFrame]:
    """(guid, ts, x) of each measure, missing values left out."""
    one = lambda v: long_series(sim.select("guid", "ts", v), (v,)).select("guid", "ts", "x")
    gw = groundwater_signal(sim, gw_def, gw_sm_weight).filter("x is not null")
    return {"gw": gw, "q": one("q"), "prsum": regular_sum(one("pr"), prsum_lag_h, tolerance_s, KEY).filter("s is not null").select("guid", "ts", F.col("s").alias("x"))}


def targets(events: DataFrame, state: dict[str, DataFrame], tolerance_s: float = 1800) -> DataFrame:
    """(guid, event_ord, event_time) by the hour, with value and rank of each measure."""
    hour = F.date_trunc("HOUR", "event_time")
    out = events.filter("event_time is not null").select("guid", hour.alias("event_time"))
    out = out.withColumn("event_ord", F.row_number().over(Window.partitionBy("guid").orderBy("event_time")) - 1)
    for v in MEASURES:
        value, rank = (f"{n}_event" for n in NAMES[v])
        out = nearest(out, state[v], tolerance_s, KEY, "event_time", "ts", "x", value)
        out = rank_in(state[v], out, KEY, "x", value).withColumnRenamed("rank", rank)
    return out


def candidates(events: DataFrame, state: dict[str, DataFrame], season_days: int = 30, buffer_days: int = 14) -> DataFrame:
    """(guid, t_anchor) of the pool with value and rank of each measure."""
    ranked = {v: state[v].select("guid", F.col("ts").alias("t_anchor"), F.col("x").alias(f"{NAMES[v][0]}_anchor"), ecdf("x", KEY).alias(f"{NAMES[v][1]}_anchor")) for v in MEASURES}
    out = matching.pool(ranked["gw"], events.filter("event_time is not null"), season_days, buffer_days)
    for v in ("q", "prsum"):
        out = out.join(ranked[v], ["guid", "t_anchor"], "left")
    return out


def matched_anchors(
    events: DataFrame, sim: DataFrame, *, gw_def: str = "gw", gw_sm_weight: float = 1.0, tolerance_s: float = 1800, season_days: int = 30, buffer_days: int = 14, n_controls: int = 25, target: str = "gw",
    mode: str = "value_pct", tolerances: tuple[float, ...] | None = None, prsum_lag_h: int = 72, q_weight: float = 0.1, separation_days: int = 7, min_per_year: int = 2, seed: int | None = None,
) -> DataFrame:
    """The controls of every catchment with events, in 33 columns.

    A catchment without candidates or without a target has no rows.
    """
    state = {v: settled(x, v) for v, x in states(sim, gw_def, gw_sm_weight, prsum_lag_h, tolerance_s).items()}
    wanted, cand = settled(targets(events, state, tolerance_s), "targets"), settled(candidates(events, state, season_days, buffer_days), "candidates")
    kind = 1 if mode == "quantile" else 0
    ladder = tuple(sorted(set(tolerances or matching.TOLERANCES.get(mode, ()))))
    e = wanted.select("guid", "event_ord", *[F.col(f"{NAMES[v][kind]}_event").alias(f"{v}_event") for v in MEASURES])
    c = cand.select("guid", "t_anchor", *[F.col(f"{NAMES[v][kind]}_anchor").alias(v) for v in MEASURES])
    picked = matching.controls(matching.distances(c, e, mode, q_weight=q_weight), target, mode, n_controls, min_per_year, separation_days, ladder, seed=seed)
    listed = F.lit(",".join(map(str, ladder)))
    rows = picked.join(cand, ["guid", "t_anchor"]).join(wanted, ["guid", "event_ord"], "left")
    both = lambda end: [F.col(f"{n}_{end}") for v in ("gw", "prsum", "q") for n in NAMES[v]]
    return rows.select(
        F.col("guid").alias("GUID"), "t_anchor", "rank", F.lit("matched").alias("group"), "match_source", F.col("tolerance").alias("match_tolerance_used"), F.col("tier").alias("match_tier"), F.col("dist").alias("match_distance"),
        "year", F.dayofyear("t_anchor").alias("doy"), *both("anchor"), F.col("event_time").alias("matched_event_time"), *both("event"), F.lit(season_days).alias("season_days"), F.lit(buffer_days).alias("exclude_event_buffer_days"),
        F.lit(n_controls).alias("n_controls"), "match_target", "match_mode", (listed if mode == "value_pct" else F.lit("")).alias("value_tolerance_levels"), (listed if mode == "quantile" else F.lit("")).alias("quantile_tolerance_levels"),
        F.lit(prsum_lag_h).alias("prsum_lag_h"), F.lit(float(q_weight)).alias("q_weight"), F.lit(separation_days).alias("decluster_days"),
    )


def build_episodes(
    events: DataFrame, sim: DataFrame, series: DataFrame, params: DataFrame, *, lags: tuple[int, ...] = ep.LAGS, before_h: int = 72, after_h: int = 72, tolerance_s: float = 1800, gw_def: str = "gw",
    gw_sm_weight: float = 1.0, gw_act_q: float = 0.99, q_act_q: float = 0.99, **selection,
) -> tuple[DataFrame, DataFrame]:
    """(episodes, anchors): one wide row for each valid event and each control, and the controls' own table.

    ``events``: guid, event_time, and No and SkredID if the catalogue has them; ``series`` is the
    long form of ``sim`` with the runoff depth.  Events come with y = 1, No and SkredID; controls with y = 0 and
    the anchor's columns as ne_*.  Times are snapped to the signal's rows, as events' times need
    not be on them.
    """
    anchors = settled(matched_anchors(events, sim, gw_def=gw_def, gw_sm_weight=gw_sm_weight, tolerance_s=tolerance_s, **selection), "controls")
    signal = groundwater_signal(sim, gw_def, gw_sm_weight).filter("x is not null")
    label = lambda c: (F.col(c) if c in events.columns else F.lit(None)).cast("string").alias(c)
    own = [c for c in anchors.columns if c != "GUID"]
    first = events.filter("event_time is not null").select("guid", F.col("event_time").alias("t"), F.lit(1).alias("y"), label("SkredID"), label("No"), F.lit(None).cast(anchors.select(F.struct(*own)).schema[0].dataType).alias("ne"))
    second = anchors.select(F.col("GUID").alias("guid"), F.col("t_anchor").alias("t"), F.lit(0).alias("y"), F.lit(None).cast("string").alias("SkredID"), F.lit(None).cast("string").alias("No"), F.struct(*own).alias("ne"))
    at = settled(snapped(first.unionByName(second), signal, KEY), "anchors")
    rows = ep.episodes(at.select("guid", "t0", "y").distinct(), series, params, lags=lags, before_h=before_h, after_h=after_h, tolerance_s=tolerance_s, gw_act_q=gw_act_q, q_act_q=q_act_q, gw_def=gw_def, gw_sm_weight=gw_sm_weight)
    named = at.select(F.col("guid").alias("GUID"), "t0", "y", "SkredID", "No", *[F.col(f"ne.{c}").alias(f"ne_{c}") for c in own])
    return rows.join(named, ["GUID", "t0", "y"]), anchors
