"""Registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import oracles
from .functions.exprs import at_least, epoch, excess
from .operators import asof, matching, peaks, series, stats, windows
from .plans import driver_tables as dt
from .plans import episodes as ep
from .plans import matching as plan
from .plans import panels, stress
from .sources import catalogue, simulation

QUERIES: dict = {}
ORACLES: dict = {}


def _r(x, name):
    return F.round(x, 6).alias(name)


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for the same rows if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


W = "OVER (PARTITION BY guid ORDER BY ts"
G = "OVER (PARTITION BY guid)"

# --- thresholds and normalisation -------------------------------------------------------------


@query(dt.sql("SELECT guid, CASE WHEN m > 0 THEN m ELSE 1.0::DOUBLE END AS dt_hours FROM (SELECT guid, quantile_cont(g, 0.5) / 3600 AS m FROM (SELECT guid, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY guid ORDER BY ts) AS g FROM hourly) GROUP BY guid)"))
def median_dt(spark, sf_dir):
    return stats.median_dt_hours(dt.hourly(spark, sf_dir))


@query(dt.sql("SELECT guid, round(quantile_cont(gw, 0.99), 6) AS gw_q99, round(quantile_cont(sm, 0.9), 6) AS sm_q90, round(quantile_cont(pr, 0.01), 6) AS pr_q01 FROM hourly GROUP BY guid"))
def quantile_threshold(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    return h.select("guid", _r(stats.quantile("gw", 0.99), "gw_q99"), _r(stats.quantile("sm", 0.9), "sm_q90"), _r(stats.quantile("pr", 0.01), "pr_q01")).distinct()


@query(dt.sql("SELECT guid, round(CASE WHEN arg_min(def, ts) > 0 THEN 0.5 * arg_min(def, ts) ELSE quantile_cont(gw, 0.9) END, 6) AS thr FROM hourly GROUP BY guid"))
def capacity_threshold(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    return h.select("guid", _r(stats.threshold("gw", cap=stats.capacity("def"), cap_fraction=0.5, q=0.9), "thr")).distinct()


@query(dt.sql("SELECT guid, round(0.7 * max(pr), 6) AS thr FROM hourly GROUP BY guid"))
def fraction_of_max_threshold(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", _r(stats.fraction_of_max("pr", 0.7), "thr")).distinct()


@query(dt.sql("SELECT h.guid, ts, round(CASE WHEN hi = lo THEN 0 WHEN (gw - lo) / (hi - lo) < 0 THEN 0 WHEN (gw - lo) / (hi - lo) > 1 THEN 1 ELSE (gw - lo) / (hi - lo) END, 6) AS gw_norm, round((pr - plo) / (phi - plo), 6) AS pr_norm FROM hourly h JOIN (SELECT guid, quantile_cont(gw, 0.01) AS lo, quantile_cont(gw, 0.99) AS hi, min(pr) AS plo, max(pr) AS phi FROM hourly GROUP BY guid) q ON h.guid = q.guid"))
def robust_minmax(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    return h.select("guid", "ts", _r(stats.robust_minmax("gw", 0.01, 0.99), "gw_norm"), _r(stats.robust_minmax("pr", 0.0, 1.0), "pr_norm"))


# --- row windows ------------------------------------------------------------------------------


@query(dt.sql(f"SELECT guid, ts, round((gw - lag(gw, 6) {W})) / 0.25, 6) AS rate FROM hourly"))
def lag_rate(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", _r(windows.lag_rate("gw", 6, 6.0), "rate"))


@query(dt.sql(f"SELECT guid, ts, round(sum(coalesce(pr, 0)) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS pr_6h FROM hourly"))
def rolling_sum(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", _r(windows.rolling_sum("pr", 6), "pr_6h"))


@query(dt.sql(f"SELECT guid, ts, round(CASE WHEN d < 0 THEN 0 ELSE d END, 6) AS melt FROM (SELECT guid, ts, lag(swe, 6) {W}) - swe AS d FROM hourly)"))
def positive_drop(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", _r(windows.positive_drop("swe", 6), "melt"))


@query(dt.sql(f"SELECT guid, ts, round(sum(pr) {W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) * (1.0::DOUBLE / 24), 6) AS mem FROM hourly"))
def rolling_memory(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", _r(windows.rolling_memory("pr", 48, 1.0), "mem"))


@query(dt.sql("SELECT guid, ts, CASE WHEN tmp >= 0.5 THEN pr ELSE 0::DOUBLE END AS rain FROM hourly"))
def rain_mask(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", stress.rain(F.col("pr"), F.col("tmp"), stress.RUN).alias("rain"))


@query(dt.sql("SELECT h.guid, ts, round(greatest(gw - q50, 0), 6) AS gw_excess, round(greatest(of_, 0), 6) AS of_excess FROM hourly h JOIN (SELECT guid, quantile_cont(gw, 0.5) AS q50 FROM hourly GROUP BY guid) t ON h.guid = t.guid"))
def excess_over_threshold(spark, sf_dir):
    h = dt.hourly(spark, sf_dir).withColumn("q50", stats.quantile("gw", 0.5))
    return h.select("guid", "ts", _r(excess("gw", "q50"), "gw_excess"), _r(excess("of", F.lit(0.0)), "of_excess"))


@query(dt.sql(f"SELECT guid, ts, round(CASE WHEN r < 0 THEN 0 ELSE r END, 6) AS rise, round(CASE WHEN r >= 0 THEN 0 ELSE -r END, 6) AS fall FROM (SELECT guid, ts, (sm - lag(sm, 6) {W})) / 0.25 AS r FROM hourly)"))
def rate_split(spark, sf_dir):
    h = dt.hourly(spark, sf_dir).withColumn("r", windows.lag_rate("sm", 6, 6.0))
    return h.select("guid", "ts", _r(at_least("r", 0.0), "rise"), _r(at_least(-F.col("r"), 0.0), "fall"))


def _memory_sql(source: str, columns: dict[str, float]) -> tuple[tuple[str, str], ...]:
    """CTEs ``ordered`` and ``memory`` for exponential memories of columns with their tau in days."""
    xs = ", ".join(f"coalesce({c}, 0)::DOUBLE AS x{i}" for i, c in enumerate(columns))
    first = ", ".join(f"x{i} * (1.0::DOUBLE / 24) AS m{i}" for i in range(len(columns)))
    step = ", ".join(f"exp(-(1.0::DOUBLE / 24) / {tau}::DOUBLE) * m.m{i} + o.x{i} * (1.0::DOUBLE / 24)" for i, tau in enumerate(columns.values()))
    return (
        ("ordered", f"SELECT guid, ts, row_number() OVER (PARTITION BY guid ORDER BY ts) AS rn, {xs} FROM {source}"),
        ("memory", f"SELECT guid, ts, rn, {first} FROM ordered WHERE rn = 1 UNION ALL SELECT o.guid, o.ts, o.rn, {step} FROM memory m JOIN ordered o ON o.guid = m.guid AND o.rn = m.rn + 1"),
    )


@query(dt.sql("SELECT guid, ts, round(m0, 6) AS fast, round(m1, 6) AS slow FROM memory", *_memory_sql("hourly", {"pr": 0.05, "gw": 3.0}), recursive=True))
def exp_memory(spark, sf_dir):
    h = windows.exp_memory(dt.hourly(spark, sf_dir), {"fast": ("pr", 0.05), "slow": ("gw", 3.0)}, 1.0)
    return h.select("guid", "ts", _r(F.col("fast"), "fast"), _r(F.col("slow"), "slow"))


_MM = "CASE WHEN max({0}) OVER (PARTITION BY guid) IS NULL THEN NULL WHEN max({0}) OVER (PARTITION BY guid) = min({0}) OVER (PARTITION BY guid) THEN 0 ELSE ({0} - min({0}) OVER (PARTITION BY guid)) / (max({0}) OVER (PARTITION BY guid) - min({0}) OVER (PARTITION BY guid)) END"
_PREC = (
    ("win", f"SELECT guid, ts, sum(pr) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS w FROM hourly"),
    ("exc", f"SELECT guid, ts, greatest(w - 0.2 * max(w) {G}, 0) AS e FROM win"),
    ("nrm", f"SELECT guid, ts, {_MM.format('e')} AS n FROM exc"),
)


@query(dt.sql(f"SELECT guid, ts, round(coalesce({_MM.format('m0')}, 0), 6) AS prec_stress FROM memory", *_PREC, *_memory_sql("nrm", {"n": 1.0}), recursive=True))
def prec_stress(spark, sf_dir):
    """Window sum, threshold at a share of the maximum, normalisation, memory, normalisation."""
    h = dt.hourly(spark, sf_dir).withColumn("w", windows.rolling_sum("pr", 6))
    h = h.withColumn("e", at_least(F.col("w") - stats.fraction_of_max("w", 0.2), 0.0)).withColumn("n", stats.robust_minmax("e", 0.0, 1.0))
    h = windows.exp_memory(h, {"m": ("n", 1.0)}, 1.0)
    return h.select("guid", "ts", _r(F.coalesce(stats.robust_minmax("m", 0.0, 1.0), F.lit(0.0)), "prec_stress"))


# --- stress index -----------------------------------------------------------------------------

_CAP = f"first_value(def) {W})"
_STRESS = (
    ("s1", f"SELECT *, (gw - lag(gw, 6) {W})) / 0.25 AS gr, (sm - lag(sm, 6) {W})) / 0.25 AS sr, sum(CASE WHEN tmp >= 0.5 THEN pr ELSE 0 END) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS pw, lag(swe, 6) {W}) - swe AS md, gw + sm - 0.5 * {_CAP} AS bx FROM hourly"),
    ("s2", "SELECT *, CASE WHEN gr < 0 THEN 0 ELSE gr END AS gp, CASE WHEN sr < 0 THEN 0 ELSE sr END AS sp, CASE WHEN md < 0 THEN 0 ELSE md END AS mw FROM s1"),
    ("s3", f"SELECT guid, ts, CASE WHEN bx < 0 THEN 0 ELSE bx END AS be, CASE WHEN gp - 0.15 * max(gp) {G} < 0 THEN 0 ELSE gp - 0.15 * max(gp) {G} END + CASE WHEN sp - 0.15 * max(sp) {G} < 0 THEN 0 ELSE sp - 0.15 * max(sp) {G} END AS ge, greatest(pw - 0.2 * max(pw) {G}, 0) AS pe, CASE WHEN mw - 0.1 * max(mw) {G} < 0 THEN 0 ELSE mw - 0.1 * max(mw) {G} END AS se, of_ AS oe FROM s2"),
    ("s4", f"SELECT guid, ts, {_MM.format('be')} AS bn, {_MM.format('ge')} AS gn, {_MM.format('pe')} AS pn, {_MM.format('se')} AS sn, {_MM.format('oe')} AS on_ FROM s3"),
    *_memory_sql("s4", {"bn": 3.0, "gn": 1.0, "pn": 1.0, "sn": 1.0, "on_": 1.0}),
    ("s5", "SELECT guid, ts, " + ", ".join(f"coalesce({_MM.format(f'm{i}')}, 0) AS {c}" for i, c in enumerate(stress.COMPONENTS)).replace(" AS of", " AS of_") + " FROM memory"),
)
_SUM = "base + grad + prec + swe + of_"
_PARTS = ", ".join(f"round({c}, 6) AS stress_{n}" for n, c in zip(stress.COMPONENTS, ("base", "grad", "prec", "swe", "of_")))


def _stress(spark, sf_dir, **changes):
    return stress.stress(dt.hourly(spark, sf_dir), replace(stress.RUN, **changes))


def _rounded(df, *names):
    return df.select("guid", "ts", *[_r(F.col(n), n) for n in names])


@query(dt.sql(f"SELECT guid, ts, {_PARTS}, round(({_SUM}) / 5, 6) AS stress_total FROM s5", *_STRESS, recursive=True))
def stress_weighted_mean(spark, sf_dir):
    return _rounded(_stress(spark, sf_dir, final_combine_mode="weighted_mean"), *[f"stress_{c}" for c in stress.COMPONENTS], "stress_total")


@query(dt.sql(f"SELECT guid, ts, round(raw, 6) AS stress_raw, round({_MM.format('raw')}, 6) AS stress_total FROM (SELECT guid, ts, {_SUM} AS raw FROM s5)", *_STRESS, recursive=True))
def stress_sum_norm(spark, sf_dir):
    return _rounded(_stress(spark, sf_dir), "stress_raw", "stress_total")


@query(dt.sql(f"SELECT guid, ts, round(raw, 6) AS stress_raw, round({_MM.format('raw')}, 6) AS stress_total FROM (SELECT guid, ts, base * base + grad * grad + prec * prec + swe * swe + of_ * of_ AS raw FROM s5)", *_STRESS, recursive=True))
def stress_power_norm(spark, sf_dir):
    return _rounded(_stress(spark, sf_dir, final_combine_mode="weighted_sum_power_norm"), "stress_raw", "stress_total")


@query(dt.sql(f"SELECT guid, ts, round(0.5 * {_CAP}, 6) AS thr_storage, round(CASE WHEN bx < 0 THEN 0 ELSE bx END, 6) AS gw_excess FROM s1", _STRESS[0]))
def base_capacity_mode(spark, sf_dir):
    return _rounded(stress.with_excesses(dt.hourly(spark, sf_dir), 1.0, stress.RUN), "thr_storage", "gw_excess")


@query(dt.sql("SELECT h.guid, ts, round(gt, 6) AS thr_gw, round(st, 6) AS thr_sm, round(greatest(gw - gt, 0), 6) AS gw_excess, round(greatest(sm - st, 0), 6) AS sm_excess, round(greatest(of_ - ot, 0), 6) AS of_excess FROM hourly h JOIN (SELECT guid, quantile_cont(gw, 0.99) AS gt, quantile_cont(sm, 0.99) AS st, quantile_cont(of_, 0.9) AS ot FROM hourly GROUP BY guid) t ON h.guid = t.guid"))
def base_store_mode(spark, sf_dir):
    cfg = replace(stress.DEFAULT, include_of_base=True, of_use_zero_threshold=False, of_use_quantile_threshold=True)
    return _rounded(stress.with_excesses(dt.hourly(spark, sf_dir), 1.0, cfg), "thr_gw", "thr_sm", "gw_excess", "sm_excess", "of_excess")


@query(dt.sql(f"SELECT s.guid, ts, round(gr, 6) AS gw_rate, round(q99, 6) AS thr_gw_pos, round(CASE WHEN gp - q99 < 0 THEN 0 ELSE gp - q99 END, 6) AS gw_pos, round(CASE WHEN gn - p90 < 0 THEN 0 ELSE gn - p90 END, 6) AS gw_neg FROM (SELECT *, CASE WHEN gr > 0 THEN 0 ELSE -gr END AS gn FROM s2) s JOIN (SELECT guid, quantile_cont(gp, 0.99) AS q99, quantile_cont(CASE WHEN gr > 0 THEN 0 ELSE -gr END, 0.9) AS p90 FROM s2 GROUP BY guid) t ON s.guid = t.guid", *_STRESS[:2]))
def gradient_component(spark, sf_dir):
    cfg = replace(stress.DEFAULT, include_neg_grad=True)
    return _rounded(stress.with_excesses(dt.hourly(spark, sf_dir), 1.0, cfg), "gw_rate", "thr_gw_pos", "gw_pos", "gw_neg")


@query(dt.sql(f"SELECT guid, ts, round(mw, 6) AS melt_window, round(0.1 * max(mw) {G}, 6) AS thr_swe, round(CASE WHEN mw - 0.1 * max(mw) {G} < 0 THEN 0 ELSE mw - 0.1 * max(mw) {G} END, 6) AS swe_excess FROM s2", *_STRESS[:2]))
def melt_component(spark, sf_dir):
    return _rounded(stress.with_excesses(dt.hourly(spark, sf_dir), 1.0, stress.RUN), "melt_window", "thr_swe", "swe_excess")


@query(oracles.stress_table_sql(_STRESS, _MM))
def stress_event_table(spark, sf_dir):
    """The full export of 53 columns for the wettest hours as events."""
    events = dt.probes(dt.hourly(spark, sf_dir)).select("guid", F.date_format("t0", "MMddHH").alias("no"), F.lit(None).cast("string").alias("skred_id"), F.col("t0").alias("event_time"))
    return _rounded_row(stress.event_tables(_stress(spark, sf_dir), events))


# --- as-of and ranks --------------------------------------------------------------------------

_RAW = ("raw", "SELECT event_type AS guid, ts::TIMESTAMP AS ts, avg(value) AS x FROM events GROUP BY 1, 2")
_HALF = ("half", "SELECT guid, ts + INTERVAL 30 MINUTE AS t FROM hourly")


def _raw(spark, sf_dir):
    return dt.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("guid"), "ts").agg(F.avg("value").alias("x"))


def _near_sql(probe: str, series: str, at: str, tolerance: int, keys: tuple[str, ...] = ("guid",)) -> tuple[tuple[str, str], ...]:
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys)
    back = f"SELECT p.*, s.ts AS bt, s.x AS bx FROM {probe} p ASOF LEFT JOIN {series} s ON {on} AND p.{at} >= s.ts"
    return (
        ("back_", back),
        ("near_", f"SELECT p.*, CASE WHEN s.ts IS NOT NULL AND (bt IS NULL OR epoch_us(s.ts) - epoch_us(p.{at}) <= epoch_us(p.{at}) - epoch_us(bt)) THEN CASE WHEN epoch_us(s.ts) - epoch_us(p.{at}) <= {tolerance}000000 THEN s.x END ELSE CASE WHEN epoch_us(p.{at}) - epoch_us(bt) <= {tolerance}000000 THEN bx END END AS near FROM back_ p ASOF LEFT JOIN {series} s ON {on} AND p.{at} <= s.ts"),
    )


@query(dt.sql("SELECT guid, t, round(near, 6) AS near FROM near_", _RAW, _HALF, *_near_sql("half", "raw", "t", 900)))
def nearest_at(spark, sf_dir):
    half = dt.hourly(spark, sf_dir).select("guid", F.timestamp_micros(F.unix_micros("ts") + 1_800_000_000).alias("t"))
    return asof.nearest(half, _raw(spark, sf_dir), 900, ["guid"]).select("guid", "t", _r(F.col("near"), "near"))


_GW = ("ser", "SELECT guid, ts, gw AS x FROM hourly")
_RATE = (_GW, ("pr_", "SELECT guid, ts AS t_at, x AS x0, ts - INTERVAL 6 HOUR AS t FROM ser"), *_near_sql("pr_", "ser", "t", 5400), ("rat", "SELECT guid, t_at AS ts, (x0 - near) / 6 AS r FROM near_"))


def _gw(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", F.col("gw").alias("x"))


@query(dt.sql("SELECT guid, ts, round(r, 6) AS r FROM rat", *_RATE))
def rate_series(spark, sf_dir):
    return asof.rate_series(_gw(spark, sf_dir), 6, 5400, ["guid"]).select("guid", "ts", _r(F.col("r"), "r"))


_SUMS = (
    ("ser", "SELECT guid, ts, pr AS x FROM hourly"),
    ("grid", "SELECT guid, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM ser GROUP BY guid"),
    ("full_", "SELECT g.guid, g.ts, s.x FROM grid g LEFT JOIN ser s ON g.guid = s.guid AND g.ts = s.ts"),
    ("sm6", f"SELECT guid, ts, CASE WHEN count(x) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 THEN sum(x) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS s FROM full_"),
)


def _pr(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", F.col("pr").alias("x"))


@query(dt.sql("SELECT guid, ts, round(s, 6) AS s FROM sm6", *_SUMS))
def regular_sum(spark, sf_dir):
    return asof.regular_sum(_pr(spark, sf_dir), 6, 1800, ["guid"]).select("guid", "ts", _r(F.col("s"), "s"))


@query(dt.sql("SELECT guid, ts, round(cume_dist() OVER (PARTITION BY guid ORDER BY gw), 6) AS gwq FROM hourly"))
def ecdf(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", _r(stats.ecdf("gw", ["guid"]), "gwq"))


@query(dt.sql("SELECT p.guid, p.t0, round(count(*) FILTER (h.gw <= p.x)::DOUBLE / count(*), 6) AS rank, round(count(*) FILTER (h.gw <= p.x AND h.gw > 0)::DOUBLE / count(*) FILTER (h.gw > 0), 6) AS rank_pos FROM (SELECT b.guid, b.t0, g.pr AS x FROM probes b JOIN hourly g ON b.guid = g.guid AND b.t0 = g.ts) p JOIN hourly h ON p.guid = h.guid GROUP BY 1, 2"))
def ecdf_out_of_sample(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    p = dt.probes(h).join(h.select("guid", F.col("ts").alias("t0"), F.col("pr").alias("p")), ["guid", "t0"])
    ref = h.select("guid", F.col("gw").alias("x"))
    out = stats.rank_in(ref, stats.rank_in(ref, p, ["guid"]).withColumnRenamed("rank", "all"), ["guid"], sign=1)
    return out.select("guid", "t0", _r(F.col("all"), "rank"), _r(F.col("rank"), "rank_pos"))


@query(dt.sql("SELECT guid, ts, round(CASE WHEN r > 0 THEN cume_dist() OVER (PARTITION BY guid, r > 0 ORDER BY r) END, 6) AS rise_rank, round(CASE WHEN r < 0 THEN cume_dist() OVER (PARTITION BY guid, r < 0 ORDER BY r) END, 6) AS fall_rank FROM rat", *_RATE))
def ecdf_pos_neg(spark, sf_dir):
    r = asof.rate_series(_gw(spark, sf_dir), 6, 5400, ["guid"])
    up, down = F.when(F.col("r") > 0, F.col("r")), F.when(F.col("r") < 0, F.col("r"))
    r = r.withColumns({"up": up, "down": down})
    return r.select("guid", "ts", _r(stats.ecdf("up", ["guid"]), "rise_rank"), _r(stats.ecdf("down", ["guid"]), "fall_rank"))


@query(dt.sql(f"SELECT guid, ts, round(gw / max(gw) {G} * 100, 6) AS gw_pct, round(tmp / max(abs(tmp)) {G} * 100, 6) AS tmp_pct FROM hourly"))
def percent_of_max(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", _r(stats.percent_of_max("gw"), "gw_pct"), _r(stats.percent_of_max("tmp", absolute=True), "tmp_pct"))


@query(dt.sql(f"SELECT guid, ts, round((gw + sm - avg(gw + sm) {G}) / stddev_pop(gw + sm) {G}, 6) AS z FROM hourly"))
def zscore(spark, sf_dir):
    return dt.hourly(spark, sf_dir).select("guid", "ts", _r(stats.zscore(F.col("gw") + F.col("sm")), "z"))


@query(dt.sql("SELECT p.guid, p.t0, count(*) FILTER (h.pr > q.thr)::DOUBLE AS hours_high, round(coalesce(sum(h.pr - q.thr) FILTER (h.pr > q.thr), 0), 6) AS excess_sum FROM probes p JOIN (SELECT guid, quantile_cont(pr, 0.9) AS thr FROM hourly GROUP BY guid) q ON p.guid = q.guid JOIN hourly h ON h.guid = p.guid AND h.ts > p.t0 - INTERVAL 24 HOUR AND h.ts <= p.t0 GROUP BY 1, 2"))
def hours_above_q90(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    p = dt.probes(h).join(h.groupBy("guid").agg(F.percentile("pr", F.lit(0.9)).alias("thr")), "guid")
    return peaks.hours_over(p, _pr(spark, sf_dir), 24, ["guid"]).select("guid", "t0", "hours_high", _r(F.col("excess_sum"), "excess_sum"))


@query(dt.sql("SELECT p.guid, p.t0, round(max(s.s), 6) AS max_sum FROM probes p LEFT JOIN sm6 s ON s.guid = p.guid AND s.ts >= p.t0 - INTERVAL 67 HOUR AND s.ts <= p.t0 GROUP BY 1, 2", *_SUMS))
def max_pre_sum(spark, sf_dir):
    s = asof.regular_sum(_pr(spark, sf_dir), 6, 1800, ["guid"])
    return peaks.max_before(dt.probes(dt.hourly(spark, sf_dir)), s, 72, 6, ["guid"]).select("guid", "t0", _r(F.col("max_sum"), "max_sum"))


@query("SELECT guid, v AS var, ts, round(avg(x), 6) AS x FROM (SELECT event_type AS guid, date_trunc('hour', ts)::TIMESTAMP AS ts, 'value' AS v, value AS x FROM events UNION ALL SELECT event_type, date_trunc('hour', ts)::TIMESTAMP, 'user', user_id::DOUBLE FROM events) GROUP BY 1, 2, 3")
def duplicate_mean(spark, sf_dir):
    e = dt.table(spark, sf_dir, "events").select(F.col("event_type").alias("guid"), F.date_trunc("HOUR", "ts").alias("ts"), "value", F.col("user_id").cast("double").alias("user"))
    return series.long_series(e, ("value", "user")).select("guid", "var", "ts", _r(F.col("x"), "x"))


@query(dt.sql("SELECT coalesce(a.guid, b.guid) AS guid, coalesce(a.ts, b.ts) AS ts, round(a.gw + 0.5 * b.sm, 6) AS x FROM (SELECT guid, ts, gw FROM hourly WHERE gw > 100) a FULL JOIN (SELECT guid, ts, sm FROM hourly WHERE sm > 20) b ON a.guid = b.guid AND a.ts = b.ts"))
def gw_signal(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    part = h.select("guid", "ts", F.when(F.col("gw") > 100, F.col("gw")).alias("gw"), F.when(F.col("sm") > 20, F.col("sm")).alias("sm"))
    return series.groundwater_signal(part, "gw_plus_sm", 0.5).select("guid", "ts", _r(F.col("x"), "x"))


@query(dt.sql("SELECT h.guid, ts, round(q * 3.6 / a, 6) AS qmm FROM hourly h JOIN (SELECT event_type AS guid, avg(user_id) / 10 AS a FROM events GROUP BY 1) p ON h.guid = p.guid"))
def runoff_depth(spark, sf_dir):
    area = dt.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("guid")).agg((F.avg("user_id") / 10).alias("area_km2"))
    return series.runoff_depth(dt.hourly(spark, sf_dir), area).select("guid", "ts", _r(F.col("qmm"), "qmm"))


# --- peaks, crossings, slopes -----------------------------------------------------------------

_WIN = ("win_", "SELECT p.guid, p.t0, h.ts, h.gw AS x FROM probes p JOIN hourly h ON h.guid = p.guid AND h.ts >= p.t0 - INTERVAL 72 HOUR AND h.ts <= p.t0 + INTERVAL 72 HOUR")


@query(dt.sql("SELECT guid, t0, round((epoch(t0) - epoch(b.ts)) / 3600, 6) AS pk_t, round(b.x, 6) AS pk_0 FROM (SELECT guid, t0, arg_min({'ts': ts, 'x': x}, {'d': abs(epoch(ts) - epoch(t0)), 'v': -x, 't': ts}) AS b FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS z FROM win_ WINDOW w AS (PARTITION BY guid, t0 ORDER BY ts)) WHERE (a IS NULL OR x >= a) AND (z IS NULL OR x >= z) AND (a IS NULL OR z IS NULL OR x > a OR x > z) GROUP BY 1, 2)", _WIN))
def nearest_peak(spark, sf_dir):
    return peaks.nearest_peak(dt.probes(dt.hourly(spark, sf_dir)), _gw(spark, sf_dir), 72, 72, ["guid"]).select("guid", "t0", _r(F.col("pk_t"), "pk_t"), _r(F.col("pk_0"), "pk_0"))


@query(dt.sql("SELECT p.guid, p.t0, min(h.ts) FILTER (h.gw >= q.thr) AS cross_ts FROM probes p JOIN (SELECT guid, quantile_cont(gw, 0.9) AS thr FROM hourly GROUP BY guid) q ON p.guid = q.guid LEFT JOIN hourly h ON h.guid = p.guid AND h.ts >= p.t0 - INTERVAL 72 HOUR AND h.ts <= p.t0 GROUP BY 1, 2"))
def first_crossing(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    p = dt.probes(h).join(h.groupBy("guid").agg(F.percentile("gw", F.lit(0.9)).alias("thr")), "guid")
    return peaks.first_crossing(p, _gw(spark, sf_dir), 72, ["guid"]).select("guid", "t0", F.col("cross").alias("cross_ts"))


@query(dt.sql("SELECT guid, t0, (epoch(tg) - epoch(tq)) / 3600 AS hxl_pre FROM (SELECT p.guid, p.t0, min(h.ts) FILTER (h.gw >= q.g) AS tg, min(h.ts) FILTER (h.q >= q.q) AS tq FROM probes p JOIN (SELECT guid, quantile_cont(gw, 0.9) AS g, quantile_cont(q, 0.9) AS q FROM hourly GROUP BY guid) q ON p.guid = q.guid LEFT JOIN hourly h ON h.guid = p.guid AND h.ts >= p.t0 - INTERVAL 72 HOUR AND h.ts <= p.t0 GROUP BY 1, 2)"))
def hysteresis_lag(spark, sf_dir):
    """Positive where groundwater crosses later than runoff."""
    h = dt.hourly(spark, sf_dir)
    q = h.groupBy("guid").agg(F.percentile("gw", F.lit(0.9)).alias("g"), F.percentile("q", F.lit(0.9)).alias("q"))
    p = dt.probes(h).join(q, "guid")
    a = peaks.first_crossing(p.select("guid", "t0", F.col("g").alias("thr")), _gw(spark, sf_dir), 72, ["guid"], name="tg")
    b = peaks.first_crossing(p.select("guid", "t0", F.col("q").alias("thr")), h.select("guid", "ts", F.col("q").alias("x")), 72, ["guid"], name="tq")
    return a.drop("thr").join(b.drop("thr"), ["guid", "t0"]).select("guid", "t0", ((epoch("tg") - epoch("tq")) / 3600).alias("hxl_pre"))


def _slope_sql(fall: bool) -> str:
    pairs = "SELECT a.guid, a.t0, (b.x - a.x) / ((epoch(b.ts) - epoch(a.ts)) / 3600) AS s, a.ts AS t_at, b.ts AS bt, b.x AS bx FROM before_ a JOIN before_ b ON a.guid = b.guid AND a.t0 = b.t0 AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR"
    pick = f"arg_min({{'s': s, 't': bt, 'x': bx}}, {{'k': {'s' if fall else '-s'}, 'a': t_at, 'b': bt}})"
    body = f"SELECT guid, t0, round(m.s, 6) AS slope, (epoch(m.t) - epoch(t0)) / 3600 AS end_h, round(m.x, 6) AS end_value FROM (SELECT guid, t0, {pick} AS m FROM ({pairs}) GROUP BY 1, 2)"
    return dt.sql(body, _WIN, ("before_", "SELECT * FROM win_ WHERE ts > t0 - INTERVAL 72 HOUR AND ts <= t0"))


def _slope(spark, sf_dir, fall):
    s = peaks.steepest(dt.probes(dt.hourly(spark, sf_dir)), _gw(spark, sf_dir), 72, 0, 24, ["guid"], fall)
    return s.filter("slope is not null").select("guid", "t0", _r(F.col("slope"), "slope"), "end_h", _r(F.col("end_value"), "end_value"))


@query(_slope_sql(False))
def max_rise(spark, sf_dir):
    return _slope(spark, sf_dir, False)


@query(_slope_sql(True))
def max_fall(spark, sf_dir):
    return _slope(spark, sf_dir, True)


# --- matching ---------------------------------------------------------------------------------

_POOL_SQL = "SELECT d.guid, d.ts AS t_anchor, d.gw, d.q, d.pr FROM daily d WHERE EXISTS (SELECT 1 FROM yearly e WHERE e.guid = d.guid AND least(abs(dayofyear(d.ts) - dayofyear(e.event_time)), 366 - abs(dayofyear(d.ts) - dayofyear(e.event_time))) <= 30) AND NOT EXISTS (SELECT 1 FROM yearly e WHERE e.guid = d.guid AND abs(epoch(d.ts) - epoch(e.event_time)) <= 14 * 86400)"


def _pool(spark, sf_dir):
    d = dt.daily(spark, sf_dir)
    e = dt.yearly_events(d)
    return d, e, matching.pool(d.select("guid", F.col("ts").alias("t_anchor"), "gw", "q", "pr"), e, 30, 14)


@query(dt.sql("SELECT guid, t_anchor, round(gw, 6) AS gw FROM pool_", ("pool_", _POOL_SQL)))
def season_pool(spark, sf_dir):
    return _pool(spark, sf_dir)[2].select("guid", "t_anchor", _r(F.col("gw"), "gw"))


@query(dt.sql("SELECT d.guid, d.ts AS t_anchor FROM daily d WHERE NOT EXISTS (SELECT 1 FROM yearly e WHERE e.guid = d.guid AND abs(epoch(d.ts) - epoch(e.event_time)) <= 14 * 86400)"))
def event_buffer_anti(spark, sf_dir):
    d = dt.daily(spark, sf_dir)
    return matching.pool(d.select("guid", F.col("ts").alias("t_anchor")), dt.yearly_events(d), 366, 14)


_DIST = {"value_pct": "CASE WHEN abs(e.{0}) > 0 THEN abs(c.{0} - e.{0}) / abs(e.{0}) END", "quantile": "abs(c.{0} - e.{0})"}


def _match_sql(mode: str, body: str | None = None, *more: tuple[str, str]) -> str:
    cols = "gw, q, pr" if mode == "value_pct" else "cume_dist() OVER (PARTITION BY guid ORDER BY gw) AS gw, cume_dist() OVER (PARTITION BY guid ORDER BY q) AS q, cume_dist() OVER (PARTITION BY guid ORDER BY pr) AS pr"
    d = ", ".join(f"{_DIST[mode].format(v)} AS d{v}" for v in ("gw", "q", "pr"))
    agg = ", ".join(f"min(d{v}) AS d{v}, CAST(arg_min(event_ord, {{'d': coalesce(d{v}, 'inf'::DOUBLE), 'o': event_ord}}) AS INT) AS o{v}" for v in ("gw", "q", "pr"))
    both = "CASE WHEN dgw IS NOT NULL AND dpr IS NOT NULL THEN greatest(dgw, dpr) END"
    all3 = "CASE WHEN dgw IS NOT NULL AND dpr IS NOT NULL AND dq IS NOT NULL THEN greatest(dgw, dpr, dq) END"
    out = f"round(dgw, 6) AS gw_dist, round(dq, 6) AS q_dist, round(dpr, 6) AS prsum_dist, ogw AS gw_event_ord, oq AS q_event_ord, opr AS prsum_event_ord, round({both}, 6) AS both_dist, round({all3}, 6) AS all3_dist, round({both} + 0.2 * dq, 6) AS both_qweighted_dist"
    ctes = (
        ("pool_", _POOL_SQL), ("vals", f"SELECT guid, ts, {cols} FROM daily"), ("cand", "SELECT p.guid, p.t_anchor, v.gw, v.q, v.pr FROM pool_ p JOIN vals v ON v.guid = p.guid AND v.ts = p.t_anchor"),
        ("ev", "SELECT y.guid, y.event_ord, v.gw, v.q, v.pr FROM yearly y JOIN vals v ON v.guid = y.guid AND v.ts = y.event_time"),
        ("best", f"SELECT guid, t_anchor, {agg} FROM (SELECT c.guid, c.t_anchor, e.event_ord, {d} FROM cand c JOIN ev e ON c.guid = e.guid) GROUP BY 1, 2"),
    )
    if body is None:
        return dt.sql(f"SELECT guid, t_anchor, {out} FROM best", *ctes)
    return dt.sql(body, *ctes, ("matched", f"SELECT *, dgw AS d_gw, {all3} AS d_all3 FROM best"), *more, recursive=True)


def _greedy_sql(ranked: str, ladder: tuple[float, ...], n: int = 25, per_year: int = 2, apart: int = 7 * 86_400) -> tuple[tuple[str, str], ...]:
    """Views up to ``chosen`` (guid, t_anchor, dist, year, tier, tolerance, rank): greedy selection row by row from (guid, t_anchor, dist)."""
    tier = "CASE " + " ".join(f"WHEN dist <= {t} THEN {i}" for i, t in enumerate(ladder, 1)) + f" ELSE {len(ladder) + 1} END"
    limit = "CASE tier " + " ".join(f"WHEN {i} THEN {t}::DOUBLE" for i, t in enumerate(ladder, 1)) + " END"
    new = "(w.phase <> r.phase OR w.tier <> r.tier OR w.g <> r.g)"
    return (
        ("ranked", f"SELECT guid, t_anchor, dist, CAST(epoch(t_anchor) AS BIGINT) AS t, CAST(epoch(date_trunc('hour', t_anchor)) AS BIGINT) AS h, CAST(year(t_anchor) AS INT) AS y, {tier} AS tier FROM ({ranked}) WHERE dist IS NOT NULL"),
        ("both_", f"SELECT *, 1 AS phase, y AS g FROM ranked WHERE tier <= {len(ladder)} UNION ALL SELECT *, 2, 0 FROM ranked"),
        ("queue", "SELECT *, row_number() OVER (PARTITION BY guid ORDER BY phase, tier, g, dist, t) AS n FROM both_"),
        ("walk", f"""SELECT DISTINCT guid, 0::BIGINT AS n, CAST([] AS STRUCT(t BIGINT, h BIGINT, d DOUBLE, y INT, tier INT)[]) AS picks, 0 AS phase, 0 AS tier, 0 AS g, 0::BIGINT AS before_, 0 AS taken FROM queue
 UNION ALL SELECT guid, n, CASE WHEN ok THEN list_append(picks, {{'t': t, 'h': h, 'd': dist, 'y': y, 'tier': tier}}) ELSE picks END, phase, tier, g, before_, taken + CASE WHEN ok THEN 1 ELSE 0 END FROM (
 SELECT *, (CASE WHEN phase = 1 THEN before_ < {n} AND taken < {per_year} ELSE len(picks) < {n} END) AND free AS ok FROM (
 SELECT r.guid, r.n, w.picks, r.phase, r.tier, r.g, r.t, r.h, r.dist, r.y, CASE WHEN {new} THEN len(w.picks) ELSE w.before_ END AS before_, CASE WHEN {new} THEN 0 ELSE w.taken END AS taken,
 len(list_filter(w.picks, lambda p: abs(p.h - r.h) < {apart} OR p.t = r.t)) = 0 AS free FROM walk w JOIN queue r ON r.guid = w.guid AND r.n = w.n + 1))"""),
        ("last_", "SELECT guid, unnest(arg_max(picks, n)) AS p FROM walk GROUP BY guid"),
        ("chosen", f"SELECT guid, make_timestamp(p.t * 1000000) AS t_anchor, p.d AS dist, p.y AS year, p.tier AS tier, {limit.replace('tier', 'p.tier')} AS tolerance, row_number() OVER (PARTITION BY guid ORDER BY p.tier, p.d, p.t) AS rank FROM last_"),
    )


def _controls_sql(body: str, target: str = "gw", mode: str = "value_pct") -> str:
    return _match_sql(mode, body, *_greedy_sql(f"SELECT guid, t_anchor, d_{target} AS dist FROM matched", matching.TOLERANCES[mode]))


_CONTROLS = "SELECT c.guid, c.t_anchor, CAST(c.rank AS INT) AS rank, c.tier, c.tolerance, round(c.dist, 6) AS dist, m.ogw AS event_ord, CASE WHEN c.tolerance IS NULL THEN '{0}_best_extra' ELSE '{0}' END AS match_source FROM chosen c JOIN matched m ON m.guid = c.guid AND m.t_anchor = c.t_anchor WHERE c.rank <= 25"


def _matched(spark, sf_dir, mode):
    d, e, pool = _pool(spark, sf_dir)
    v = d.select("guid", "ts", *[(F.col(c) if mode == "value_pct" else stats.ecdf(c, ["guid"])).alias(n) for c, n in (("gw", "gw"), ("q", "q"), ("pr", "prsum"))])
    cand = pool.select("guid", "t_anchor").join(v.withColumnRenamed("ts", "t_anchor"), ["guid", "t_anchor"])
    ev = e.join(v.withColumnRenamed("ts", "event_time"), ["guid", "event_time"]).select("guid", "event_ord", *[F.col(n).alias(f"{n}_event") for n in ("gw", "q", "prsum")])
    return matching.distances(cand, ev, mode, q_weight=0.2)


def _match(spark, sf_dir, mode):
    names = ("gw_dist", "q_dist", "prsum_dist", "both_dist", "all3_dist", "both_qweighted_dist")
    return _matched(spark, sf_dir, mode).select("guid", "t_anchor", *[_r(F.col(n), n) for n in names], "gw_event_ord", "q_event_ord", "prsum_event_ord")


@query(_match_sql("value_pct"))
def match_distances(spark, sf_dir):
    return _match(spark, sf_dir, "value_pct")


@query(_match_sql("quantile"))
def match_distances_quantile(spark, sf_dir):
    return _match(spark, sf_dir, "quantile")


def _controls(spark, sf_dir, target="gw", mode="value_pct"):
    return matching.controls(_matched(spark, sf_dir, mode), target, mode)


@query(_controls_sql(_CONTROLS.format("gw")))
def controls_greedy(spark, sf_dir):
    return _controls(spark, sf_dir).select("guid", "t_anchor", "rank", "tier", "tolerance", _r(F.col("dist"), "dist"), "event_ord", "match_source")


@query(_controls_sql(_CONTROLS.format("all3"), "all3", "quantile"))
def controls_all3_quantile(spark, sf_dir):
    return _controls(spark, sf_dir, "all3", "quantile").select("guid", "t_anchor", "rank", "tier", "tolerance", _r(F.col("dist"), "dist"), "event_ord", "match_source")


@query(_controls_sql("SELECT guid, tier, tolerance, count(*) AS n FROM chosen WHERE rank <= 25 GROUP BY 1, 2, 3"))
def tier_histogram(spark, sf_dir):
    return stats.histogram(_controls(spark, sf_dir), ["guid", "tier", "tolerance"])


@query(_controls_sql("SELECT guid, t_anchor, tier, round(dist, 6) AS dist FROM (SELECT * FROM chosen WHERE rank <= 25 ORDER BY dist DESC, guid, t_anchor LIMIT 10)"))
def worst_matches(spark, sf_dir):
    """The report of the ten worst matches."""
    return _controls(spark, sf_dir).orderBy(F.desc("dist"), "guid", "t_anchor").limit(10).select("guid", "t_anchor", "tier", _r(F.col("dist"), "dist"))


_POT = (
    ("thr", "SELECT guid, ts, gw AS x, quantile_cont(gw, 0.95) OVER (PARTITION BY guid) AS thr, lag(gw) OVER (PARTITION BY guid ORDER BY ts) AS b, lead(gw) OVER (PARTITION BY guid ORDER BY ts) AS a FROM daily"),
    ("peak", "SELECT guid, ts, x, year(ts) AS y FROM thr t WHERE x > b AND x >= a AND x > thr AND NOT EXISTS (SELECT 1 FROM yearly e WHERE e.guid = t.guid AND abs(epoch(t.ts) - epoch(e.event_time)) <= 3 * 86400)"),
    ("one", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY guid, y ORDER BY x DESC, ts) AS r FROM peak) WHERE r = 1"),
    ("two", "SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.guid, p.y ORDER BY p.x DESC, p.ts) AS r FROM peak p JOIN one o ON o.guid = p.guid AND o.y = p.y WHERE abs(epoch(p.ts) - epoch(o.ts)) >= 7 * 86400) WHERE r = 1"),
)


@query(dt.sql("SELECT guid, ts AS t_anchor, x AS peak_value, CAST(y AS INT) AS year, 1 AS rank_in_year FROM one UNION ALL SELECT guid, ts, x, CAST(y AS INT), 2 FROM two", *_POT))
def pot_peaks(spark, sf_dir):
    """Two peaks a year at most, away from the yearly events."""
    d = dt.daily(spark, sf_dir)
    return matching.pot_peaks(d.select("guid", "ts", F.col("gw").alias("x")), dt.yearly_events(d))


def weekly_events(hours):
    """The hour with the highest gw per catchment and week."""
    w = F.row_number().over(Window.partitionBy("guid", F.date_trunc("WEEK", "ts")).orderBy(F.desc("gw"), "ts"))
    return hours.withColumn("_r", w).filter("_r = 1").select("guid", F.col("ts").alias("event_time"), F.date_format("ts", "yyyyMMddHH").alias("SkredID"), F.lit(None).cast("string").alias("No"))


_ANCHORS = dict(season_days=5, buffer_days=2, separation_days=1, prsum_lag_h=6, min_per_year=2)
_RANKS = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN cume_dist() OVER (PARTITION BY guid, {v} IS NOT NULL ORDER BY {v}) END AS {r}" for v, r in (("gw", "gwq"), ("q", "qq"), ("s", "sq")))
_ANCHOR_VIEWS = (
    *_SUMS,
    ("vals", f"SELECT guid, ts, gw, q, s, {_RANKS} FROM (SELECT guid, ts, h.gw, h.q, m.s FROM sm6 m LEFT JOIN hourly h USING (guid, ts))"),
    ("ev", "SELECT *, row_number() OVER (PARTITION BY guid ORDER BY ts) - 1 AS o FROM (SELECT *, row_number() OVER (PARTITION BY guid, date_trunc('week', ts) ORDER BY gw DESC, ts) AS r FROM vals WHERE gw IS NOT NULL) WHERE r = 1"),
    ("cand", "SELECT * FROM vals c WHERE gw IS NOT NULL AND EXISTS (SELECT 1 FROM ev e WHERE e.guid = c.guid AND least(abs(dayofyear(c.ts) - dayofyear(e.ts)), 366 - abs(dayofyear(c.ts) - dayofyear(e.ts))) <= 5) AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.guid = c.guid AND abs(epoch(c.ts) - epoch(e.ts)) <= 2 * 86400)"),
    ("best", "SELECT guid, ts AS t_anchor, min(d) AS d, arg_min(o, {'d': d, 'o': o}) AS o FROM (SELECT c.guid, c.ts, e.o, abs(c.gw - e.gw) / abs(e.gw) AS d FROM cand c JOIN ev e ON e.guid = c.guid) GROUP BY 1, 2"),
)
_LADDER = ",".join(map(str, matching.TOLERANCES["value_pct"]))


def _anchors_sql(body: str) -> str:
    return dt.sql(body, *_ANCHOR_VIEWS, *_greedy_sql("SELECT guid, t_anchor, d AS dist FROM best", matching.TOLERANCES["value_pct"], apart=86_400), recursive=True)


@query(_anchors_sql(f"""SELECT c.guid AS "GUID", c.t_anchor, CAST(c.rank AS INT) AS rank, 'matched' AS "group", CASE WHEN c.tolerance IS NULL THEN 'gw_best_extra' ELSE 'gw' END AS match_source, c.tolerance AS match_tolerance_used, c.tier AS match_tier, round(c.dist, 6) AS match_distance, c.year, CAST(dayofyear(c.t_anchor) AS INT) AS doy,
 round(a.gw, 6) AS gw0_anchor, round(a.gwq, 6) AS gwq_anchor, round(a.s, 6) AS prsum_anchor, round(a.sq, 6) AS prsum_q_anchor, round(a.q, 6) AS q0_anchor, round(a.qq, 6) AS qq_anchor, e.ts AS matched_event_time,
 round(e.gw, 6) AS gw0_event, round(e.gwq, 6) AS gwq_event, round(e.s, 6) AS prsum_event, round(e.sq, 6) AS prsum_q_event, round(e.q, 6) AS q0_event, round(e.qq, 6) AS qq_event, 5 AS season_days, 2 AS exclude_event_buffer_days, 25 AS n_controls, 'gw' AS match_target, 'value_pct' AS match_mode,
 '{_LADDER}' AS value_tolerance_levels, '' AS quantile_tolerance_levels, 6 AS prsum_lag_h, 0.1::DOUBLE AS q_weight, 1 AS decluster_days
 FROM chosen c JOIN vals a ON a.guid = c.guid AND a.ts = c.t_anchor JOIN best b ON b.guid = c.guid AND b.t_anchor = c.t_anchor JOIN ev e ON e.guid = c.guid AND e.o = b.o WHERE c.rank <= 25"""))
def matched_anchors(spark, sf_dir):
    """The 33 columns of the controls of weekly events."""
    h = dt.hourly(spark, sf_dir)
    out = plan.matched_anchors(weekly_events(h), h, **_ANCHORS)
    return out.select(*[_r(F.col(c), c) if c == "match_distance" or c.endswith(("_anchor", "_event")) and c != "t_anchor" else F.col(c) for c in out.columns])


#: Columns of a control beside its episode, by name: the value in the SQL of the anchors; events have none of them.
_CONTROL = {
    "t_anchor": "c.t_anchor", "rank": "c.rank::DOUBLE", "group": "'matched'", "match_source": "CASE WHEN c.tolerance IS NULL THEN 'gw_best_extra' ELSE 'gw' END", "match_tolerance_used": "c.tolerance", "match_tier": "c.tier::DOUBLE", "match_distance": "round(c.dist, 6)",
    "year": "c.year::DOUBLE", "doy": "dayofyear(c.t_anchor)::DOUBLE", **{f"{n}_anchor": f"round(a.{c}, 6)" for n, c in (("gw0", "gw"), ("gwq", "gwq"), ("prsum", "s"), ("prsum_q", "sq"), ("q0", "q"), ("qq", "qq"))}, "matched_event_time": "e.ts",
    **{f"{n}_event": f"round(e.{c}, 6)" for n, c in (("gw0", "gw"), ("gwq", "gwq"), ("prsum", "s"), ("prsum_q", "sq"), ("q0", "q"), ("qq", "qq"))}, "season_days": "5::DOUBLE", "exclude_event_buffer_days": "2::DOUBLE", "n_controls": "25::DOUBLE",
    "match_target": "'gw'", "match_mode": "'value_pct'", "value_tolerance_levels": f"'{_LADDER}'", "quantile_tolerance_levels": "''", "prsum_lag_h": "6::DOUBLE", "q_weight": "0.1::DOUBLE", "decluster_days": "1::DOUBLE",
}
_CONTROL_ROWS = (
    "SELECT guid, ts AS t0, 1 AS y, strftime(ts, '%Y%m%d%H') AS \"SkredID\", NULL::VARCHAR AS \"No\", " + ", ".join(f"NULL AS ne_{n}" for n in _CONTROL) + " FROM ev UNION ALL SELECT c.guid, c.t_anchor, 0, NULL, NULL, " + ", ".join(_CONTROL.values())
    + " FROM chosen c JOIN vals a ON a.guid = c.guid AND a.ts = c.t_anchor JOIN best b ON b.guid = c.guid AND b.t_anchor = c.t_anchor JOIN ev e ON e.guid = c.guid AND e.o = b.o WHERE c.rank <= 25"
)


def _apart(text: str) -> str:
    """The anchors' views under names that the wide row's don't have."""
    return re.sub(r"\b(ser|ranked|grid|full_)\b", r"\1a", text)


_ANCHOR_PROBES = (*[(_apart(n), _apart(x)) for n, x in (*_ANCHOR_VIEWS, *_greedy_sql("SELECT guid, t_anchor, d AS dist FROM best", matching.TOLERANCES["value_pct"], apart=86_400))], ("probes", "SELECT guid, ts AS t0 FROM ev UNION SELECT guid, t_anchor FROM chosen WHERE rank <= 25"))


@query(oracles.wide_sql(anchors=_ANCHOR_PROBES, rows=_CONTROL_ROWS, more_columns=('"SkredID"', '"No"', *[f"ne_{n}" for n in _CONTROL]), recursive=True))
def episodes_matched(spark, sf_dir):
    """Events and their controls in one table of 661 columns."""
    _, s, p = _episode_inputs(spark, sf_dir)
    h = dt.hourly(spark, sf_dir)
    rows, _ = plan.build_episodes(weekly_events(h), h, s, p, **_ANCHORS)
    rows = rows.select(*[F.col(c).cast("double").alias(c) if c.startswith("ne_") and t in ("int", "bigint") else F.col(c) for c, t in rows.dtypes])
    return _rounded_row(rows)


# --- episodes ---------------------------------------------------------------------------------


def _episode_inputs(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    area = h.groupBy("guid").agg((F.count(F.lit(1)) / 100.0).alias("area_km2"), F.min_by("def", "ts").alias("cap"), F.avg("q").alias("MRT"), F.avg("tmp").alias("meandailyT")).withColumn("HI", F.lit(0.5))
    wide = h.join(area.select("guid", "area_km2"), "guid").withColumn("qmm", F.col("q") * 3.6 / F.col("area_km2"))
    return dt.probes(h).withColumn("y", F.lit(1)), series.long_series(wide, ep.VARIABLES), area


@query(oracles.wide_sql())
def episodes_wide(spark, sf_dir):
    """All 627 columns."""
    return _rounded_row(ep.episodes(*_episode_inputs(spark, sf_dir)))


def _rounded_row(df):
    return df.select(*[_r(F.col(c), c) if t == "double" else F.col(c) for c, t in df.dtypes])


_AT = ("at_", f"SELECT p.guid, p.t0, h.gw, h.pr, h.q, h.sm, round(h.gw / h.mx * 100, 6) AS gwpmx, h.rk, h.cap FROM probes p JOIN (SELECT *, max(gw) {G} AS mx, cume_dist() OVER (PARTITION BY guid ORDER BY gw) AS rk, first_value(def) {W}) AS cap FROM hourly) h ON h.guid = p.guid AND h.ts = p.t0")


@query(dt.sql("SELECT guid, t0, round(gw, 6) AS gw0, round(rk, 6) AS gwq, gwpmx, round(gw / cap * 100, 6) AS gwp, round(pr, 6) AS pr0, round(gw + sm, 6) AS total_storage FROM at_", _AT))
def episode_anchor(spark, sf_dir):
    at, s, p = _episode_inputs(spark, sf_dir)
    a = ep.anchor_features(at.select("guid", "t0"), s, 1800)
    x = lambda v, c: F.max(F.when(F.col("var") == v, F.col(c)))
    rows = a.groupBy("guid", "t0").agg(x("gw", "x0").alias("gw0"), x("gw", "rank").alias("gwq"), x("gw", "top").alias("top"), x("pr", "x0").alias("pr0"), x("sm", "x0").alias("sm0")).join(p.select("guid", "cap"), "guid")
    return rows.select("guid", "t0", _r(F.col("gw0"), "gw0"), _r(F.col("gwq"), "gwq"), _r(F.col("gw0") / F.col("top") * 100, "gwpmx"), _r(F.col("gw0") / F.col("cap") * 100, "gwp"), _r(F.col("pr0"), "pr0"), _r(F.col("gw0") + F.col("sm0"), "total_storage"))


@query(dt.sql("SELECT guid, t0, round(r, 6) AS gwr6b, round(r / a * 100, 6) AS gwrpmx6b, round(rk, 6) AS gwrq6b FROM (SELECT p.guid, p.t0, x.r, x.a, x.rk FROM probes p LEFT JOIN (SELECT guid, ts, r, max(abs(r)) OVER (PARTITION BY guid) AS a, cume_dist() OVER (PARTITION BY guid ORDER BY r) AS rk FROM rat WHERE r IS NOT NULL) x ON x.guid = p.guid AND x.ts = p.t0)", _GW, ("pr_", "SELECT guid, ts AS t_at, x AS x0, ts - INTERVAL 6 HOUR AS t FROM ser"), *_near_sql("pr_", "ser", "t", 1800), ("rat", "SELECT guid, t_at AS ts, (x0 - near) / 6 AS r FROM near_")))
def episode_rates(spark, sf_dir):
    at, s, _ = _episode_inputs(spark, sf_dir)
    s = s.filter("var = 'gw'")
    r = ep.rate_features(at.select("guid", "t0"), s, ep.rates(s, (6,), 1800), (6,), 1800).filter("var = 'gw'")
    return r.select("guid", "t0", _r(F.col("r"), "gwr6b"), _r(F.col("r") / F.col("abs_top") * 100, "gwrpmx6b"), _r(F.col("rank_all"), "gwrq6b"))


@query(dt.sql("SELECT p.guid, p.t0, round(x.s, 6) AS \"prS6b\", round(x.s / x.mx * 100, 6) AS \"prSpmx6b\", round(x.rk, 6) AS \"prSq6b\" FROM probes p LEFT JOIN (SELECT guid, ts, s, max(s) OVER (PARTITION BY guid) AS mx, cume_dist() OVER (PARTITION BY guid ORDER BY s) AS rk FROM sm6 WHERE s IS NOT NULL) x ON x.guid = p.guid AND x.ts = p.t0", *_SUMS))
def episode_sums(spark, sf_dir):
    at, s, _ = _episode_inputs(spark, sf_dir)
    x = ep.sum_features(at.select("guid", "t0"), ep.sums(s, (6,), 1800), (6,), 72, 1800).filter("var = 'pr'")
    return x.select("guid", "t0", _r(F.col("S"), "prS6b"), _r(F.col("S") / F.col("top") * 100, "prSpmx6b"), _r(F.col("rank"), "prSq6b"))


@query(oracles.legacy_sql())
def episode_legacy(spark, sf_dir):
    """All 719 columns of the older row."""
    return _rounded_row(ep.legacy_episodes(*_episode_inputs(spark, sf_dir)))


@query(oracles.dictionary_sql())
def feature_dictionary(spark, sf_dir):
    return ep.feature_dictionary(_episode_inputs(spark, sf_dir)[1])


# --- catalogue, parameters, panels ------------------------------------------------------------

_CAT = "SELECT o_orderpriority AS guid, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS VARCHAR) END AS skred_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS no, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS mean_annual_flood, o_orderdate::TIMESTAMP AS event_time, o_orderkey FROM orders"
_SCORE = "(CASE WHEN no IS NULL THEN 0 ELSE 1 END + CASE WHEN skred_id IS NULL THEN 0 ELSE 1 END + CASE WHEN mean_annual_flood IS NULL THEN 0 ELSE 1 END)"


def _catalogue(spark, sf_dir):
    o = dt.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_orderpriority").alias("guid"), F.when(k % 7 != 0, (F.col("o_custkey") % 50).cast("string")).alias("skred_id"), F.when(k % 3 != 0, k.cast("string")).alias("no"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("mean_annual_flood"), F.col("o_orderdate").alias("event_time"), k)


@query(dt.sql(f"SELECT guid, skred_id, no, round(mean_annual_flood, 6) AS mean_annual_flood, event_time FROM (SELECT *, row_number() OVER (PARTITION BY guid, skred_id ORDER BY {_SCORE} DESC, o_orderkey) AS r FROM cat) WHERE r = 1", ("cat", _CAT)))
def catalogue_dedupe(spark, sf_dir):
    return catalogue.best_of_duplicates(_catalogue(spark, sf_dir), "o_orderkey").select("guid", "skred_id", "no", _r(F.col("mean_annual_flood"), "mean_annual_flood"), "event_time")


@query(dt.sql("SELECT guid, skred_id, o_orderkey, n AS n_in_group FROM (SELECT *, count(*) OVER (PARTITION BY guid, skred_id) AS n FROM cat) WHERE n > 1", ("cat", _CAT)))
def dup_report(spark, sf_dir):
    return catalogue.duplicates(_catalogue(spark, sf_dir)).select("guid", "skred_id", "o_orderkey", "n_in_group")


@query(dt.sql("SELECT guid, count(*) AS n_rows, count(DISTINCT skred_id) AS n_skred_id, count(DISTINCT no) AS n_no FROM cat GROUP BY guid", ("cat", _CAT)))
def run_summary(spark, sf_dir):
    """What a run reports of the catalogue: its rows and distinct events per catchment."""
    return stats.run_summary(_catalogue(spark, sf_dir), ["skred_id", "no"], ["guid"])


@query(dt.sql(f"SELECT o_orderkey, {_SCORE} AS info FROM cat", ("cat", _CAT)))
def completeness_score(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return c.select("o_orderkey", stats.info_score(c, ["no", "skred_id", "mean_annual_flood"]).alias("info"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def valid_events_semi(spark, sf_dir):
    o, c = dt.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "guid"), dt.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "guid")
    return catalogue.valid_events(o, c.filter("c_acctbal > 0"), c.filter("c_nationkey < 10")).select("o_orderkey", F.col("guid").alias("o_custkey"))


_PAR = "SELECT CAST(p_partkey % 100 AS VARCHAR) AS guid, CASE p_partkey % 4 WHEN 0 THEN 'heightMin' WHEN 1 THEN 'height10' WHEN 2 THEN 'height90' ELSE 'area_m2' END AS par, max(p_retailprice) AS value FROM part GROUP BY 1, 2"


@query(f"SELECT guid, round(area / 1e6, 8) AS area_km2, round(CASE WHEN h90 - hm <> 0 THEN (h10 - hm) / (h90 - hm) END, 6) AS hi FROM (SELECT guid, max(value) FILTER (par = 'area_m2') AS area, max(value) FILTER (par = 'heightMin') AS hm, max(value) FILTER (par = 'height10') AS h10, max(value) FILTER (par = 'height90') AS h90 FROM ({_PAR}) GROUP BY guid)")
def param_derived(spark, sf_dir):
    p = dt.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.groupBy((k % 100).cast("string").alias("guid"), F.when(k % 4 == 0, "heightMin").when(k % 4 == 1, "height10").when(k % 4 == 2, "height90").otherwise("area_m2").alias("par")).agg(F.max("p_retailprice").alias("value"))
    return simulation.wide_parameters(rows).select("guid", F.round("area_km2", 8).alias("area_km2"), _r(F.col("HI"), "hi"))




def _rows_sql(before: int, after: int) -> tuple[tuple[str, str], ...]:
    return (("num_", f"SELECT *, row_number() {W}) AS n FROM hourly"), ("ctr", "SELECT p.guid, p.t0, x.n AS c FROM probes p JOIN num_ x ON x.guid = p.guid AND x.ts = p.t0"), ("rows_", f"SELECT x.guid, c.t0 AS event_ts, x.ts, x.q, x.gw, CAST(x.n - c.c AS INT) AS off_ FROM ctr c JOIN num_ x ON x.guid = c.guid AND x.n BETWEEN c.c - {before} AND c.c + {after}"))


def _events_at(h):
    return dt.probes(h).select("guid", F.col("t0").alias("event_ts"))


@query(dt.sql("SELECT guid, event_ts, ts, off_ AS \"offset\", round(gw, 6) AS gw FROM rows_", *_rows_sql(48, 12)))
def event_window(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    return panels.event_window(h.select("guid", "ts", "gw"), _events_at(h), 1.0).select("guid", "event_ts", "ts", "offset", _r(F.col("gw"), "gw"))


@query(dt.sql("SELECT guid, event_ts, ts, q, round(gw, 6) AS gw, unnest(CASE WHEN off_ < 0 THEN ['before'] WHEN off_ > 0 THEN ['after'] ELSE ['before', 'event', 'after'] END) AS label FROM rows_", *_rows_sql(48, 72)))
def hysteresis_panel(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    return panels.hysteresis(h, _events_at(h), 1.0).select("guid", "event_ts", "ts", "q", _r(F.col("gw"), "gw"), "label")


@query(dt.sql("SELECT guid, round(max(gw) * 1.1, 6) AS gw_limit, round(max(pr) * 1.1, 6) AS pr_limit FROM hourly GROUP BY guid"))
def axis_limits(spark, sf_dir):
    return panels.axis_limits(dt.hourly(spark, sf_dir), ["gw", "pr"], ["guid"]).select("guid", _r(F.col("gw_limit"), "gw_limit"), _r(F.col("pr_limit"), "pr_limit"))


_ON = "x.guid = c.guid AND x.n BETWEEN c.c - 48 AND c.c + 72"
_W_EVENT = "OVER (PARTITION BY guid, event_ts)"
_PANEL_VIEWS = (
    *_STRESS,
    ("tot", f"SELECT guid, ts, {_MM.format('raw')} AS total FROM (SELECT guid, ts, {_SUM} AS raw FROM s5)"),
    ("num_", f"SELECT h.*, tot.total, s5.base, s5.grad, s5.prec AS prec_, s5.swe AS swe_, s5.of_ AS of2, row_number() OVER (PARTITION BY h.guid ORDER BY h.ts) AS n, first_value(h.def) OVER (PARTITION BY h.guid ORDER BY h.ts) AS cap FROM hourly h JOIN tot USING (guid, ts) JOIN s5 USING (guid, ts)"),
    ("ctr", "SELECT p.guid, p.t0, x.n AS c FROM probes p JOIN num_ x ON x.guid = p.guid AND x.ts = p.t0"),
    ("rows_", f"SELECT x.*, c.t0 AS event_ts, CAST(x.n - c.c AS INT) AS off_, x.n - c.c <= 12 AS inw FROM ctr c JOIN num_ x ON {_ON}"),
)


def _stressed_events(spark, sf_dir):
    h = dt.hourly(spark, sf_dir)
    return stress.stress(h, stress.RUN, 1.0), dt.probes(h).select("guid", F.date_format("t0", "MMddHH").alias("no"), F.col("t0").alias("event_ts"))


def _limit_sql(column: str, share: float) -> str:
    top = f"max({column}) FILTER (inw) {_W_EVENT}"
    return f"CASE WHEN {top} > 0 THEN {top} * {share} ELSE 1 END"


_PANEL_COLUMNS = {
    "pr": "pr", "tmp": "tmp", "q": "q", "of": "of_", "gw": "gw", "sm": "sm", "swe": "swe", "stress_total": "total", "stress_base": "base", "stress_grad": "grad", "stress_prec": "prec_", "stress_swe": "swe_", "stress_of": "of2", "cap": "cap",
    "pr_limit": f"max(pr) FILTER (inw) {_W_EVENT} * 1.1", "tmp_low": f"least(-5, min(tmp) FILTER (inw) {_W_EVENT})", "tmp_high": f"max(tmp) FILTER (inw) {_W_EVENT} * 1.1", "q_limit": _limit_sql("q", 1.05), "gw_limit": "cap * 1.2",
    "sm_limit": _limit_sql("sm", 1.1), "swe_limit": _limit_sql("swe", 1.1), "of_limit": _limit_sql("of_", 1.1), "hyst_q_low": f"min(q) {_W_EVENT}", "hyst_q_high": f"max(q) {_W_EVENT}", "hyst_gw_limit": f"greatest(max(gw) {_W_EVENT}, cap * 1.2)",
}


@query(dt.sql("SELECT guid, strftime(event_ts, '%m%d%H') AS no, event_ts, ts, off_ AS \"offset\", off_ = 0 AS is_event, inw AS in_window, CASE WHEN off_ < 0 THEN 'before' WHEN off_ > 0 THEN 'after' ELSE 'event' END AS label, " + ", ".join(f'round(({x})::DOUBLE, 6) AS "{n}"' for n, x in _PANEL_COLUMNS.items()) + " FROM rows_", *_PANEL_VIEWS, recursive=True))
def event_panels(spark, sf_dir):
    """Rows of all panels of all events, in one plan."""
    return _rounded_row(panels.event_panels(*_stressed_events(spark, sf_dir), 1.0))


@query(dt.sql("SELECT x.guid, strftime(p.t0, '%m%d%H') AS no, p.t0 AS event_ts, x.ts, round(gw, 6) AS gw, round(total, 6) AS stress_total, round(cap, 6) AS cap, round(max(gw) OVER (PARTITION BY x.guid) * 1.1, 6) AS gw_limit, x.ts = p.t0 AS is_event FROM probes p JOIN num_ x ON x.guid = p.guid", *_PANEL_VIEWS[:-2], recursive=True))
def series_panel(spark, sf_dir):
    """Every event's whole series with its marker."""
    return _rounded_row(panels.series_panel(*_stressed_events(spark, sf_dir)))
