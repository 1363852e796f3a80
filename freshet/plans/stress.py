"""The stress index: five components between 0 and 1 per catchment and hour, and their total.

One plan covers all catchments.  Every window and every aggregate is partitioned by the
catchment, so the simulation is shuffled by it once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at_least, excess, over, step_count
from ..operators.asof import snapped
from ..operators.stats import capacity, fraction_of_max, median_dt_hours, quantile, robust_minmax, threshold
from ..operators.windows import ROW, exp_memory, lag_rate, numbered_rows, positive_drop, rolling_memory, rolling_sum


@dataclass(frozen=True)
class StressConfig:
    """Names and defaults of the model's settings."""

    hours_before: float = 48
    hours_after: float = 12
    post_hyst_hours: float = 72
    base_accum_mode: str = "exp"
    base_window_days: float = 14
    base_tau_days: float = 1.0
    grad_accum_mode: str = "exp"
    grad_window_days: float = 14
    grad_tau_days: float = 1.0
    forc_accum_mode: str = "exp"
    forc_window_days: float = 14
    forc_tau_days: float = 1.0
    use_capacity_fraction: bool = False
    capacity_frac: float = 0.90
    use_quantile_threshold: bool = True
    gw_q_threshold: float = 0.99
    sm_use_quantile_threshold: bool = True
    sm_q_threshold: float = 0.99
    of_use_quantile_threshold: bool = False
    of_q_threshold: float = 0.90
    of_use_zero_threshold: bool = True
    grad_threshold_mode: str = "quantile"
    pos_grad_q: float = 0.99
    neg_grad_q: float = 0.90
    pos_grad_frac_of_max: float = 0.70
    neg_grad_frac_of_max: float = 0.70
    prec_threshold_mode: str = "fraction_of_max"
    prec_frac_of_max: float = 0.70
    prec_q: float = 0.99
    swe_threshold_mode: str = "fraction_of_max"
    swe_frac_of_max: float = 0.70
    swe_q: float = 0.99
    include_gw_base: bool = True
    include_sm_base: bool = True
    include_of_base: bool = False
    gw_base_mult: float = 1.0
    sm_base_mult: float = 1.0
    of_base_mult: float = 1.0
    include_pos_grad: bool = True
    include_neg_grad: bool = False
    grad_hours: float = 6
    pos_grad_mult: float = 1.0
    neg_grad_mult: float = 1.0
    include_prec: bool = True
    prec_hours: float = 6
    prec_mult: float = 1.0
    include_swe: bool = True
    swe_hours: float = 6
    swe_mult: float = 1.0
    of_mult: float = 1.0
    split_prec_by_temp: bool = True
    temp_rain_threshold_c: float = 0.5
    use_only_rain: bool = True
    combine_mode: str = "sum"
    base_mult: float = 1.0
    grad_mult: float = 1.0
    final_combine_mode: str = "weighted_mean"
    final_combine_power: float = 2.0
    norm_q_low: float = 0.01
    norm_q_high: float = 0.99
    export_debug_intensities: bool = True
    export_debug_thresholds: bool = True


DEFAULT = StressConfig()
#: The published run.
RUN = replace(
    DEFAULT, base_tau_days=3.0, use_capacity_fraction=True, capacity_frac=0.5, use_quantile_threshold=False, gw_q_threshold=0.999,
    sm_use_quantile_threshold=False, sm_q_threshold=0.10, grad_threshold_mode="fraction_of_max", pos_grad_q=0.6, pos_grad_frac_of_max=0.15,
    prec_frac_of_max=0.2, prec_q=0.80, swe_frac_of_max=0.10, swe_q=0.90, include_of_base=True, final_combine_mode="weighted_sum_norm",
    norm_q_low=0.0, norm_q_high=1.0,
)

COMPONENTS = ("base", "grad", "prec", "swe", "of")


def _limit(x: Column, mode: str, q: float | None, fraction: float, key: str) -> Column:
    if mode == "fraction_of_max":
        return fraction_of_max(x, fraction, key)
    return F.lit(0.0) if q is None else quantile(x, q, key)


def rain(prec: Column, temp: Column, cfg: StressConfig) -> Column:
    """Precipitation that falls as rain; a missing temperature counts as frost."""
    p = F.coalesce(prec, F.lit(0.0))
    if cfg.split_prec_by_temp and cfg.use_only_rain:
        return F.when(temp >= cfg.temp_rain_threshold_c, p).otherwise(F.lit(0.0))
    return p


def with_excesses(sim: DataFrame, dt: float | Column, cfg: StressConfig, key: str = "guid", ts: str = "ts") -> DataFrame:
    """Thresholds and raw excesses of all components."""
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    gw, sm, of = F.col("gw"), F.col("sm"), F.col("of")
    out = sim.withColumn("cap", capacity("def", ts, key))
    if cfg.use_capacity_fraction and cfg.include_gw_base and cfg.include_sm_base:
        out = out.withColumn("_storage", F.coalesce(gw, zero) + F.coalesce(sm, zero))
        limit = threshold("_storage", cap=F.col("cap"), cap_fraction=cfg.capacity_frac, key=key)
        out = out.withColumns({"thr_gw": limit, "thr_sm": none, "thr_storage": limit})
        out = out.withColumns({"gw_excess": excess("_storage", "thr_gw"), "sm_excess": zero}).drop("_storage")
    else:
        cap_of = {"cap": F.col("cap"), "cap_fraction": cfg.capacity_frac} if cfg.use_capacity_fraction else {}
        out = out.withColumns({
            "thr_gw": threshold(gw, q=cfg.gw_q_threshold if cfg.use_quantile_threshold else None, key=key, **cap_of),
            "thr_sm": threshold(sm, q=cfg.sm_q_threshold if cfg.sm_use_quantile_threshold else None, key=key),
            "thr_storage": none,
        })
        out = out.withColumns({"gw_excess": excess(gw, "thr_gw") if cfg.include_gw_base else zero, "sm_excess": excess(sm, "thr_sm") if cfg.include_sm_base else zero})
    of_limit = zero if cfg.of_use_zero_threshold else threshold(of, q=cfg.of_q_threshold if cfg.of_use_quantile_threshold else None, key=key)
    out = out.withColumn("thr_of", of_limit)
    out = out.withColumn("of_excess", excess(of, "thr_of") if cfg.include_of_base else zero)
    steps = step_count(cfg.grad_hours, dt)
    hours = cfg.grad_hours if cfg.grad_hours > 0 else dt
    out = out.withColumns({f"{v}_rate": lag_rate(v, steps, hours, key, ts) for v in ("gw", "sm")})
    for v in ("gw", "sm"):
        for side, sign, on, q, fraction in (("pos", 1, cfg.include_pos_grad, cfg.pos_grad_q, cfg.pos_grad_frac_of_max), ("neg", -1, cfg.include_neg_grad, cfg.neg_grad_q, cfg.neg_grad_frac_of_max)):
            part = at_least(F.col(f"{v}_rate") * sign, 0.0)
            limit = _limit(part, cfg.grad_threshold_mode, q, fraction, key) if on else none
            out = out.withColumn(f"thr_{v}_{side}", limit)
            # Without any rate the signal is zero everywhere.
            out = out.withColumn(f"{v}_{side}", F.when(F.col(f"thr_{v}_{side}").isNull(), zero).otherwise(over(part, f"thr_{v}_{side}")) if on else zero)
    steps = step_count(cfg.prec_hours, dt)
    if cfg.include_prec:
        out = out.withColumn("_rain", rain(F.col("pr"), F.col("tmp"), cfg)).withColumn("prec_window", rolling_sum("_rain", steps, key, ts)).drop("_rain")
        out = out.withColumn("thr_prec", _limit(F.col("prec_window"), cfg.prec_threshold_mode, cfg.prec_q, cfg.prec_frac_of_max, key))
        out = out.withColumn("prec_excess", over("prec_window", "thr_prec"))
    else:
        out = out.withColumns({"prec_window": zero, "thr_prec": none, "prec_excess": zero})
    if cfg.include_swe:
        out = out.withColumn("melt_window", positive_drop("swe", step_count(cfg.swe_hours, dt), key, ts))
        out = out.withColumn("thr_swe", _limit(F.col("melt_window"), cfg.swe_threshold_mode, cfg.swe_q, cfg.swe_frac_of_max, key))
        out = out.withColumn("swe_excess", F.when(F.col("thr_swe").isNull(), zero).otherwise(over("melt_window", "thr_swe")))
    else:
        out = out.withColumns({"melt_window": zero, "thr_swe": none, "swe_excess": zero})
    return out


def with_norms(df: DataFrame, cfg: StressConfig, key: str = "guid") -> DataFrame:
    """Instant excesses scaled to 0..1 and combined to the components' inputs."""
    grad = F.lit(float(cfg.pos_grad_mult)) * (F.col("gw_pos") + F.col("sm_pos")) + F.lit(float(cfg.neg_grad_mult)) * (F.col("gw_neg") + F.col("sm_neg"))
    out = df.withColumn("_grad", grad)
    norm = lambda c: robust_minmax(c, cfg.norm_q_low, cfg.norm_q_high, key)
    out = out.withColumns({"gw_norm": norm("gw_excess"), "sm_norm": norm("sm_excess"), "grad_norm": norm("_grad"), "prec_norm": norm("prec_excess"), "swe_norm": norm("swe_excess"), "of_norm": norm("of_excess")})
    base = F.lit(float(cfg.gw_base_mult)) * F.col("gw_norm") + F.lit(float(cfg.sm_base_mult)) * F.col("sm_norm")
    if cfg.combine_mode.lower() == "avg":
        base = base / float(max(int(cfg.include_gw_base) + int(cfg.include_sm_base), 1))
    return out.withColumns({"base_inst": base, "grad_inst": F.col("grad_norm"), "prec_inst": F.col("prec_norm"), "swe_inst": F.col("swe_norm"), "of_inst": F.lit(float(cfg.of_base_mult)) * F.col("of_norm")}).drop("_grad")


def with_memory(df: DataFrame, dt: float | Column, cfg: StressConfig, key: str = "guid", ts: str = "ts") -> DataFrame:
    groups = {"base": (cfg.base_accum_mode, cfg.base_window_days, cfg.base_tau_days), "grad": (cfg.grad_accum_mode, cfg.grad_window_days, cfg.grad_tau_days)}
    groups |= {c: (cfg.forc_accum_mode, cfg.forc_window_days, cfg.forc_tau_days) for c in ("prec", "swe", "of")}
    exp = {}
    for c, (mode, window, tau) in groups.items():
        if mode == "rolling":
            df = df.withColumn(f"{c}_mem", rolling_memory(f"{c}_inst", step_count(window * 24.0, dt), dt, key, ts))
        elif mode == "exp":
            exp[f"{c}_mem"] = (f"{c}_inst", tau)
        else:
            raise ValueError(f"unknown memory mode {mode!r}")
    return exp_memory(df, exp, dt, key, ts) if exp else df


def weights(cfg: StressConfig) -> dict[str, float]:
    on = {"base": cfg.include_gw_base or cfg.include_sm_base, "grad": cfg.include_pos_grad or cfg.include_neg_grad, "prec": cfg.include_prec, "swe": cfg.include_swe, "of": cfg.include_of_base}
    mult = {"base": cfg.base_mult, "grad": cfg.grad_mult, "prec": cfg.prec_mult, "swe": cfg.swe_mult, "of": cfg.of_mult}
    return {c: float(mult[c]) if on[c] else 0.0 for c in COMPONENTS}


def with_total(df: DataFrame, cfg: StressConfig, key: str = "guid") -> DataFrame:
    """Component stresses, their weighted sum and the total."""
    if cfg.final_combine_mode not in ("weighted_mean", "weighted_sum_norm", "weighted_sum_power_norm"):
        raise ValueError(f"unknown final combination {cfg.final_combine_mode!r}")
    w = weights(cfg)
    on = {"base": cfg.include_gw_base or cfg.include_sm_base, "grad": cfg.include_pos_grad or cfg.include_neg_grad, "prec": cfg.include_prec, "swe": cfg.include_swe, "of": cfg.include_of_base}
    out = df.withColumns({f"stress_{c}": F.coalesce(robust_minmax(f"{c}_mem", cfg.norm_q_low, cfg.norm_q_high, key), F.lit(0.0)) if on[c] else F.lit(0.0) for c in COMPONENTS})
    mode, raw = cfg.final_combine_mode, F.lit(0.0)
    power = cfg.final_combine_power if cfg.final_combine_power and cfg.final_combine_power > 0 else 2.0
    for c in COMPONENTS:
        s = F.col(f"stress_{c}")
        raw = raw + F.lit(w[c]) * (F.pow(s, F.lit(float(power))) if mode == "weighted_sum_power_norm" else s)
    total_weight = sum(w.values())
    if mode == "weighted_mean" and total_weight <= 0:
        return out.withColumns({"stress_raw": F.lit(0.0), "stress_total": F.lit(0.0)})
    out = out.withColumn("stress_raw", raw)
    if mode == "weighted_mean":
        return out.withColumn("stress_total", F.col("stress_raw") / total_weight)
    return out.withColumn("stress_total", F.coalesce(robust_minmax("stress_raw", cfg.norm_q_low, cfg.norm_q_high, key), F.lit(0.0)))


def stress(sim: DataFrame, cfg: StressConfig = RUN, dt_hours: float | None = None, key: str = "guid", ts: str = "ts") -> DataFrame:
    """Stress of all catchments; once per catchment, whatever its number of events.

    Steps are rows, so they depend on a catchment's median interval.  Without ``dt_hours`` that
    interval is a column, and catchments of all resolutions go through one plan.
    """
    rows, dt = sim.filter(F.col(ts).isNotNull()), dt_hours
    if dt_hours is None:
        rows = numbered_rows(rows.join(median_dt_hours(rows, key, ts).withColumnRenamed("dt_hours", "_dt"), key), key, ts)
        dt = F.col("_dt")
    return with_total(with_memory(with_norms(with_excesses(rows, dt, cfg, key, ts), cfg, key), dt, cfg, key, ts), cfg, key).drop("_dt", ROW)


#: Output names of the export, in order: core, intensities, thresholds.
CORE = {
    "Datetime": "ts", "is_event_time": "is_event_time", "event_time": "event_ts", "GUID": "guid", "No": "no", "SkredID": "skred_id",
    "GW_mm": "gw", "SM_mm": "sm", "OF_m3s": "of", "SWE_mm": "swe", "Prec_mm": "pr", "Temp_C": "tmp", "Q_m3s": "q", "GW_def_mm": "def",
    "stress_total": "stress_total", "stress_total_raw_pre_final_norm": "stress_raw", "stress_base": "stress_base", "stress_grad": "stress_grad",
    "stress_prec": "stress_prec", "stress_swe": "stress_swe", "stress_of": "stress_of", "gw_norm": "gw_norm", "sm_norm": "sm_norm",
    "grad_norm": "grad_norm", "prec_norm": "prec_norm", "swe_norm": "swe_norm", "of_norm": "of_norm", "base_mem": "base_mem",
    "grad_mem": "grad_mem", "prec_mem": "prec_mem", "swe_mem": "swe_mem", "of_mem": "of_mem",
}
INTENSITIES = {
    "prec_window_mm": "prec_window", "swe_melt_window_mm": "melt_window", "GW_dXdt_unitsday": "gw_rate", "SM_dXdt_unitsday": "sm_rate",
    "GW_pos_excess": "gw_pos", "GW_neg_excess": "gw_neg", "SM_pos_excess": "sm_pos", "SM_neg_excess": "sm_neg",
    "prec_excess_mm": "prec_excess", "swe_excess_mm": "swe_excess", "of_excess": "of_excess",
}
THRESHOLDS = {
    "thr_GW_base": "thr_gw", "thr_SM_base": "thr_sm", "thr_BASE_storage": "thr_storage", "thr_OF": "thr_of", "thr_prec_window": "thr_prec",
    "thr_swe_window": "thr_swe", "thr_GW_posgrad": "thr_gw_pos", "thr_GW_neggrad": "thr_gw_neg", "thr_SM_posgrad": "thr_sm_pos", "thr_SM_neggrad": "thr_sm_neg",
}


def event_tables(stressed: DataFrame, events: DataFrame, cfg: StressConfig = RUN, key: str = "guid", ts: str = "ts") -> DataFrame:
    """The export: each event's whole series with its snapped time marked.

    The snap takes the event's hour if the series has it, else the nearest row (of two the earlier).
    """
    e = events.filter("event_time is not null").select(key, "no", "skred_id", F.date_trunc("HOUR", "event_time").alias("_e"))
    snap = snapped(e.distinct(), stressed.select(key, ts), [key], "_e", ts, "event_ts", by_hour=False)
    out = stressed.join(snap, key).withColumn("is_event_time", F.col(ts) == F.col("event_ts"))
    names = CORE | (INTENSITIES if cfg.export_debug_intensities else {}) | (THRESHOLDS if cfg.export_debug_thresholds else {})
    return out.select(*[F.col(v).alias(k) for k, v in names.items()])
