"""Episode features: one wide row that describes the state around an anchor time.

Features are made in long form, (guid, t0, name, value), for all catchments, variables and lags
at once, and pivoted at the end with an explicit list of names; derived ratios follow from the
wide row.  The registry of names is also the feature dictionary.

Which families of features a variable has is a setting (``var_features``).  Each family names what
it is made of (INPUTS), and a plan has only the inputs that some family of some variable, or a
feature that is always there, asks for, and these for no other variables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch, ratio
from ..operators.asof import lag_rates, nearest, regular_sum
from ..operators.peaks import first_crossing, hours_over, max_before, nearest_peak, steepest_by_span
from ..operators.stats import rank_in
from ..sources.sinks import settled

LAGS = (3, 6, 12, 24, 48, 72)
VARIABLES = ("gw", "q", "qmm", "sm", "of", "pr", "tmp", "swe")
#: The air temperature has neither rates nor peaks.
ACTIVE = tuple(v for v in VARIABLES if v != "tmp")
RATIO_PAIRS = ((3, 24), (6, 24), (12, 24), (24, 72))
KEY, VAR = ["guid"], ["guid", "var"]
#: Names of the families of features of a variable, and the families of the published runs.
FAMILIES = ("anchor", "quantile", "pctcap", "pctmax", "rates_before", "peak_pre")
VAR_FEATURES = {v: {f: (f != "pctcap" or v == "gw") and (f not in ("rates_before", "peak_pre") or v != "tmp") for f in FAMILIES} for v in VARIABLES}
#: Decimals in which slopes of the older row that tie agree: differences of decimal values are equal up to the last bits of a double only.
SLOPE_DIGITS = 9
LEGACY_FAMILIES = ("anchor", "quantile", "pctcap", "rates", "max")
LEGACY_VARIABLES = tuple(v for v in VARIABLES if v != "qmm")
LEGACY_FEATURES = {v: {f: (f != "pctcap" or v == "gw") and (f not in ("rates", "max") or v != "tmp") for f in LEGACY_FAMILIES} for v in LEGACY_VARIABLES}
#: What each family is made of.
INPUTS = {"anchor": ("value",), "quantile": ("value", "rank"), "pctcap": ("value", "top"), "pctmax": ("value", "top"), "rates_before": ("value", "rates"), "peak_pre": ("peak",), "rates": ("value", "both_rates"), "max": ("slopes",)}


def inputs_of(features: dict[str, dict[str, bool]], always: dict[str, tuple[str, ...]] | None = None) -> dict[str, list[str]]:
    """Variables that need each input, for the families that are on; ``always`` has those of features that no setting switches."""
    need: dict[str, set[str]] = {}
    for v, families in features.items():
        for f, on in families.items():
            if f not in INPUTS:
                raise ValueError(f"unknown feature family {f!r}")
            for i in INPUTS[f] if on else ():
                need.setdefault(i, set()).add(v)
    for i, variables in (always or {}).items():
        need.setdefault(i, set()).update(variables)
    return {i: [v for v in VARIABLES if v in variables] for i, variables in need.items()}


def _long(df: DataFrame, **values) -> DataFrame:
    """(guid, t0, name, value) from named columns; a name is a column expression."""
    pairs = F.array(*[F.struct(n.alias("name"), v.cast("double").alias("value")) for n, v in values.values()])
    return df.select("guid", "t0", F.explode(pairs).alias("_p")).select("guid", "t0", "_p.name", "_p.value")


def _name(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def rates(series: DataFrame, lags: tuple[int, ...], tolerance_s: float) -> DataFrame:
    """(guid, var, H, ts, r): change per hour against the value nearest to H hours before, for every row."""
    wide = lag_rates(series, lags, tolerance_s, VAR)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("H"), F.col(f"r{h}").alias("r")) for h in lags]))
    return wide.select("guid", "var", "ts", each.alias("_e")).select("guid", "var", F.col("_e.H").alias("H"), "ts", F.col("_e.r").alias("r")).filter("r is not null")


def sums(series: DataFrame, lags: tuple[int, ...], tolerance_s: float) -> DataFrame:
    """(guid, var, H, ts, s): full sums of the last H hours on the hourly grid, of pr and qmm."""
    base = regular_sum(series.filter(F.col("var").isin("pr", "qmm")), 1, tolerance_s, VAR)
    w = lambda h: Window.partitionBy("guid", "var").orderBy("ts").rowsBetween(1 - h, 0)
    wide = base.select("guid", "var", "ts", F.array(*[F.struct(F.lit(h).alias("H"), F.when(F.count("s").over(w(h)) == h, F.sum("s").over(w(h))).alias("s")) for h in lags]).alias("_a"))
    return wide.select("guid", "var", "ts", F.explode("_a").alias("_e")).select("guid", "var", F.col("_e.H").alias("H"), "ts", F.col("_e.s").alias("s")).filter("s is not null")


def _each(anchors: DataFrame, variables) -> DataFrame:
    return anchors.select("guid", "t0", F.explode(F.array(*map(F.lit, variables))).alias("var"))


def anchor_features(anchors: DataFrame, series: DataFrame, tolerance_s: float, variables=VARIABLES, ranked=VARIABLES, topped=VARIABLES) -> DataFrame:
    """Values at the anchor, and for the variables that ask for them their ranks and the greatest values."""
    out = nearest(_each(anchors, variables), series, tolerance_s, VAR, "t0", "ts", "x", "x0")
    if ranked:
        some = F.col("var").isin(*ranked)
        out = rank_in(series.filter(some), out.withColumn("_x", F.when(some, F.col("x0"))), VAR, "x", "_x").drop("_x")
    if topped:
        out = out.join(series.filter(F.col("var").isin(*topped)).groupBy(*VAR).agg(F.max("x").alias("top")), VAR, "left")
    return out


def peak_features(anchors: DataFrame, series: DataFrame, before_h: int, after_h: int, variables=ACTIVE) -> DataFrame:
    return rank_in(series, nearest_peak(_each(anchors, variables), series, before_h, after_h, VAR), VAR, "x", "pk_0")


def rate_features(anchors: DataFrame, series: DataFrame, rate_rows: DataFrame, lags: tuple[int, ...], tolerance_s: float, variables=ACTIVE) -> DataFrame:
    """(guid, t0, var, H, x0, xb, r, rank_all, rank_pos, rank_neg, abs_top)."""
    out = _shifted_values(anchors, series, tuple(-h for h in lags), tolerance_s, variables).withColumn("H", -F.col("shift"))
    out = out.select("guid", "t0", "var", "H", "x0", F.col("xs").alias("xb")).withColumn("r", (F.col("x0") - F.col("xb")) / F.col("H"))
    key = [*VAR, "H"]
    for name, sign in (("rank_all", 0), ("rank_pos", 1), ("rank_neg", -1)):
        out = rank_in(rate_rows, out, key, "r", "r", sign).withColumnRenamed("rank", name)
    return out.join(rate_rows.groupBy(*key).agg(F.max(F.abs("r")).alias("abs_top")), key, "left")


def _shifted_values(anchors: DataFrame, series: DataFrame, shifts: tuple[int, ...], tolerance_s: float, variables) -> DataFrame:
    """(guid, t0, var, shift, x0, xs): values at the anchor and some hours from it, of one pass over the series."""
    spread = _each(anchors, variables).withColumn("shift", F.explode(F.array(*map(F.lit, (0, *shifts))))).withColumn("_at", F.timestamp_micros(F.unix_micros("t0") + F.col("shift").cast("long") * 3_600_000_000))
    found = nearest(spread, series, tolerance_s, VAR, "_at", "ts", "x", "xs").drop("_at")
    x0 = F.max(F.when(F.col("shift") == 0, F.col("xs"))).over(Window.partitionBy("guid", "var", "t0"))
    return found.withColumn("x0", x0).filter("shift != 0").select("guid", "t0", "var", "shift", "x0", "xs")


def sum_features(anchors: DataFrame, sum_rows: DataFrame, lags: tuple[int, ...], before_h: int, tolerance_s: float) -> DataFrame:
    key = [*VAR, "H"]
    at = _each(anchors, ("pr", "qmm")).withColumn("H", F.explode(F.array(*map(F.lit, lags))))
    out = rank_in(sum_rows, nearest(at, sum_rows, tolerance_s, key, "t0", "ts", "s", "S"), key, "s", "S")
    top = sum_rows.groupBy(*key).agg(F.max("s").alias("top"))
    rain = F.col("var") == "pr"
    most = max_before(at.filter(rain), sum_rows.filter(rain), before_h, F.col("H"), key).select("guid", "t0", "var", "H", "max_sum")
    return out.join(top, key, "left").join(most, ["guid", "t0", "var", "H"], "left")


def feature_names(lags: tuple[int, ...] = LAGS, features: dict[str, dict[str, bool]] | None = None) -> list[tuple[str, str]]:
    """Names and descriptions of the long features, in the order of the wide row."""
    rows = []
    for v in VARIABLES:
        on = (features or VAR_FEATURES).get(v, {})
        if on.get("anchor"):
            rows.append((f"{v}0", f"{v} at the anchor"))
        if on.get("quantile"):
            rows.append((f"{v}q", f"rank of {v}0 in its series"))
        if on.get("pctmax"):
            rows.append((f"{v}pmx", f"{v}0 in percent of its maximum"))
        if on.get("pctcap"):
            rows += [(f"{v}p", f"{v}0 in percent of the capacity"), (f"{v}mxcap", f"greatest {v} in percent of the capacity")]
        if on.get("peak_pre"):
            rows += [(f"{v}pk_t", f"hours from the nearest peak of {v} to the anchor"), (f"{v}pk_0", f"value of that peak of {v}"), (f"{v}pk_q", f"rank of that peak of {v}")]
        if on.get("rates_before"):
            for h in lags:
                rows += [(f"{v}r{h}b", f"change of {v} per hour over {h} hours before"), (f"{v}rq{h}b", f"rank of {v}r{h}b"), (f"{v}rqp{h}b", f"rank of {v}r{h}b among rises"), (f"{v}rqn{h}b", f"rank of {v}r{h}b among falls"), (f"{v}rpmx{h}b", f"{v}r{h}b in percent of the greatest change")]
    for h in lags:
        for v in ("pr", "qmm"):
            rows += [(f"{v}S{h}b", f"sum of {v} over {h} hours before"), (f"{v}Sq{h}b", f"rank of {v}S{h}b"), (f"{v}Spmx{h}b", f"{v}S{h}b in percent of its maximum")]
        rows += [(f"prmr{h}b", f"greatest {h}-hour sum of pr in the window before"), (f"prmrpmx{h}b", f"prmr{h}b in percent of the maximum")]
        rows += [(f"sweLossS{h}b", f"loss of swe over {h} hours before"), (f"sweLossSq{h}b", f"rank of sweLossS{h}b"), (f"sweLossSpmx{h}b", f"sweLossS{h}b in percent of the maximum")]
        for v in ("gw", "pr", "qmm"):
            rows += [(f"hours_{v}_high_q90_{h}b", f"hours of {v} over its 0.9 quantile in {h} hours before"), (f"{v}_excess_q90_sum_{h}b", f"summed excess of {v} over its 0.9 quantile in {h} hours before")]
    rows += [("hxl_pre", "hours from the first crossing of q to that of gw"), ("hxl_pre_gwt", "hours from the first crossing of gw to the anchor"), ("hxl_pre_qt", "hours from the first crossing of q to the anchor"), ("hxl_pre_gwthr", "threshold of gw"), ("hxl_pre_qthr", "threshold of q")]
    rows += [("_total_top", "greatest total storage"), ("_total_mean", "mean total storage"), ("_total_sd", "standard deviation of total storage"), ("_total_n", "values of total storage")]
    return rows


def derived(lags: tuple[int, ...], before_h: int, c=F.col, rated=ACTIVE) -> dict[str, Column]:
    """Derived features from the wide row; ``c`` gives a column of it, or a missing value for one that it lacks."""
    out: dict[str, Column] = {}
    top_lag = max([h for h in lags if h <= before_h], default=None)
    if top_lag is not None:
        for v in rated:
            out |= {f"{v}x{h}": c(f"{v}r{h}b") - c(f"{v}r{top_lag}b") for h in lags}
    for h in lags:
        out[f"netS{h}b"] = c(f"prS{h}b") - c(f"qmmS{h}b")
    total = c("gw0") + c("sm0")
    out |= {"total_storage": total, "storage_fraction": ratio(total, c("cap")), "relative_storage": ratio(total, c("_total_top"))}
    out["storage_anomaly"] = F.when((c("_total_n") >= 2) & (c("_total_sd") != 0), (total - c("_total_mean")) / c("_total_sd"))
    for v in ("gw", "q", "qmm", "sm", "swe"):
        delay = c(f"{v}pk_t") - c("prpk_t")
        out |= {f"{v}_delay_vs_pr": delay, f"{v}_abs_delay_vs_pr": F.abs(delay)}
    for v in ACTIVE:
        t = c(f"{v}pk_t")
        out |= {f"{v}_peak_before_flag": (t > 0).cast("int"), f"{v}_peak_after_flag": (t < 0).cast("int"), f"{v}_distance_to_peak": F.abs(t)}
    for h in lags:
        pr, qmm, loss, net = c(f"prS{h}b"), c(f"qmmS{h}b"), c(f"sweLossS{h}b"), c(f"prS{h}b") - c(f"qmmS{h}b")
        out |= {
            f"runoff_ratio_{h}b": ratio(qmm, pr), f"infiltration_proxy_{h}b": 1.0 - ratio(qmm, pr), f"rain_plus_melt_{h}b": pr + loss,
            f"response_efficiency_{h}b": ratio(qmm, pr + loss), f"melt_fraction_{h}b": ratio(loss, pr + loss), f"rain_fraction_{h}b": ratio(pr, pr + loss),
            f"precip_x_gw_{h}b": pr * c("gw0"), f"precip_x_sm_{h}b": pr * c("sm0"), f"netS_x_gw_{h}b": net * c("gw0"),
            f"gwr_norm_{h}b": ratio(c(f"gwr{h}b"), c("gw0")), f"smr_norm_{h}b": ratio(c(f"smr{h}b"), c("sm0")),
            f"qmmr_norm_{h}b": ratio(c(f"qmmr{h}b"), c("qmm0")), f"qr_norm_{h}b": ratio(c(f"qr{h}b"), c("q0")),
        }
        for v in ("gw", "q", "qmm", "sm"):
            r, t = c(f"{v}r{h}b"), c(f"{v}pk_t")
            out |= {f"{v}r{h}b_x_peak_before": r * (t > 0).cast("int"), f"{v}r{h}b_x_peak_after": r * (t < 0).cast("int")}
        out |= {f"netS_ratio_{h}b": ratio(net, pr), f"netS_norm_storage_{h}b": ratio(net, total), f"netS_gradient_{h}b": net / float(h)}
    for a, b in RATIO_PAIRS:
        if a in lags and b in lags:
            net = lambda h: c(f"prS{h}b") - c(f"qmmS{h}b")
            out |= {
                f"pr_ratio_{a}_{b}b": ratio(c(f"prS{a}b"), c(f"prS{b}b")), f"netS_ratio_{a}_{b}b": ratio(net(a), net(b)),
                f"gw_rate_ratio_{a}_{b}b": ratio(c(f"gwr{a}b"), c(f"gwr{b}b")), f"sm_rate_ratio_{a}_{b}b": ratio(c(f"smr{a}b"), c(f"smr{b}b")),
                f"qmm_rate_ratio_{a}_{b}b": ratio(c(f"qmmr{a}b"), c(f"qmmr{b}b")),
            }
    return out


def _with_signal(series: DataFrame, gw_def: str, gw_sm_weight: float) -> DataFrame:
    """The long series with the groundwater signal in place of gw."""
    if gw_def not in ("gw", "gw_plus_sm"):
        raise ValueError(f"unknown groundwater signal {gw_def!r}")
    if gw_def == "gw":
        return series
    own = lambda v: series.filter(F.col("var") == v).select("guid", "ts", F.col("x").alias(f"_{v}"))
    both = own("gw").join(own("sm"), ["guid", "ts"]).select("guid", F.lit("gw").alias("var"), "ts", (F.col("_gw") + F.lit(float(gw_sm_weight)) * F.col("_sm")).alias("x"))
    return series.filter("var != 'gw'").select("guid", "var", "ts", "x").unionByName(both)


def _crossings(at: DataFrame, series: DataFrame, before_h: int, gw_act_q: float, q_act_q: float) -> DataFrame:
    """Long features of the first crossings of gw and q."""
    v = F.col("var")
    limits = series.filter(v.isin("gw", "q")).groupBy("guid").agg(F.percentile(F.when(v == "gw", F.col("x")), F.lit(gw_act_q)).alias("_gwthr"), F.percentile(F.when(v == "q", F.col("x")), F.lit(q_act_q)).alias("_qthr")).filter("_gwthr is not null and _qthr is not null")
    c = at.join(limits, "guid")
    probes = c.select("guid", "t0", F.explode(F.array(*[F.struct(F.lit(x).alias("var"), F.col(f"_{x}thr").alias("thr")) for x in ("gw", "q")])).alias("_p")).select("guid", "t0", "_p.*")
    hits = first_crossing(probes, series.filter(v.isin("gw", "q")), before_h, VAR).groupBy("guid", "t0").agg(*[F.max(F.when(v == x, F.col("cross"))).alias(f"_{x}t") for x in ("gw", "q")])
    c = c.join(hits, ["guid", "t0"], "left")
    gap = lambda x, y: (epoch(x) - epoch(y)) / 3600
    return _long(c, a=(F.lit("hxl_pre"), gap("_gwt", "_qt")), b=(F.lit("hxl_pre_gwt"), gap("t0", "_gwt")), c=(F.lit("hxl_pre_qt"), gap("t0", "_qt")), d=(F.lit("hxl_pre_gwthr"), F.col("_gwthr")), e=(F.lit("hxl_pre_qthr"), F.col("_qthr")))


def _of_cap(x: str) -> Column:
    return F.when(F.col("cap") > 0, ratio(x, "cap") * 100)


def _meta(anchors: DataFrame, params: DataFrame) -> DataFrame:
    return anchors.select("guid", "t0", "y").join(params.select("guid", "cap", F.col("area_km2").alias("A_km2"), "HI", "MRT", "meandailyT"), "guid", "left")


def _labels(lags, before_h: int, after_h: int, gw_def: str, gw_act_q: float, q_act_q: float) -> dict[str, Column]:
    text = {"wb": F.lit(before_h), "wa": F.lit(after_h), "lags": F.lit(",".join(map(str, lags))), "gwdef": F.lit(gw_def), "gwsig": F.lit("gw" if gw_def == "gw" else "gw_plus_sm"), "qmm_sig": F.lit("q*3.6/area_km2"), "gw_act_q": F.lit(float(gw_act_q)), "q_act_q": F.lit(float(q_act_q))}
    return {k: x.alias(k) for k, x in text.items()}


def episodes(anchors: DataFrame, series: DataFrame, params: DataFrame, *, lags: tuple[int, ...] = LAGS, before_h: int = 72, after_h: int = 72, tolerance_s: float = 1800, gw_act_q: float = 0.99, q_act_q: float = 0.99, gw_def: str = "gw", gw_sm_weight: float = 1.0, var_features: dict[str, dict[str, bool]] | None = None) -> DataFrame:
    """Wide rows for anchors (guid, t0, y) from the long series of VARIABLES.

    ``params`` has one row per catchment: guid, cap, area_km2, HI, MRT, meandailyT.  With ``gw_def``
    "gw_plus_sm" the groundwater signal is gw plus weighted sm, where both are there.  Families that
    ``var_features`` switches off have no columns, and what only they are made of is not computed;
    derived features of what is missing are missing.
    """
    lags = tuple(sorted(set(lags)))
    features = var_features or VAR_FEATURES
    need = inputs_of(features, {"rates": ("swe",), "value": ("swe",)})
    on = lambda f: [v for v in VARIABLES if features.get(v, {}).get(f)]
    v, h = F.col("var"), F.col("H").cast("string")
    # Used by many features each: written once, so that the plans of the features stay small.
    at, series = settled(anchors.select("guid", "t0").distinct(), "anchors"), settled(_with_signal(series, gw_def, gw_sm_weight), "series")
    rate_rows = settled(rates(series.filter(v.isin(*need["rates"])), lags, tolerance_s), "rates")
    sum_rows = settled(sums(series, lags, tolerance_s), "sums")

    parts = []
    valued = sorted({x for f in ("anchor", "quantile", "pctcap", "pctmax") for x in on(f)})
    if valued:
        ranked, topped = need.get("rank", []), need.get("top", [])
        a = anchor_features(at, series, tolerance_s, valued, ranked, topped)
        asked = lambda f, x: F.when(v.isin(*on(f)), x) if on(f) else None
        columns = {"x": (_name(v, "0"), asked("anchor", F.col("x0")))}
        if ranked:
            columns["q"] = (_name(v, "q"), asked("quantile", F.col("rank")))
        if topped:
            columns["m"] = (_name(v, "pmx"), asked("pctmax", ratio("x0", "top") * 100))
        parts.append(_long(a, **{k: x for k, x in columns.items() if x[1] is not None}))
        if on("pctcap"):
            g = a.filter(v.isin(*on("pctcap"))).join(params.select("guid", "cap"), "guid", "left")
            parts.append(_long(g, p=(_name(v, "p"), _of_cap("x0")), m=(_name(v, "mxcap"), _of_cap("top"))))
    if need.get("peak"):
        p = peak_features(at, series, before_h, after_h, need["peak"])
        parts.append(_long(p, t=(_name(v, "pk_t"), F.col("pk_t")), x=(_name(v, "pk_0"), F.col("pk_0")), q=(_name(v, "pk_q"), F.col("rank"))))
    r = settled(rate_features(at, series, rate_rows, lags, tolerance_s, need["rates"]), "rate-features")
    if on("rates_before"):
        parts.append(_long(r.filter(v.isin(*on("rates_before"))), r=(_name(v, "r", h, "b"), F.col("r")), q=(_name(v, "rq", h, "b"), F.col("rank_all")), p=(_name(v, "rqp", h, "b"), F.col("rank_pos")), n=(_name(v, "rqn", h, "b"), F.col("rank_neg")), m=(_name(v, "rpmx", h, "b"), ratio("r", "abs_top") * 100)))
    s = settled(sum_features(at, sum_rows, lags, before_h, tolerance_s), "sum-features")
    parts.append(_long(s, s=(_name(v, "S", h, "b"), F.col("S")), q=(_name(v, "Sq", h, "b"), F.col("rank")), m=(_name(v, "Spmx", h, "b"), ratio("S", "top") * 100)))
    parts.append(_long(s.filter("var = 'pr'"), x=(_name("prmr", h, "b"), F.col("max_sum")), m=(_name("prmrpmx", h, "b"), ratio("max_sum", "top") * 100)))
    nonneg = lambda x: F.when(x < 0, F.lit(0.0)).otherwise(x)
    losses = rate_rows.filter("var = 'swe'").select("guid", "var", "H", nonneg(-F.col("r") * F.col("H")).alias("loss"))
    w = rank_in(losses, r.filter("var = 'swe'").select("guid", "t0", "var", "H", nonneg(F.col("xb") - F.col("x0")).alias("loss")), [*VAR, "H"], "loss", "loss").join(losses.groupBy("guid", "H").agg(F.max("loss").alias("top")), ["guid", "H"], "left")
    parts.append(_long(w, s=(_name("sweLossS", h, "b"), F.col("loss")), q=(_name("sweLossSq", h, "b"), F.col("rank")), m=(_name("sweLossSpmx", h, "b"), ratio("loss", "top") * 100)))
    q90 = series.filter(v.isin("gw", "pr", "qmm")).groupBy(*VAR).agg(F.percentile("x", F.lit(0.9)).alias("thr"))
    over_at = at.join(q90, "guid").withColumn("H", F.explode(F.array(*map(F.lit, lags))))
    o = hours_over(over_at, series, F.col("H"), VAR, more=("H",), most_hours=max(lags))
    parts.append(_long(o, c=(_name("hours_", v, "_high_q90_", h, "b"), F.col("hours_high")), e=(_name(v, "_excess_q90_sum_", h, "b"), F.col("excess_sum"))))
    parts.append(_crossings(at, series, before_h, gw_act_q, q_act_q))
    total = series.filter(v.isin("gw", "sm")).groupBy("guid", "ts").agg(F.sum("x").alias("x"), F.count("x").alias("n")).filter("n = 2").groupBy("guid").agg(F.max("x").alias("top"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    parts.append(_long(at.join(total, "guid"), a=(F.lit("_total_top"), F.col("top")), b=(F.lit("_total_mean"), F.col("mean")), c=(F.lit("_total_sd"), F.col("sd")), d=(F.lit("_total_n"), F.col("n"))))

    names = [n for n, _ in feature_names(lags, features)]
    wide = reduce(DataFrame.unionByName, parts).groupBy("guid", "t0").pivot("name", names).agg(F.first("value", ignorenulls=True))
    rows = _meta(anchors, params).join(wide, ["guid", "t0"], "left")
    labels = _labels(lags, before_h, after_h, gw_def, gw_act_q, q_act_q)
    have = {*names, "cap"}
    more = derived(lags, before_h, lambda n: F.col(n) if n in have else F.lit(None).cast("double"), on("rates_before"))
    plain = [F.col(n) for n in names if not n.startswith("_")]
    return rows.select(F.col("guid").alias("GUID"), "t0", "y", *[labels[k] for k in ("wb", "wa", "lags")], "cap", *[labels[k] for k in ("gwdef", "gwsig", "qmm_sig")], "A_km2", "HI", "MRT", "meandailyT", *[labels[k] for k in ("gw_act_q", "q_act_q")], *plain, *[e.alias(k) for k, e in more.items()])


def legacy_names(lags: tuple[int, ...] = LAGS, before_h: int = 72, after_h: int = 72, features: dict[str, dict[str, bool]] | None = None) -> list[tuple[str, str]]:
    """Names and descriptions of the older row's features, in order."""
    rows, top_lag = [], max([h for h in lags if h <= before_h], default=None)
    for v in LEGACY_VARIABLES:
        on = (features or LEGACY_FEATURES).get(v, {})
        if on.get("anchor"):
            rows.append((f"{v}0", f"{v} at the anchor"))
        if on.get("quantile"):
            rows.append((f"{v}q", f"rank of {v}0 in its series"))
        if on.get("pctcap"):
            rows.append((f"{v}p", f"{v}0 in percent of the capacity"))
        if on.get("rates"):
            for h in lags:
                rows += [(f"{v}r{h}b", f"change of {v} per hour over {h} hours before"), (f"{v}r{h}a", f"change of {v} per hour over {h} hours after")]
            rows += [(f"{v}x{h}", f"{v}r{h}b less {v}r{top_lag}b") for h in lags] if top_lag is not None else []
        for side, hours, where in (("b", before_h, "before"), ("a", after_h, "after")) if on.get("max") else ():
            for h in [h for h in lags if h <= hours]:
                for letter, what in (("m", "rise"), ("n", "fall")):
                    n = f"{v}{letter}{h}{side}"
                    rows += [(n, f"steepest {what} of {v} within {h} hours in the window {where}"), (f"{n}_t", f"hours between its end and the anchor"), (f"{n}_0", f"{v} at its end"), (f"{n}_q", f"rank of {n}_0 in the window")]
    return rows + [("hxl_pre", "hours from the first crossing of q to that of gw"), ("hxl_pre_gwt", "hours from the first crossing of gw to the anchor"), ("hxl_pre_qt", "hours from the first crossing of q to the anchor"), ("hxl_pre_gwthr", "threshold of gw"), ("hxl_pre_qthr", "threshold of q")]


def legacy_features(anchors: DataFrame, series: DataFrame, params: DataFrame | None = None, *, lags: tuple[int, ...] = LAGS, before_h: int = 72, after_h: int = 72, tolerance_s: float = 5400, gw_act_q: float = 0.90, q_act_q: float = 0.90, var_features: dict[str, dict[str, bool]] | None = None) -> DataFrame:
    """(guid, t0, name, value): the older variant's features; rates on both sides of the anchor, and the steepest rises and falls of both windows.

    All lags are read off one pass over a window, and values at all distances from the anchor are
    found in one.  Times of slopes' ends are hours from the anchor on either side of it.  Shares of
    the capacity need ``params``.
    """
    lags = tuple(sorted(set(lags)))
    features = var_features or LEGACY_FEATURES
    need = inputs_of(features)
    on = lambda f: [v for v in LEGACY_VARIABLES if features.get(v, {}).get(f)]
    at, series = settled(anchors.select("guid", "t0").distinct(), "anchors"), settled(series.filter(F.col("var") != "qmm"), "series")
    v, h = F.col("var"), F.col("H").cast("string")
    parts = []
    valued = sorted({x for f in ("anchor", "quantile", "pctcap") for x in on(f)})
    if valued:
        a = anchor_features(at, series, tolerance_s, valued, need.get("rank", []), ())
        asked = lambda f, x: F.when(v.isin(*on(f)), x)
        columns = {"x": (_name(v, "0"), asked("anchor", F.col("x0")))} if on("anchor") else {}
        if on("quantile"):
            columns["q"] = (_name(v, "q"), asked("quantile", F.col("rank")))
        if columns:
            parts.append(_long(a, **columns))
        if on("pctcap") and params is not None:
            parts.append(_long(a.filter(v.isin(*on("pctcap"))).join(params.select("guid", "cap"), "guid", "left"), p=(_name(v, "p"), _of_cap("x0"))))
    if need.get("both_rates"):
        x = _shifted_values(at, series, (*[-k for k in lags], *lags), tolerance_s, need["both_rates"]).withColumn("H", F.abs("shift"))
        before = F.col("shift") < 0
        rate = F.when(before, F.col("x0") - F.col("xs")).otherwise(F.col("xs") - F.col("x0")) / F.col("H")
        parts.append(_long(x, r=(_name(v, "r", h, F.when(before, "b").otherwise("a")), rate)))
    for side, b, a in (("b", before_h, 0), ("a", 0, after_h)) if need.get("slopes") else ():
        spans = tuple(k for k in lags if k <= (b or a))
        if spans:
            s = steepest_by_span(_each(at, need["slopes"]), series, b, a, spans, VAR, digits=SLOPE_DIGITS).withColumn("H", F.col("span_h"))
            columns = {}
            for letter, what in (("m", "rise"), ("n", "fall")):
                named = lambda suffix, letter=letter: _name(v, letter, h, side + suffix)  # noqa: B023, E731
                hours = F.col(f"{what}.end_h") * (-1 if side == "b" else 1)
                columns |= {letter: (named(""), F.col(f"{what}.slope")), f"{letter}t": (named("_t"), hours), f"{letter}x": (named("_0"), F.col(f"{what}.end_value")), f"{letter}q": (named("_q"), F.col(f"{what}.end_rank"))}
            parts.append(_long(s, **columns))
    parts.append(_crossings(at, series, before_h, gw_act_q, q_act_q))
    return reduce(DataFrame.unionByName, parts)


def legacy_episodes(anchors: DataFrame, series: DataFrame, params: DataFrame, *, lags: tuple[int, ...] = LAGS, before_h: int = 72, after_h: int = 72, tolerance_s: float = 5400, gw_act_q: float = 0.90, q_act_q: float = 0.90, gw_def: str = "gw", gw_sm_weight: float = 1.0, var_features: dict[str, dict[str, bool]] | None = None) -> DataFrame:
    """The older variant's wide row."""
    lags = tuple(sorted(set(lags)))
    features = var_features or LEGACY_FEATURES
    on = lambda f: [v for v in LEGACY_VARIABLES if features.get(v, {}).get(f)]
    long = legacy_features(anchors, _with_signal(series, gw_def, gw_sm_weight), params, lags=lags, before_h=before_h, after_h=after_h, tolerance_s=tolerance_s, gw_act_q=gw_act_q, q_act_q=q_act_q, var_features=features)
    names = [n for n, _ in legacy_names(lags, before_h, after_h, features)]
    top_lag = max([k for k in lags if k <= before_h], default=None)
    apart = {f"{x}x{k}": F.col(f"{x}r{k}b") - F.col(f"{x}r{top_lag}b") for x in on("rates") for k in lags} if top_lag is not None else {}
    stored = [n for n in names if n not in apart]
    wide = long.groupBy("guid", "t0").pivot("name", stored).agg(F.first("value", ignorenulls=True))
    rows, labels = _meta(anchors, params).join(wide, ["guid", "t0"], "left"), _labels(lags, before_h, after_h, gw_def, gw_act_q, q_act_q)
    return rows.select(F.col("guid").alias("GUID"), "t0", "y", *[labels[k] for k in ("wb", "wa", "lags")], "cap", *[labels[k] for k in ("gwdef", "gwsig", "gw_act_q", "q_act_q")], "A_km2", "HI", "MRT", "meandailyT", *[apart[n].alias(n) if n in apart else F.col(n) for n in names])


def derived_names(lags: tuple[int, ...] = LAGS, before_h: int = 72) -> list[str]:
    """Names of the derived features, in their order; needs no Spark."""
    names = [f"{v}x{h}" for v in ACTIVE for h in lags] if any(h <= before_h for h in lags) else []
    names += [f"netS{h}b" for h in lags] + ["total_storage", "storage_fraction", "relative_storage", "storage_anomaly"]
    names += [f"{v}_{k}" for v in ("gw", "q", "qmm", "sm", "swe") for k in ("delay_vs_pr", "abs_delay_vs_pr")]
    names += [f"{v}_{k}" for v in ACTIVE for k in ("peak_before_flag", "peak_after_flag", "distance_to_peak")]
    for h in lags:
        names += [f"{k}_{h}b" for k in ("runoff_ratio", "infiltration_proxy", "rain_plus_melt", "response_efficiency", "melt_fraction", "rain_fraction", "precip_x_gw", "precip_x_sm", "netS_x_gw", "gwr_norm", "smr_norm", "qmmr_norm", "qr_norm")]
        names += [f"{v}r{h}b_x_peak_{k}" for v in ("gw", "q", "qmm", "sm") for k in ("before", "after")] + [f"{k}_{h}b" for k in ("netS_ratio", "netS_norm_storage", "netS_gradient")]
    return names + [f"{k}_ratio_{a}_{b}b" for a, b in RATIO_PAIRS if a in lags and b in lags for k in ("pr", "netS", "gw_rate", "sm_rate", "qmm_rate")]


def dictionary_rows(lags: tuple[int, ...] = LAGS, before_h: int = 72, after_h: int = 72) -> list[tuple[str, str, str, str | None]]:
    """(row, feature, description, variable) of both wide rows; derived features have no variable of their own."""
    of = lambda n: next((v for v in sorted(VARIABLES, key=len, reverse=True) if n.startswith(v)), None)
    found = [("current", n, d, of(n)) for n, d in feature_names(lags) if not n.startswith("_")]
    found += [("current", n, n.replace("_", " ").strip(), None) for n in derived_names(lags, before_h)]
    return found + [("legacy", n, d, of(n)) for n, d in legacy_names(lags, before_h, after_h)]


def feature_dictionary(series: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """(row, feature, description, variable, n_values): the dictionary of both wide rows, with the number of values that the series have of a feature's variable (derived ones: 0)."""
    rows = series.sparkSession.createDataFrame(dictionary_rows(lags), "row string, feature string, description string, variable string")
    known = series.groupBy(F.col("var").alias("variable")).agg(F.count("x").alias("n"))
    return rows.join(known, "variable", "left").select("row", "feature", "description", "variable", F.coalesce("n", F.lit(0)).alias("n_values"))
