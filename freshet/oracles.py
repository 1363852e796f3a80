"""SQL for the wide rows, built from the names that they have.

The SQL knows nothing of the library's operators: windows are joins of anchors with all rows in
them, slopes are taken between all pairs of a window, ranks are counts.
"""

from __future__ import annotations

from .plans import driver_tables as dt
from .plans import episodes as ep

_COLUMN = {v: v for v in ep.VARIABLES} | {"of": "of_", "qmm": "q * 3.6 / area_km2"}
_AREA = ("area", "SELECT guid, count(*) / 100.0::DOUBLE AS area_km2, arg_min(def, ts) AS cap, avg(q) AS mrt, avg(tmp) AS mdt FROM hourly GROUP BY guid")


def _series(variables) -> tuple[tuple[str, str], ...]:
    parts = " UNION ALL ".join(f"SELECT guid, '{v}' AS var, ts, {_COLUMN[v]} AS x FROM hourly JOIN area USING (guid)" for v in variables)
    return _AREA, ("ser", f"SELECT * FROM ({parts})"), ("ranked", "SELECT *, cume_dist() OVER (PARTITION BY guid, var ORDER BY x) AS rk, max(x) OVER (PARTITION BY guid, var) AS top FROM ser"), ("a0", "SELECT p.guid, p.t0, r.var, r.x AS x0, r.rk, r.top FROM probes p JOIN ranked r ON r.guid = p.guid AND r.ts = p.t0")


def _values(source: str, *pairs: tuple[str, str]) -> str:
    """Rows (guid, t0, name, value) of a source, one for each pair of a name's and a value's expression."""
    listed = ", ".join(f"{{'name': {n}, 'value': CAST({x} AS DOUBLE)}}" for n, x in pairs)
    return f"SELECT guid, t0, u.name AS name, u.value AS value FROM (SELECT guid, t0, unnest([{listed}]) AS u FROM {source})"


def _crossing(quantile: float, hours: int) -> tuple[tuple[str, str], ...]:
    hit = lambda v, thr: f"min(h.ts) FILTER (h.var = '{v}' AND h.x >= {thr})"
    return (
        ("lim", f"SELECT guid, quantile_cont(x, {quantile}) FILTER (var = 'gw') AS gthr, quantile_cont(x, {quantile}) FILTER (var = 'q') AS qthr FROM ser GROUP BY guid"),
        ("hit", f"SELECT p.guid, p.t0, any_value(gthr) AS gthr, any_value(qthr) AS qthr, {hit('gw', 'gthr')} AS tg, {hit('q', 'qthr')} AS tq FROM probes p JOIN lim USING (guid) JOIN ser h ON h.guid = p.guid AND h.ts >= p.t0 - INTERVAL {hours} HOUR AND h.ts <= p.t0 GROUP BY 1, 2"),
        ("hxl", _values("hit", ("'hxl_pre'", "(epoch(tg) - epoch(tq)) / 3600"), ("'hxl_pre_gwt'", "(epoch(t0) - epoch(tg)) / 3600"), ("'hxl_pre_qt'", "(epoch(t0) - epoch(tq)) / 3600"), ("'hxl_pre_gwthr'", "gthr"), ("'hxl_pre_qthr'", "qthr"))),
    )


def _pivot(parts: list[str], names: list[str]) -> tuple[tuple[str, str], ...]:
    columns = ", ".join(f"max(value) FILTER (name = '{n}') AS \"{n}\"" for n in names)
    return ("long_", " UNION ALL ".join(parts)), ("wide_", f"SELECT guid, t0, {columns} FROM long_ GROUP BY 1, 2")


def _r(x: str, name: str) -> str:
    return f'round({x}, 6) + 0::DOUBLE AS "{name}"'


def _meta(before_h: int, after_h: int, lags, quantile: float, legacy: bool) -> list[str]:
    lag_text = ",".join(map(str, lags))
    params = [_r("area_km2", "A_km2"), _r("0.5::DOUBLE", "HI"), _r("mrt", "MRT"), _r("mdt", "meandailyT")]
    quantiles = [f"{quantile}::DOUBLE AS gw_act_q", f"{quantile}::DOUBLE AS q_act_q"]
    first = ['guid AS "GUID"', "t0", "1 AS y", f"{before_h} AS wb", f"{after_h} AS wa", f"'{lag_text}' AS lags", _r("cap", "cap"), "'gw' AS gwdef", "'gw' AS gwsig"]
    return [*first, *quantiles, *params] if legacy else [*first, "'q*3.6/area_km2' AS qmm_sig", *params, *quantiles]


def wide_sql(lags: tuple[int, ...] = ep.LAGS, before_h: int = 72, after_h: int = 72, anchors: tuple[tuple[str, str], ...] = (), rows: str = "", more_columns: tuple[str, ...] = (), recursive: bool = False) -> str:
    """The wide row of all catchments' probes, with all its families.

    ``anchors`` are views before these that end in ``probes`` of their own; ``rows`` is joined to
    the result by (guid, t0), with a label y and ``more_columns``.
    """
    in_sql = ", ".join(f"({h})" for h in lags)
    frame = lambda h: f"OVER (PARTITION BY guid, var ORDER BY ts ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
    sums = " UNION ALL ".join(f"SELECT guid, var, {h} AS h, ts, CASE WHEN count(x) {frame(h)} = {h} THEN list_reduce(list(x) {frame(h)}, lambda a, b: a + b) END AS s FROM full_" for h in lags)
    part = lambda sign: f"sum(CASE WHEN r {sign} 0 THEN 1 ELSE 0 END) OVER (PARTITION BY guid, var, h ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / nullif(sum(CASE WHEN r {sign} 0 THEN 1 ELSE 0 END) OVER (PARTITION BY guid, var, h), 0)"
    views = (
        *_series(ep.VARIABLES),
        ("lag_", f"SELECT * FROM (VALUES {in_sql}) t(h)"),
        ("rat", "SELECT a.guid, a.var, h, a.ts, (a.x - b.x) / h AS r, a.x AS x0, b.x AS xb FROM ser a CROSS JOIN lag_ JOIN ser b ON b.guid = a.guid AND b.var = a.var AND b.ts = a.ts - to_hours(h) WHERE a.var <> 'tmp'"),
        ("rr", f"SELECT *, cume_dist() OVER (PARTITION BY guid, var, h ORDER BY r) AS rq, {part('>')} AS rqp, {part('<')} AS rqn, max(abs(r)) OVER (PARTITION BY guid, var, h) AS am FROM rat"),
        ("r0", "SELECT p.guid, p.t0, var, h, r, rq, rqp, rqn, r / nullif(am, 0) * 100 AS rpmx, x0, xb FROM probes p JOIN rr ON rr.guid = p.guid AND rr.ts = p.t0"),
        ("around", f"SELECT p.guid, p.t0, s.var, s.ts, s.x, lag(s.x) OVER w AS a, lead(s.x) OVER w AS z FROM probes p JOIN ser s ON s.guid = p.guid AND s.ts >= p.t0 - INTERVAL {before_h} HOUR AND s.ts <= p.t0 + INTERVAL {after_h} HOUR WHERE s.var <> 'tmp' WINDOW w AS (PARTITION BY p.guid, p.t0, s.var ORDER BY s.ts)"),
        ("peak", "SELECT guid, t0, var, arg_min({'ts': ts, 'x': x}, {'d': abs(epoch(ts) - epoch(t0)), 'v': -x, 't': ts}) AS b FROM around WHERE (a IS NULL OR x >= a) AND (z IS NULL OR x >= z) AND (a IS NULL OR z IS NULL OR x > a OR x > z) GROUP BY 1, 2, 3"),
        ("pk", "SELECT p.guid, p.t0, p.var, (epoch(p.t0) - epoch(p.b.ts)) / 3600 AS t, p.b.x AS x, r.rk FROM peak p JOIN ranked r ON r.guid = p.guid AND r.var = p.var AND r.ts = p.b.ts"),
        ("grid", "SELECT guid, var, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM ser WHERE var IN ('pr', 'qmm') GROUP BY 1, 2"),
        ("full_", "SELECT g.guid, g.var, g.ts, s.x FROM grid g LEFT JOIN ser s ON s.guid = g.guid AND s.var = g.var AND s.ts = g.ts"),
        ("sums", f"SELECT * FROM ({sums}) WHERE s IS NOT NULL"),
        ("ss", "SELECT *, cume_dist() OVER (PARTITION BY guid, var, h ORDER BY s) AS sq, max(s) OVER (PARTITION BY guid, var, h) AS top FROM sums"),
        ("s0", "SELECT p.guid, p.t0, ss.var, ss.h, s, sq, s / nullif(top, 0) * 100 AS spmx FROM probes p JOIN ss ON ss.guid = p.guid AND ss.ts = p.t0"),
        ("mr", f"SELECT p.guid, p.t0, ss.h, max(s) AS m, max(s) / nullif(any_value(top), 0) * 100 AS mp FROM probes p JOIN ss ON ss.guid = p.guid AND ss.var = 'pr' AND ss.ts >= p.t0 - to_hours({before_h} - greatest(0, ss.h - 1)) AND ss.ts <= p.t0 GROUP BY 1, 2, 3"),
        ("lossd", "SELECT guid, h, greatest(-r * h, 0) AS d FROM rat WHERE var = 'swe'"),
        ("loss", "SELECT r0.guid, t0, r0.h, any_value(greatest(xb - x0, 0)) AS l, count(*) FILTER (d <= greatest(xb - x0, 0))::DOUBLE / count(*) AS lq, max(d) AS top FROM r0 JOIN lossd USING (guid, h) WHERE var = 'swe' GROUP BY 1, 2, 3"),
        ("q90", "SELECT guid, var, quantile_cont(x, 0.9) AS thr FROM ser WHERE var IN ('gw', 'pr', 'qmm') GROUP BY 1, 2"),
        ("hot", "SELECT p.guid, p.t0, s.var, h, count(*) FILTER (s.x > thr) AS n, coalesce(sum(s.x - thr) FILTER (s.x > thr), 0) AS e FROM probes p CROSS JOIN lag_ JOIN q90 USING (guid) JOIN ser s ON s.guid = p.guid AND s.var = q90.var AND s.ts > p.t0 - to_hours(h) AND s.ts <= p.t0 GROUP BY 1, 2, 3, 4"),
        *_crossing(0.99, before_h),
        ("tot", "SELECT guid, max(gw + sm) AS top, avg(gw + sm) AS mean, stddev_pop(gw + sm) AS sd, count(*) AS n FROM hourly GROUP BY guid"),
    )
    gw = "(SELECT * FROM a0 JOIN area USING (guid) WHERE var = 'gw')"
    parts = [
        _values("a0", ("var || '0'", "x0"), ("var || 'q'", "rk"), ("var || 'pmx'", "x0 / nullif(top, 0) * 100")),
        _values(gw, ("'gwp'", "CASE WHEN cap > 0 THEN x0 / cap * 100 END"), ("'gwmxcap'", "CASE WHEN cap > 0 THEN top / cap * 100 END")),
        _values("pk", ("var || 'pk_t'", "t"), ("var || 'pk_0'", "x"), ("var || 'pk_q'", "rk")),
        _values("r0", *[(f"var || '{n}' || h || 'b'", n) for n in ("r", "rq", "rqp", "rqn", "rpmx")]),
        _values("s0", *[(f"var || '{n}' || h || 'b'", x) for n, x in (("S", "s"), ("Sq", "sq"), ("Spmx", "spmx"))]),
        _values("mr", ("'prmr' || h || 'b'", "m"), ("'prmrpmx' || h || 'b'", "mp")),
        _values("loss", ("'sweLossS' || h || 'b'", "l"), ("'sweLossSq' || h || 'b'", "lq"), ("'sweLossSpmx' || h || 'b'", "l / nullif(top, 0) * 100")),
        _values("hot", ("'hours_' || var || '_high_q90_' || h || 'b'", "n"), ("var || '_excess_q90_sum_' || h || 'b'", "e")),
        "SELECT * FROM hxl",
    ]
    names = [n for n, _ in ep.feature_names(lags) if not n.startswith("_")]
    c = lambda n: f'"{n}"'
    ratio = lambda a, b: f"({a}) / nullif(({b}), 0)"
    more: dict[str, str] = {}
    top_lag = max(h for h in lags if h <= before_h)
    for v in ep.ACTIVE:
        more |= {f"{v}x{h}": f"{c(f'{v}r{h}b')} - {c(f'{v}r{top_lag}b')}" for h in lags}
    pr, qmm, loss = (lambda h: c(f"prS{h}b")), (lambda h: c(f"qmmS{h}b")), (lambda h: c(f"sweLossS{h}b"))
    net = lambda h: f"({pr(h)} - {qmm(h)})"
    more |= {f"netS{h}b": net(h) for h in lags}
    storage = "(gw0 + sm0)"
    more |= {"total_storage": storage, "storage_fraction": ratio(storage, "cap"), "relative_storage": ratio(storage, "tot.top"), "storage_anomaly": f"CASE WHEN tot.n >= 2 AND tot.sd <> 0 THEN ({storage} - tot.mean) / tot.sd END"}
    for v in ("gw", "q", "qmm", "sm", "swe"):
        more |= {f"{v}_delay_vs_pr": f"{v}pk_t - prpk_t", f"{v}_abs_delay_vs_pr": f"abs({v}pk_t - prpk_t)"}
    flags = {}
    for v in ep.ACTIVE:
        flags |= {f"{v}_peak_before_flag": f"CAST({v}pk_t > 0 AS INT)", f"{v}_peak_after_flag": f"CAST({v}pk_t < 0 AS INT)"}
        more |= flags | {f"{v}_distance_to_peak": f"abs({v}pk_t)"}
    for h in lags:
        both = f"{pr(h)} + {loss(h)}"
        more |= {
            f"runoff_ratio_{h}b": ratio(qmm(h), pr(h)), f"infiltration_proxy_{h}b": f"1 - {ratio(qmm(h), pr(h))}", f"rain_plus_melt_{h}b": both, f"response_efficiency_{h}b": ratio(qmm(h), both),
            f"melt_fraction_{h}b": ratio(loss(h), both), f"rain_fraction_{h}b": ratio(pr(h), both), f"precip_x_gw_{h}b": f"{pr(h)} * gw0", f"precip_x_sm_{h}b": f"{pr(h)} * sm0", f"netS_x_gw_{h}b": f"{net(h)} * gw0",
            **{f"{v}r_norm_{h}b": ratio(c(f"{v}r{h}b"), f"{v}0") for v in ("gw", "sm", "qmm", "q")},
            **{f"{v}r{h}b_x_peak_{side}": f"{c(f'{v}r{h}b')} * CAST({v}pk_t {sign} 0 AS INT)" for v in ("gw", "q", "qmm", "sm") for side, sign in (("before", ">"), ("after", "<"))},
            f"netS_ratio_{h}b": ratio(net(h), pr(h)), f"netS_norm_storage_{h}b": ratio(net(h), storage), f"netS_gradient_{h}b": f"{net(h)} / {h}",
        }
    for a, b in ep.RATIO_PAIRS:
        if a in lags and b in lags:
            more |= {f"pr_ratio_{a}_{b}b": ratio(pr(a), pr(b)), f"netS_ratio_{a}_{b}b": ratio(net(a), net(b)), **{f"{v}_rate_ratio_{a}_{b}b": ratio(c(f"{v}r{a}b"), c(f"{v}r{b}b")) for v in ("gw", "sm", "qmm")}}
    columns = [*_meta(before_h, after_h, lags, 0.99, False), *[_r(c(n), n) for n in names], *[f'{x} AS "{n}"' if n in flags else _r(x, n) for n, x in more.items()]]
    if rows:
        columns = [x if x != "1 AS y" else "y" for x in columns] + list(more_columns)
    joined = f" JOIN ({rows}) USING (guid, t0)" if rows else ""
    return dt.sql(f"SELECT {', '.join(columns)} FROM wide_ JOIN area USING (guid) JOIN tot USING (guid){joined}", *anchors, *views, *_pivot(parts, names), held=not recursive, recursive=recursive)


def legacy_sql(lags: tuple[int, ...] = ep.LAGS, before_h: int = 72, after_h: int = 72) -> str:
    """The older wide row, its slopes from all pairs of rows."""
    shifts = ", ".join(f"({h})" for k in lags for h in (-k, k))
    pick = lambda h, sign: f"arg_min({{'s': s, 't': bt, 'x': bx, 'q': bq}}, {{'k': round({sign}s, 9), 'a': ts, 'b': bt}}) FILTER (g <= {h})"
    picks = ", ".join(f"{pick(h, sign)} AS {letter}{h}" for h in lags for letter, sign in (("m", "-"), ("n", "")))
    views = [
        *_series(ep.LEGACY_VARIABLES),
        ("shift_", f"SELECT * FROM (VALUES {shifts}) t(k)"),
        ("xs", "SELECT a.guid, a.t0, a.var, k, any_value(a.x0) AS x0, arg_min(s.x, {'d': abs(epoch(s.ts) - epoch(a.t0) - 3600 * k), 'l': -epoch(s.ts)}) AS x FROM a0 a CROSS JOIN shift_ JOIN ser s ON s.guid = a.guid AND s.var = a.var AND abs(epoch(s.ts) - epoch(a.t0) - 3600 * k) <= 5400 WHERE a.var <> 'tmp' GROUP BY 1, 2, 3, 4"),
        ("side", f"SELECT p.guid, p.t0, 'b' AS side, s.var, s.ts, s.x FROM probes p JOIN ser s ON s.guid = p.guid AND s.ts > p.t0 - INTERVAL {before_h} HOUR AND s.ts <= p.t0 WHERE s.var <> 'tmp' UNION ALL SELECT p.guid, p.t0, 'a', s.var, s.ts, s.x FROM probes p JOIN ser s ON s.guid = p.guid AND s.ts >= p.t0 AND s.ts < p.t0 + INTERVAL {after_h} HOUR WHERE s.var <> 'tmp'"),
        ("win_", "SELECT *, cume_dist() OVER (PARTITION BY guid, t0, side, var ORDER BY x) AS q FROM side"),
        ("pair", f"SELECT a.guid, a.t0, a.side, a.var, a.ts, b.ts AS bt, b.x AS bx, b.q AS bq, (epoch(b.ts) - epoch(a.ts)) / 3600 AS g, (b.x - a.x) / ((epoch(b.ts) - epoch(a.ts)) / 3600) AS s FROM win_ a JOIN win_ b ON a.guid = b.guid AND a.t0 = b.t0 AND a.side = b.side AND a.var = b.var AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {max(lags)} HOUR"),
        ("steep", f"SELECT guid, t0, side, var, {picks} FROM pair GROUP BY 1, 2, 3, 4"),
        *_crossing(0.9, before_h),
    ]
    slopes = []
    for h in lags:
        for letter in "mn":
            m, name = f"{letter}{h}", f"var || '{letter}{h}' || side"
            slopes += [(name, f"{m}.s"), (f"{name} || '_t'", f"abs(epoch({m}.t) - epoch(t0)) / 3600"), (f"{name} || '_0'", f"{m}.x"), (f"{name} || '_q'", f"{m}.q")]
    parts = [
        _values("a0", ("var || '0'", "x0"), ("var || 'q'", "rk")), _values("(SELECT * FROM a0 JOIN area USING (guid) WHERE var = 'gw')", ("'gwp'", "CASE WHEN cap > 0 THEN x0 / cap * 100 END")),
        _values("xs", ("var || 'r' || abs(k) || CASE WHEN k < 0 THEN 'b' ELSE 'a' END", "CASE WHEN k < 0 THEN x0 - x ELSE x - x0 END / abs(k)")), _values("steep", *slopes), "SELECT * FROM hxl",
    ]
    names = [n for n, _ in ep.legacy_names(lags, before_h, after_h)]
    top_lag = max(h for h in lags if h <= before_h)
    apart = {f"{v}x{h}": f'"{v}r{h}b" - "{v}r{top_lag}b"' for v in ep.LEGACY_VARIABLES if v != "tmp" for h in lags}
    columns = [*_meta(before_h, after_h, lags, 0.9, True), *[_r(apart.get(n, f'"{n}"'), n) for n in names]]
    return dt.sql(f"SELECT {', '.join(columns)} FROM wide_ JOIN area USING (guid)", *views, *_pivot(parts, [n for n in names if n not in apart]), held=True)


def stress_table_sql(views: tuple[tuple[str, str], ...], minmax: str) -> str:
    """The 53 columns of every event's series, from the views of the stress index."""
    top = lambda share, x: f"{share} * max({x}) OVER (PARTITION BY guid)"
    over = lambda x, thr: f"CASE WHEN {x} - {thr} < 0 THEN 0 ELSE {x} - {thr} END"
    more = (
        ("lim", f"SELECT guid, ts, gr, sr, pw, mw, gp, sp, {top(0.15, 'gp')} AS tg, {top(0.15, 'sp')} AS tsm, {top(0.2, 'pw')} AS tp, {top(0.1, 'mw')} AS tw, 0.5 * first_value(def) OVER (PARTITION BY guid ORDER BY ts) AS tb FROM s2"),
        ("tot", f"SELECT guid, ts, raw, {minmax.format('raw')} AS total FROM (SELECT guid, ts, base + grad + prec + swe + of_ AS raw FROM s5)"),
        ("evt", "SELECT guid, strftime(t0, '%m%d%H') AS no, t0 FROM probes"),
    )
    named = {
        "GW_mm": "h.gw", "SM_mm": "h.sm", "OF_m3s": "h.of_", "SWE_mm": "h.swe", "Prec_mm": "h.pr", "Temp_C": "h.tmp", "Q_m3s": "h.q", "GW_def_mm": "h.def",
        "stress_total": "tot.total", "stress_total_raw_pre_final_norm": "tot.raw", "stress_base": "s5.base", "stress_grad": "s5.grad", "stress_prec": "s5.prec", "stress_swe": "s5.swe", "stress_of": "s5.of_",
        "gw_norm": "s4.bn", "sm_norm": "0::DOUBLE", "grad_norm": "s4.gn", "prec_norm": "s4.pn", "swe_norm": "s4.sn", "of_norm": "s4.on_", "base_mem": "m.m0", "grad_mem": "m.m1", "prec_mem": "m.m2", "swe_mem": "m.m3", "of_mem": "m.m4",
        "prec_window_mm": "l.pw", "swe_melt_window_mm": "l.mw", "GW_dXdt_unitsday": "l.gr", "SM_dXdt_unitsday": "l.sr", "GW_pos_excess": over("l.gp", "l.tg"), "GW_neg_excess": "0::DOUBLE", "SM_pos_excess": over("l.sp", "l.tsm"), "SM_neg_excess": "0::DOUBLE",
        "prec_excess_mm": over("l.pw", "l.tp"), "swe_excess_mm": over("l.mw", "l.tw"), "of_excess": "h.of_", "thr_GW_base": "l.tb", "thr_SM_base": "NULL::DOUBLE", "thr_BASE_storage": "l.tb", "thr_OF": "0::DOUBLE", "thr_prec_window": "l.tp",
        "thr_swe_window": "l.tw", "thr_GW_posgrad": "l.tg", "thr_GW_neggrad": "NULL::DOUBLE", "thr_SM_posgrad": "l.tsm", "thr_SM_neggrad": "NULL::DOUBLE",
    }
    first = ['h.ts AS "Datetime"', "h.ts = e.t0 AS is_event_time", "e.t0 AS event_time", 'h.guid AS "GUID"', 'e.no AS "No"', 'NULL::VARCHAR AS "SkredID"']
    body = f"SELECT {', '.join([*first, *[_r(x, n) for n, x in named.items()]])} FROM hourly h JOIN evt e USING (guid) JOIN lim l USING (guid, ts) JOIN s4 USING (guid, ts) JOIN memory m USING (guid, ts) JOIN s5 USING (guid, ts) JOIN tot USING (guid, ts)"
    return dt.sql(body, *views, *more, recursive=True)


def dictionary_sql() -> str:
    """The dictionary of both wide rows, with the values that there are of each variable."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in ep.dictionary_rows())
    count = "(SELECT var, count(x) AS n FROM ser GROUP BY var)"
    return dt.sql(f'SELECT d."row", d.feature, d.description, d.variable, coalesce(c.n, 0) AS n_values FROM (VALUES {rows}) d("row", feature, description, variable) LEFT JOIN {count} c ON c.var = d.variable', *_series(ep.VARIABLES)[:2])
