"""Folds, cells, lag rates, panels, clustered writers and the workbook source."""

import random
import zipfile
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import asof, cells, matching, peaks
from freshet.plans import episodes as ep
from freshet.plans import panels, stress
from freshet.sources import catalogue, sinks
from freshet.sources.workbooks import register

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(seconds=round(hours * 3600))


def irregular(seed, n, span=400.0):
    rng = random.Random(seed)
    return sorted((round(rng.random() * span * 60) / 60, round(rng.random() * 9, 2)) for _ in range(n))


# --- greedy folds ------------------------------------------------------------------------------


def test_greedy_of_many_rows_in_several_batches(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit("a").alias("guid"), F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") * 1800).alias("t_anchor"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000).alias("dist"))
    found = matching.greedy(rows, 40, 3, 2, (0.05, 0.2, 0.5)).orderBy("rank").collect()
    data = [(r["dist"], r["t_anchor"]) for r in rows.collect()]
    tier = lambda d: sum(d > t for t in (0.05, 0.2, 0.5)) + 1
    picks = []
    free = lambda t: all(abs((t.replace(minute=0) - p[2].replace(minute=0)).total_seconds()) >= 2 * 86_400 for p in picks)
    for k in (1, 2, 3):
        own = sorted(x for x in data if tier(x[0]) == k)
        for year in sorted({t.year for _, t in own}):
            if len(picks) >= 40:
                continue
            taken = 0
            for d, t in own:
                if t.year == year and taken < 3 and free(t):
                    picks.append((k, d, t))
                    taken += 1
    for k in (1, 2, 3, 4):
        for d, t in sorted(x for x in data if tier(x[0]) == k):
            if len(picks) < 40 and free(t):
                picks.append((k, d, t))
    assert [(r["tier"], r["dist"], r["t_anchor"]) for r in found] == sorted(picks)[:40]


def test_greedy_collects_no_catchment(spark):
    rows = spark.createDataFrame([("a", T0, 0.1), (None, T0, 0.1), ("a", T0, None)], "guid string, t_anchor timestamp, dist double")
    chosen = matching.greedy(rows, 5, 2, 1, (0.2,))
    assert "collect_list" not in chosen._jdf.queryExecution().toString()
    assert {(r["guid"], r["rank"]) for r in chosen.collect()} == {("a", 1), (None, 1)}
    assert matching.greedy(rows.limit(0), 5, 2, 1, (0.2,)).count() == 0


def test_peaks_over_a_threshold_by_the_loop(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(900)]
    s = spark.createDataFrame([("a", at(24 * i), v) for i, v in enumerate(values)], "guid string, ts timestamp, x double")
    events = spark.createDataFrame([("a", at(24 * 100))], "guid string, event_time timestamp")
    got = {(r["year"], r["rank_in_year"]): r["t_anchor"] for r in matching.pot_peaks(s, events, q=0.5, per_year=5).collect()}
    limit = sorted(values)[449] + 0.5 * (sorted(values)[450] - sorted(values)[449])
    tops = sorted((-v, at(24 * i)) for i, v in enumerate(values) if 0 < i < 899 and values[i - 1] < v >= values[i + 1] and v > limit and abs(i - 100) > 3)
    want = {}
    for v, t in tops:
        own = [x for (y, _), x in want.items() if y == t.year]
        if len(own) < 5 and all(abs((t - x).days) >= 7 for x in own):
            want[t.year, len(own) + 1] = t
    assert got == want


# --- windows over cells ------------------------------------------------------------------------


@pytest.mark.parametrize("hours", [0.5, 1, 3, 7.25, 24, 72])
@pytest.mark.parametrize("open_start", [False, True])
def test_windows_from_cells_are_brute_force(spark, hours, open_start):
    points = irregular(1, 300)
    probes = [h for h, _ in irregular(2, 60, 460)] + [10.0, 11.0, 12.0]
    series = spark.createDataFrame([("a", at(h), v) for h, v in points] + [("b", at(0), 1.0)], "k string, ts timestamp, x double")
    anchors = spark.createDataFrame([("a", at(h)) for h in probes] + [("c", at(1))], "k string, t0 timestamp")
    values = {"n": (F.col("x"), "count"), "s": (F.col("x"), "sum"), "low": (F.col("x"), "min"), "high": (F.col("x"), "max")}
    got = {r["t0"]: r for r in cells.before(anchors, series, hours, ["k"], values, open_start=open_start).collect()}
    for h in probes:
        t = at(h)
        own = [v for p, v in points if (at(p) > t - timedelta(hours=hours) or (not open_start and at(p) == t - timedelta(hours=hours))) and at(p) <= t]
        if not own:
            assert t not in got
            continue
        r = got[t]
        assert (r["n"], r["low"], r["high"]) == (len(own), min(own), max(own)) and abs(r["s"] - sum(own)) < 1e-9


def test_windows_of_different_lengths_together(spark):
    points = irregular(3, 200)
    series = spark.createDataFrame([("a", at(h), v) for h, v in points], "k string, ts timestamp, x double")
    anchors = spark.createDataFrame([("a", at(100), 3, 4.0), ("a", at(100), 48, 4.0), ("a", at(100), 48, None), ("z", at(1), 3, 4.0)], "k string, t0 timestamp, H int, thr double")
    got = {(r["k"], r["H"], r["thr"]): (r["hours_high"], r["excess_sum"]) for r in peaks.hours_over(anchors, series, F.col("H"), ["k"], more=("H",), most_hours=48).collect()}
    for hours in (3, 48):
        own = [v for p, v in points if 100 - hours < p <= 100]
        n, e = got["a", hours, 4.0]
        assert n == sum(v > 4 for v in own) and abs(e - sum(max(0.0, v - 4) for v in own)) < 1e-9
    assert got["a", 48, None] == (None, None) and got["z", 3, 4.0] == (None, None)


# --- slopes and rates --------------------------------------------------------------------------


def test_slopes_of_all_spans_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    series, anchors = [], []
    for k in range(20):
        times = sorted({rng.randrange(0, 90 * 4) for _ in range(60)})
        series += [(f"k{k}", at(t / 4), float(rng.randrange(4))) for t in times]
        anchors.append((f"k{k}", at(rng.randrange(20, 80))))
    df, probes = spark.createDataFrame(series, "guid string, ts timestamp, x double"), spark.createDataFrame(anchors, "guid string, t0 timestamp")
    for before, after in ((24, 0), (0, 24)):
        got = {(r["guid"], r["span_h"]): r for r in peaks.steepest_by_span(probes, df, before, after, (1, 3, 24), ["guid"]).collect()}
        for guid, t0 in anchors:
            own = [(t, x) for g, t, x in series if g == guid and (t0 - timedelta(hours=before) < t <= t0 if before else t0 <= t < t0 + timedelta(hours=after))]
            for span in (1, 3, 24):
                for name, sign in (("rise", 1), ("fall", -1)):
                    best = None
                    for i, (a, x) in enumerate(own):
                        for b, y in own[i + 1 :]:
                            h = (b - a).total_seconds() / 3600
                            if h <= span and (best is None or sign * (y - x) / h > sign * best[0] + 1e-12):
                                best = ((y - x) / h, b, y)
                    found = got[guid, span][name] if (guid, span) in got else None
                    if best is None:
                        assert found is None or found["slope"] is None
                        continue
                    assert abs(found["slope"] - best[0]) < 1e-9 and found["end_value"] == best[2]
                    assert abs(found["end_h"] - (best[1] - t0).total_seconds() / 3600) < 1e-9
                    assert abs(found["end_rank"] - sum(v <= best[2] for _, v in own) / len(own)) < 1e-12


def test_rates_of_all_lags_are_brute_force_across_cells(spark):
    rng = random.Random(8)
    times = sorted({rng.randrange(0, 3000 * 2) for _ in range(1500)})
    points = [(t / 2, round(rng.random(), 3)) for t in times]
    series = spark.createDataFrame([("a", at(h), v) for h, v in points] + [("a", at(1), None), ("b", at(0), 1.0)], "k string, ts timestamp, x double")
    rates = asof.lag_rates(series, (3, 72), 5400, ["k"])
    got = {r["ts"]: r for r in rates.filter("k = 'a'").collect()}
    assert len(got) == len(points)
    for h, v in points:
        for lag in (3, 72):
            near = [(abs(p - (h - lag)), -p, x) for p, x in points if abs(p - (h - lag)) <= 1.5]
            want = (v - min(near)[2]) / lag if near else None
            found = got[at(h)][f"r{lag}"]
            assert (found is None) == (want is None) and (want is None or abs(found - want) < 1e-12)
    assert rates._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_snap_over_empty_cells_is_brute_force(spark):
    points = [0.0, 0.5, 30.0, 200.0, 700.25]
    probes = [-50.0, 0.2, 14.0, 15.0, 16.0, 100.0, 115.0, 450.0, 699.9, 2000.0]
    series = spark.createDataFrame([("a", at(h)) for h in points], "guid string, ts timestamp")
    anchors = spark.createDataFrame([("a", i, at(h)) for i, h in enumerate(probes)] + [("z", 99, T0)], "guid string, i int, t timestamp")
    got = {r["i"]: r["row"] for r in asof.snapped(anchors, series, ["guid"], name="row", by_hour=False).collect()}
    for i, h in enumerate(probes):
        hour = at(h).replace(minute=0, second=0)
        assert got[i] == min((at(p) for p in points), key=lambda t: (abs(t - hour), t))
    assert got[99] is None


# --- episodes ----------------------------------------------------------------------------------


def small(spark):
    rng = random.Random(9)
    series = spark.createDataFrame([("a", v, at(h), round(rng.random() * 5, 2)) for v in ep.VARIABLES for h in range(120)], "guid string, var string, ts timestamp, x double")
    params = spark.createDataFrame([("a", 3.0, 9.0, 0.5, 1.0, 2.0)], "guid string, area_km2 double, cap double, HI double, MRT double, meandailyT double")
    return spark.createDataFrame([("a", at(80), 1)], "guid string, t0 timestamp, y int"), series, params


def test_switched_off_families_are_in_neither_columns_nor_plan(spark):
    anchors, series, params = small(spark)
    off = {v: dict.fromkeys(ep.FAMILIES, False) for v in ep.VARIABLES}
    few = off | {"gw": off["gw"] | {"anchor": True}}
    whole = ep.episodes(anchors, series, params, lags=(3,))
    part = ep.episodes(anchors, series, params, lags=(3,), var_features=few)
    assert {"gwpk_t", "smr3b", "gwq", "pr0", "gwx3"} <= set(whole.columns)
    gone = {"gwpk_t", "smr3b", "gwq", "pr0", "gwx3", "gwpmx", "gwp"}
    assert not gone & set(part.columns) and {"gw0", "prS3b", "sweLossS3b", "hxl_pre", "total_storage"} <= set(part.columns)
    a, b = whole.first(), part.first()
    assert a["gw0"] == b["gw0"] and a["sweLossS3b"] == b["sweLossS3b"] and b["total_storage"] is None and b["gw_delay_vs_pr"] is None
    count = lambda df, node: df._jdf.queryExecution().optimizedPlan().toString().count(node)
    # No peaks: no lead() over an anchor's window; no ranks of anchors' values.
    assert count(whole, "lead(") > 0 and count(part, "lead(") == 0
    assert count(part, "Window") < count(whole, "Window") and count(part, "Join") < count(whole, "Join")
    assert ep.inputs_of(few) == {"value": ["gw"]}
    with pytest.raises(ValueError):
        ep.inputs_of({"gw": {"other": True}})


def test_names_need_no_session(spark):
    for lags, before in (((3, 24, 72), 72), (ep.LAGS, 72), ((6,), 3)):
        assert list(ep.derived(lags, before)) == ep.derived_names(lags, before)
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.oracle_sql()) < len(e.queries())"], cwd=sys.path[0]).returncode == 0


def test_legacy_row_has_719_columns_and_its_switches(spark):
    anchors, series, params = small(spark)
    assert len(ep.legacy_names()) + 15 == 719 and len(set(n for n, _ in ep.legacy_names())) == 704
    row = ep.legacy_episodes(anchors, series, params, lags=(3, 24), before_h=10).first().asDict()
    assert "gwm24b" not in row and "gwm24a" in row and row["gwm3b_t"] >= 0 and row["gwx3"] == 0.0
    none = {v: dict.fromkeys(ep.LEGACY_FAMILIES, v == "tmp") for v in ep.LEGACY_VARIABLES}
    names = ep.legacy_episodes(anchors, series, params, lags=(3,), var_features=none).columns
    assert "tmpr3a" in names and "gw0" not in names and "hxl_pre" in names


def test_legacy_slopes_equal_in_decimals_go_by_the_first_start(spark):
    # Of doubles 0.5 - 0.3 exceeds 0.3 - 0.1, and 0.1 - 0.3 is above 0.3 - 0.5.
    values = [0.1, 0.3, 0.5, 0.3, 0.1, 0.1]
    assert values[2] - values[1] > values[1] - values[0]
    series = spark.createDataFrame([("a", "swe", at(i), x) for i, x in enumerate(values)], "guid string, var string, ts timestamp, x double")
    anchors = spark.createDataFrame([("a", at(5), 1)], "guid string, t0 timestamp, y int")
    got = {r["name"]: r["value"] for r in ep.legacy_features(anchors, series, lags=(3,)).collect()}
    assert (got["swem3b_t"], got["swem3b_0"]) == (4.0, 0.3) and (got["swen3b_t"], got["swen3b_0"]) == (2.0, 0.3)


# --- stress and panels -------------------------------------------------------------------------


def hourly(spark, step, guid, n=160):
    rng = random.Random(guid)
    names = ("pr", "tmp", "q", "of", "def", "gw", "swe", "sm")
    return spark.createDataFrame([(guid, at(step * i), *[round(rng.random() * 20 - (k == "tmp") * 5, 2) for k in names]) for i in range(n)], "guid string, ts timestamp, " + ", ".join(f"`{k}` double" for k in names))


@pytest.mark.parametrize("mode", ["exp", "rolling"])
def test_two_resolutions_in_one_plan_equal_the_two_apart(spark, mode):
    cfg = replace(stress.RUN, forc_accum_mode=mode, forc_window_days=2, include_neg_grad=True)
    a, b = hourly(spark, 1, "one"), hourly(spark, 3, "three")
    together = {(r["guid"], r["ts"]): r for r in stress.stress(a.unionByName(b), cfg).collect()}
    for part, h in ((a, 1.0), (b, 3.0)):
        for r in stress.stress(part, cfg, h).collect():
            other = together[r["guid"], r["ts"]]
            for c in ("gw_rate", "prec_window", "melt_window", "prec_mem", "base_mem", "stress_total"):
                assert (r[c] is None and other[c] is None) or abs(r[c] - other[c]) < 1e-9, c


def test_one_file_per_event(spark, tmp_path):
    sim = hourly(spark, 1, "x").unionByName(hourly(spark, 1, "y")).repartition(6)
    events = spark.createDataFrame([(g, no, None, at(h)) for g in "xy" for no, h in (("1", 20), ("2", 50), (None, 70))], "guid string, no string, skred_id string, event_time timestamp")
    table = stress.event_tables(stress.stress(sim, stress.RUN, 1.0), events)
    sinks.write_stress(table, str(tmp_path / "out"), "csv")
    files = sorted((tmp_path / "out").rglob("part-*.csv"))
    assert len(files) == 6 and len({f.parent for f in files}) == 6
    back = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert back.count() == table.count() == 6 * 160
    first = files[0].read_text().splitlines()
    assert len(first) == 161 and first[1:] == sorted(first[1:])
    marked = table.filter("is_event_time").select("GUID", "event_time").distinct().count()
    assert marked == 6


def test_panels_of_all_events(spark, tmp_path):
    stressed = stress.stress(hourly(spark, 1, "x"), stress.RUN, 1.0)
    events = spark.createDataFrame([("x", "1", at(5)), ("x", None, at(150))], "guid string, no string, event_ts timestamp")
    rows = panels.event_panels(stressed, events, 1.0, 10, 4, 6)
    got = rows.collect()
    first = [r for r in got if r["no"] == "1"]
    assert [r["offset"] for r in sorted(first, key=lambda r: r["ts"])] == list(range(-5, 7))
    window = [r for r in first if r["in_window"]]
    assert len(window) == 10 and first[0]["pr_limit"] == max(r["pr"] for r in window) * 1.1 and first[0]["tmp_low"] == min(-5.0, min(r["tmp"] for r in window))
    assert {r["label"] for r in first} == {"before", "event", "after"} and sum(r["is_event"] for r in first) == 1
    sinks.write_panels(rows, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").rglob("part-*.parquet"))) == 2
    assert panels.series_panel(stressed, events).filter("is_event").count() == 2


# --- workbooks ---------------------------------------------------------------------------------

HEAD = '<?xml version="1.0"?><{0} xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'


def sheet(*rows):
    cell = lambda c: f'<c r="{c[0]}" t="s"><v>{c[1]}</v></c>' if isinstance(c[1], int) else f'<c r="{c[0]}" t="inlineStr"><is><t>{c[1]}</t></is></c>' if c[1][:1] != "=" else f'<c r="{c[0]}"><v>{c[1][1:]}</v></c>'
    return HEAD.format("worksheet") + "<sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>"


def book(path, shared, *sheets):
    with zipfile.ZipFile(path, "w") as z:
        if shared:
            z.writestr("xl/sharedStrings.xml", HEAD.format("sst") + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        for i, text in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", text)


def test_workbooks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    shared = ["GUID", "Tidspunkt for skred", "Notat", "No", "g-one"]
    first = sheet([("A1", 0), ("B1", 1), ("C1", 2), ("D1", 3)], [("A2", 4), ("B2", "=44257.604166666664"), ("D2", "7")], [("A3", "g-two"), ("B3", "03.02.2021"), ("AA3", "far")])
    second = sheet([("A1", "nothing")], [("A2", "here")])
    third = sheet([("A1", "SkredID"), ("B1", "guid"), ("C1", "tidspunkt")], [("A2", "s"), ("B2", "g-three"), ("C2", "05.06.2020 07:08")])
    book(tmp_path / "sub" / "A Beskrivelser 2021.XLSX", shared, first, second, third)
    book(tmp_path / "empty_beskrivelser.xlsx", [])
    book(tmp_path / "other.xlsx", [], third)
    (tmp_path / "broken_beskrivelser.xlsx").write_bytes(b"PK nonsense")
    book(tmp_path / "cut_beskrivelser.xlsx", [], third[: third.index("</sheetData>")] + "<row><c")
    raw = catalogue.read_workbooks(spark, str(tmp_path))
    rows = sorted((r["guid"], r["no"] or "", r["skred_id"] or "", str(r["event_time"])) for r in catalogue.clean(raw).collect())
    assert rows == [("g-one", "7", "", "2021-03-02 14:30:00"), ("g-three", "", "s", "2020-06-05 07:08:00"), ("g-three", "", "s", "2020-06-05 07:08:00"), ("g-two", "", "", "2021-02-03 00:00:00")]
    register(spark)
    cells_ = spark.read.format("workbook").option("name", "a beskrivelser").load(str(tmp_path)).filter("sheet like '%sheet1.xml' and row = 2").first()["cells"]
    assert len(cells_) == 27 and cells_[2] is None and cells_[26] == "far"
    assert spark.read.format("workbook").load(str(tmp_path)).rdd.getNumPartitions() == 5
    assert catalogue.read_workbooks(spark, str(tmp_path / "none")).count() == 0
