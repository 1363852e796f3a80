"""Time-series operators against independent loops."""

import math
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.functions.exprs import num, step_count
from freshet.operators import asof, matching, peaks, stats, windows
from freshet.plans import stress
from freshet.sources import catalogue, simulation

T0 = datetime(2024, 1, 1)


def hours(spark, values, guid="a"):
    return spark.createDataFrame([(guid, T0 + timedelta(hours=i), v) for i, v in enumerate(values)], "guid string, ts timestamp, x double")


def test_numbers_with_commas(spark):
    rows = spark.createDataFrame([("1,5",), ("2.5",), ("1.0d",), ("NaN",), ("",), (None,), (" 3 ",), ("NA",)], "c string").select(num("c")).collect()
    assert [r[0] for r in rows] == [1.5, 2.5, None, None, None, None, 3.0, None]


def test_steps_round_half_to_even():
    assert [step_count(h, 1.0) for h in (2.5, 3.5, 0.2, 0)] == [2, 4, 1, 1]


def test_exponential_memory_is_the_recurrence(spark):
    random.seed(1)
    x = [None if random.random() < 0.1 else random.random() for _ in range(900)]
    got = windows.exp_memory(hours(spark, x), {"m": ("x", 0.05)}, 1.0).orderBy("ts").collect()
    m, r, worst = 0.0, math.exp(-(1 / 24) / 0.05), 0.0
    for row, v in zip(got, x):
        m = r * m + (v or 0.0) / 24
        worst = max(worst, abs(row["m"] - m))
    assert worst < 1e-12


def test_minmax_without_spread_and_without_values(spark):
    flat = hours(spark, [2.0, None, 2.0]).select(stats.robust_minmax("x", 0, 1)).collect()
    assert [r[0] for r in flat] == [0.0, 0.0, 0.0]
    none = hours(spark, [None, None]).select(stats.robust_minmax("x", 0, 1)).collect()
    assert [r[0] for r in none] == [None, None]


def test_nearest_takes_the_later_of_two(spark):
    s = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(hours=2), 2.0)], "guid string, ts timestamp, x double")
    p = spark.createDataFrame([("a", T0 + timedelta(minutes=m)) for m in (0, 50, 60, 70, 200)], "guid string, t timestamp")
    got = {r["t"]: r["near"] for r in asof.nearest(p, s, 3600, ["guid"]).collect()}
    assert [got[T0 + timedelta(minutes=m)] for m in (0, 50, 60, 70, 200)] == [1.0, 1.0, 2.0, 2.0, None]


def test_snap_takes_the_earlier_of_two(spark):
    s = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(hours=2), 2.0)], "guid string, ts timestamp, x double")
    p = spark.createDataFrame([("a", T0 + timedelta(hours=1, minutes=20))], "guid string, t timestamp")
    assert asof.snapped(p, s, ["guid"]).first()["t0"] == T0


def test_rank_of_values_outside_the_series(spark):
    ref = hours(spark, [-1.0, 1.0, 2.0, 2.0, None])
    p = spark.createDataFrame([("a", 2.0), ("a", 0.0), ("a", None), ("b", 1.0)], "guid string, p double")
    assert {r["p"]: r["rank"] for r in stats.rank_in(ref, p, ["guid"]).filter("guid = 'a'").collect()} == {2.0: 1.0, 0.0: 0.25, None: None}
    assert stats.rank_in(ref, p, ["guid"], sign=1).filter("p = 2").first()["rank"] == 1.0


def test_nearest_peak_and_slopes(spark):
    s = hours(spark, [1.0, 3.0, 3.0, 1.0, 5.0, 0.0])
    at = spark.createDataFrame([("a", T0 + timedelta(hours=2))], "guid string, t0 timestamp")
    p = peaks.nearest_peak(at, s, 2, 3, ["guid"]).first()
    assert (p["pk_t"], p["pk_0"]) == (0.0, 3.0)
    up = peaks.steepest(at.withColumn("t0", F.lit(T0 + timedelta(hours=5)).cast("timestamp")), s, 72, 0, 2, ["guid"]).first()
    assert (up["slope"], up["end_value"]) == (4.0, 5.0)
    empty = peaks.nearest_peak(at.withColumn("guid", F.lit("z")), s, 2, 3, ["guid"]).first()
    assert empty["pk_0"] is None


def _loop_greedy(rows, n, per_year, sep, tol):
    picks = []

    def free(t):
        return all(abs((t - u).total_seconds()) >= sep * 86400 for _, _, u in picks)

    def tier(d):
        return next((i for i, x in enumerate(tol, 1) if d <= x), len(tol) + 1)

    for k in range(1, len(tol) + 1):
        for y in sorted({t.year for _, t in rows}):
            if len(picks) >= n:
                continue
            took = 0
            for d, t in sorted(r for r in rows if tier(r[0]) == k and r[1].year == y):
                if took < per_year and free(t):
                    picks.append((k, d, t))
                    took += 1
    for k in range(1, len(tol) + 2):
        for d, t in sorted(r for r in rows if tier(r[0]) == k):
            if len(picks) < n and free(t):
                picks.append((k, d, t))
    return sorted(picks)[:n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_selection_is_the_loop(spark, seed):
    random.seed(seed)
    rows = [(round(random.random() * 0.5, 3), T0 + timedelta(days=random.randrange(1200))) for _ in range(250)]
    rows = list({t: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame([("a", t, d) for d, t in rows], "guid string, t_anchor timestamp, dist double")
    got = matching.greedy(df, 10, 2, 20, (0.05, 0.1, 0.2)).orderBy("rank").collect()
    assert [(r["tier"], r["dist"], r["t_anchor"]) for r in got] == _loop_greedy(rows, 10, 2, 20, (0.05, 0.1, 0.2))


def test_unknown_settings_are_refused(spark):
    with pytest.raises(ValueError):
        matching.distance(F.lit(1), F.lit(1), "other")
    with pytest.raises(ValueError):
        matching.controls(spark.createDataFrame([], "guid string"), "other")
    with pytest.raises(ValueError):
        stress.with_total(spark.createDataFrame([("a", 1.0)], "guid string, x double"), replace(stress.RUN, final_combine_mode="other"))


def test_duplicates_keep_the_most_complete(spark):
    e = spark.createDataFrame([("a", None, "1", None, 1), ("a", None, None, 2.0, 2), ("a", None, "3", 3.0, 3), ("a", "x", None, None, 4)], "guid string, skred_id string, no string, mean_annual_flood double, i int")
    assert {r["i"] for r in catalogue.best_of_duplicates(e, "i").collect()} == {3, 4}
    assert {r["i"] for r in catalogue.duplicates(e).collect()} == {1, 2, 3}


def test_catalogue_columns_and_times(spark):
    assert catalogue.find_column(["Notat", "No", "GUID "], ("no",)) == 1
    raw = spark.createDataFrame([(" g ", "03.02.2021 14:30", "1", None, "1,5"), ("g", "nonsense", "2", None, None), (None, "03.02.2021", None, None, None)], "guid string, event_time string, no string, skred_id string, mean_annual_flood string")
    rows = catalogue.clean(raw).collect()
    assert [(r["guid"], r["event_time"], r["mean_annual_flood"]) for r in rows] == [("g", datetime(2021, 2, 3, 14, 30), 1.5)]


def test_simulation_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A_1H_simres.csv").write_text("Datetime;Prec_mm;Temp_C\n2024-01-01 00:00:00;1,5;NA\nbad;1;1\n")
    (tmp_path / "sub" / "B_1H_SIMRES.csv").write_text("Temp_C;Datetime;GrwPlus_P_mm\n2;2024-01-01 01:00:00;7.5\n")
    (tmp_path / "A_1H_param.csv").write_text("area_m2;3570000.0\nheightMin;34\nheight10;169\nheight90;1002\nname;x\n")
    sims = simulation.read_simulations(spark, simulation.discover(spark, str(tmp_path), "simres")).orderBy("guid").collect()
    assert [(r["guid"], r["pr"], r["tmp"], r["gw"]) for r in sims] == [("A", 1.5, None, None), ("B", None, 2.0, 7.5)]
    p = simulation.wide_parameters(simulation.read_parameters(spark, simulation.discover(spark, str(tmp_path), "param"))).first()
    assert p["area_km2"] == 3.57 and abs(p["HI"] - 0.139463) < 1e-6


def test_steepest_ranks_its_end_in_the_window(spark):
    from freshet.operators import peaks

    x = [5.0, 1.0, 4.0, 4.0, 2.0, None, 9.0, 3.0]
    s = spark.createDataFrame([("a", T0 + timedelta(hours=i), v) for i, v in enumerate(x)], "guid string, ts timestamp, x double")
    at = spark.createDataFrame([("a", T0 + timedelta(hours=4))], "guid string, t0 timestamp")
    up, down = (peaks.steepest(at, s, 72, 0, 2, ["guid"], fall).first() for fall in (False, True))
    assert (up["end_value"], up["end_rank"], down["end_value"], down["end_rank"]) == (4.0, 0.8, 1.0, 0.2)


def test_legacy_rows_have_ranks_for_all_lags(spark):
    import inspect

    from freshet import queries
    from freshet.plans import episodes as ep

    assert "lags=" not in inspect.getsource(queries.QUERIES["episode_legacy"])
    s = spark.createDataFrame([("a", "gw", T0 + timedelta(hours=i), float(i % 5)) for i in range(12)], "guid string, var string, ts timestamp, x double")
    at = spark.createDataFrame([("a", T0 + timedelta(hours=6))], "guid string, t0 timestamp")
    names = {r["name"] for r in ep.legacy_features(at, s, lags=(3,)).select("name").distinct().collect()}
    assert {f"gw{k}3{side}{x}" for k in "mn" for side in "ab" for x in ("", "_t", "_0", "_q")} <= names


def test_negative_weight_is_refused(spark):
    c = spark.createDataFrame([], "guid string, t_anchor timestamp, gw double, q double, prsum double")
    e = spark.createDataFrame([], "guid string, event_ord int, gw_event double, q_event double, prsum_event double")
    with pytest.raises(ValueError):
        matching.distances(c, e, "value_pct", q_weight=-0.1)


def test_nearest_is_brute_force_across_cells(spark):
    rng = random.Random(3)
    points = {rng.randrange(0, 400_000): float(i) for i in range(120)}
    probes = [rng.randrange(-90_000, 500_000) for _ in range(150)]
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    series = spark.createDataFrame([("a", at(s), x) for s, x in points.items()] + [("b", at(0), 1.0)], "k string, ts timestamp, x double")
    got = asof.nearest(spark.createDataFrame([("a", i, at(s)) for i, s in enumerate(probes)], "k string, i int, t timestamp"), series, 1800, ["k"]).collect()
    assert len(got) == len(probes)
    for r in got:
        s = probes[r["i"]]
        best = min(points, key=lambda p: (abs(p - s), -p))
        assert r["near"] == (points[best] if abs(best - s) <= 1800 else None)


def test_equal_distances_by_seed(spark):
    rows = spark.createDataFrame([("a", datetime(2020, 1, 1) + timedelta(days=10 * i), 0.0) for i in range(20)], "guid string, t_anchor timestamp, dist double")
    pick = lambda seed: [r["t_anchor"] for r in matching.greedy(rows, 5, 5, 1, (0.1,), seed=seed).orderBy("t_anchor").collect()]
    assert pick(None) == [datetime(2020, 1, 1) + timedelta(days=10 * i) for i in range(5)]
    assert pick(1) == pick(1) and len({tuple(pick(s)) for s in (None, 1, 2)}) == 3
