"""Registered queries and their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SAMPLE = ["prec_stress", "robust_minmax", "nearest_at", "regular_sum", "nearest_peak", "match_distances", "controls_greedy", "controls_all3_quantile", "worst_matches", "pot_peaks", "matched_anchors", "catalogue_dedupe", "run_summary", "param_derived", "hysteresis_panel"]


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("customer", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = e.queries()[name](spark, SF).toPandas()
    want = con.execute(e.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["guid", "ts", "prec_stress"]
