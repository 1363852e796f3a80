"""The driver's tables seen as simulations, signals and event catalogues.

Amounts are summed as whole cents, so every engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catchment per event type, hourly, with gaps."""
    c = F.round(F.col("value") * 100).cast("long")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("guid"), F.date_trunc("HOUR", "ts").alias("ts"), c.alias("c"), "user_id")
    s = F.sum("c")
    return e.groupBy("guid", "ts").agg(
        (s / 100.0).alias("pr"),
        (F.min("c") % 400 / 100.0 - 1.0).alias("tmp"),
        F.count(F.lit(1)).cast("double").alias("q"),
        (F.sum(F.when(F.col("c") > 10000, F.col("c")).otherwise(F.lit(0))) / 100.0).alias("of"),
        ((F.lit(20000) + s % 1000) / 100.0).alias("def"),
        (F.max("c") / 100.0).alias("gw"),
        (F.sum("user_id") % 300 / 10.0).alias("swe"),
        (s % 10000 / 100.0).alias("sm"),
    )


HOURLY = """SELECT event_type AS guid, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(c) / 100.0::DOUBLE AS pr, (min(c) % 400) / 100.0::DOUBLE - 1.0::DOUBLE AS tmp,
 count(*)::DOUBLE AS q, sum(CASE WHEN c > 10000 THEN c ELSE 0 END)::BIGINT / 100.0::DOUBLE AS of_, (20000 + (sum(c) % 1000)::BIGINT) / 100.0::DOUBLE AS def,
 max(c) / 100.0::DOUBLE AS gw, (sum(user_id) % 300)::BIGINT / 10.0::DOUBLE AS swe, (sum(c) % 10000)::BIGINT / 100.0::DOUBLE AS sm
 FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1, 2"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catchment per order priority, daily over years: gw and q."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("guid"), F.date_trunc("DAY", "o_orderdate").alias("ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return o.groupBy("guid", "ts").agg((F.sum("c") / 100.0).alias("gw"), F.count(F.lit(1)).cast("double").alias("q"), (F.max("c") % 5000 / 100.0).alias("pr"))


DAILY = """SELECT o_orderpriority AS guid, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(c) / 100.0::DOUBLE AS gw, count(*)::DOUBLE AS q, (max(c) % 5000) / 100.0::DOUBLE AS pr
 FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY 1, 2"""


def yearly_events(days: DataFrame) -> DataFrame:
    """The day with the highest gw per catchment and year, numbered by time."""
    first = F.row_number().over(Window.partitionBy("guid", F.year("ts")).orderBy(F.desc("gw"), "ts"))
    top = days.withColumn("_r", first).filter("_r = 1")
    return top.select("guid", F.col("ts").alias("event_time"), (F.row_number().over(Window.partitionBy("guid").orderBy("ts")) - 1).alias("event_ord"))


YEARLY_EVENTS = """SELECT guid, ts AS event_time, CAST(row_number() OVER (PARTITION BY guid ORDER BY ts) - 1 AS INT) AS event_ord
 FROM (SELECT *, row_number() OVER (PARTITION BY guid, year(ts) ORDER BY gw DESC, ts) AS r FROM daily) WHERE r = 1"""


def probes(hours: DataFrame) -> DataFrame:
    """Anchors: all hours with more rain than nine tenths of the catchment's hours."""
    heavy = F.percentile("pr", F.lit(0.9)).over(Window.partitionBy("guid"))
    return hours.withColumn("_q", heavy).filter("pr > _q").select("guid", F.col("ts").alias("t0"))


PROBES = "SELECT guid, ts AS t0 FROM (SELECT guid, ts, pr, quantile_cont(pr, 0.9) OVER (PARTITION BY guid) AS heavy FROM hourly) WHERE pr > heavy"


def sql(body: str, *ctes: tuple[str, str], recursive: bool = False, held: bool = False) -> str:
    """A query with the named views before it; ``held``: each is computed once."""
    known = {"hourly": HOURLY, "daily": DAILY, "yearly": YEARLY_EVENTS, "probes": PROBES}
    text = " ".join([body, *[x for _, x in ctes]])
    own = {n for n, _ in ctes}
    need = [n for n in known if n not in own and (n in text or (n == "daily" and "yearly" in text) or (n == "hourly" and "probes" in text))]
    keep = "MATERIALIZED " if held else ""
    parts = [f"{n} AS {keep}({known[n]})" for n in need] + [f"{n} AS {keep}({x})" for n, x in ctes]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
