"""Datasets behind the diagnostic panels.

``event_panels`` is the batch runner: one plan gives every event's rows for all of its panels, with
the panels' limits beside them, and ``sinks.write_by_event`` writes it clustered by event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_greatest, step_count

#: Variables of the panels, and the stress index with its components.
VARIABLES = ("pr", "tmp", "q", "of", "gw", "sm", "swe")
STRESSES = ("stress_total", "stress_base", "stress_grad", "stress_prec", "stress_swe", "stress_of")
EVENT = ["guid", "no", "event_ts"]


def row_window(series: DataFrame, events: DataFrame, before_steps: int, after_steps: int, key: str = "guid", ts: str = "ts", at: str = "event_ts") -> DataFrame:
    """Rows from some before to some after each event's row, with their offset in rows."""
    numbered = series.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ts)))
    e = events.select(F.col(key).alias("_k"), F.col(at).alias("_at"))
    centre = numbered.join(e, (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_at"))).select("_k", "_at", F.col("_n").alias("_c"))
    spread = centre.select("_k", "_at", "_c", F.explode(F.sequence(F.col("_c") - before_steps, F.col("_c") + after_steps)).alias("_m"))
    out = numbered.join(spread, (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("_m")))
    return out.select(*series.columns, F.col("_at").alias(at), (F.col("_n") - F.col("_c")).alias("offset"))


def event_window(series: DataFrame, events: DataFrame, dt_hours: float, hours_before: float = 48, hours_after: float = 12, **names) -> DataFrame:
    return row_window(series, events, step_count(hours_before, dt_hours), step_count(hours_after, dt_hours), **names)


def hysteresis(series: DataFrame, events: DataFrame, dt_hours: float, hours_before: float = 48, hours_after: float = 72, key: str = "guid", ts: str = "ts", at: str = "event_ts") -> DataFrame:
    """Pairs of q and gw on the way to an event and from it; the event's row is in both."""
    rows = row_window(series, events, step_count(hours_before, dt_hours), step_count(hours_after, dt_hours), key, ts, at)
    labels = F.when(F.col("offset") < 0, F.array(F.lit("before"))).when(F.col("offset") > 0, F.array(F.lit("after"))).otherwise(F.array(F.lit("before"), F.lit("event"), F.lit("after")))
    return rows.select(key, at, ts, "q", "gw", F.explode(labels).alias("label"))


def axis_limits(df: DataFrame, columns: list[str], key: list[str], margin: float = 1.1) -> DataFrame:
    """Upper limits with a margin, per group and column."""
    return df.groupBy(*key).agg(*[(F.max(c) * margin).alias(f"{c}_limit") for c in columns])


def series_panel(stressed: DataFrame, events: DataFrame) -> DataFrame:
    """Every event's whole series of gw and stress, with its marker, the capacity and the axis' limit.

    ``stressed`` is the stress plan's output; ``events`` has guid, no and event_ts, a row's time.
    """
    limit = F.max("gw").over(Window.partitionBy("guid")) * 1.1
    full = stressed.select("guid", "ts", "gw", "stress_total", "cap", F.coalesce(limit, F.lit(1.0)).alias("gw_limit"))
    return full.join(events.select(*EVENT), "guid").select(*EVENT, "ts", "gw", "stress_total", "cap", "gw_limit", (F.col("ts") == F.col("event_ts")).alias("is_event"))


def event_panels(stressed: DataFrame, events: DataFrame, dt_hours: float, hours_before: float = 48, hours_after: float = 12, post_hyst_hours: float = 72) -> DataFrame:
    """Rows around each event for all of its panels: variables, stress and components, hysteresis labels, markers and axis limits.

    ``in_window`` marks the rows of the time panels; ``label`` says for the hysteresis of q and gw
    whether a row is on the way to the event or from it (the event's row is in both).  Limits are
    those of the rows that a panel shows.
    """
    before, after, post = (step_count(x, dt_hours) for x in (hours_before, hours_after, post_hyst_hours))
    numbered = stressed.select("guid", "ts", *VARIABLES, *STRESSES, "cap").withColumn("_n", F.row_number().over(Window.partitionBy("guid").orderBy("ts")))
    centre = events.select(*EVENT).join(numbered.select("guid", F.col("ts").alias("event_ts"), F.col("_n").alias("_c")), ["guid", "event_ts"])
    spread = centre.select(*EVENT, "_c", F.explode(F.sequence(F.col("_c") - before, F.col("_c") + max(after, post))).alias("_n"))
    offset = F.col("_n") - F.col("_c")
    rows = spread.join(numbered, ["guid", "_n"]).withColumn("offset", offset)
    rows = rows.withColumns({"in_window": F.col("offset") <= after, "is_event": F.col("offset") == 0, "_hyst": F.col("offset") <= post})
    rows = rows.withColumn("label", F.when(~F.col("_hyst"), F.lit(None)).when(F.col("offset") < 0, "before").when(F.col("offset") > 0, "after").otherwise("event"))
    w = Window.partitionBy(*EVENT)
    top = lambda c, where="in_window": F.max(F.when(F.col(where), F.col(c))).over(w)
    low = lambda c, where="in_window": F.min(F.when(F.col(where), F.col(c))).over(w)
    positive = lambda x, share: F.when(x > 0, x * share).otherwise(F.lit(1.0))
    limits = {
        "pr_limit": F.coalesce(top("pr") * 1.1, F.lit(1.0)), "tmp_low": F.least(F.lit(-5.0), F.coalesce(low("tmp"), F.lit(-5.0))), "tmp_high": F.coalesce(top("tmp"), F.lit(5.0)) * 1.1,
        "q_limit": positive(top("q"), 1.05), "gw_limit": F.col("cap") * 1.2, **{f"{v}_limit": positive(top(v), 1.1) for v in ("sm", "swe", "of")},
        "hyst_q_low": low("q", "_hyst"), "hyst_q_high": top("q", "_hyst"), "hyst_gw_limit": F.coalesce(all_greatest(top("gw", "_hyst"), F.col("cap") * 1.2), top("gw", "_hyst")),
    }
    return rows.select(*EVENT, "ts", F.col("offset").cast("int").alias("offset"), "is_event", "in_window", "label", *VARIABLES, *STRESSES, "cap", *[x.alias(n) for n, x in limits.items()])
