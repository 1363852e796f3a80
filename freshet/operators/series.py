"""The long form of a simulation, and signals made from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, ratio

#: Variable codes of the wide simulation table.
VARIABLES = ("gw", "q", "sm", "of", "pr", "tmp", "swe")


def long_series(sim: DataFrame, variables: tuple[str, ...] = VARIABLES, key: str = "guid", ts: str = "ts") -> DataFrame:
    """(key, var, ts, x): one row per value that is there; values of equal times are averaged."""
    stacked = ", ".join(f"'{v}', `{v}`" for v in variables)
    rows = sim.filter(F.col(ts).isNotNull()).select(key, ts, *[finite(v).alias(v) for v in variables])
    out = rows.select(key, F.col(ts).alias("ts"), F.expr(f"stack({len(variables)}, {stacked}) as (var, x)")).filter("x is not null")
    return out.groupBy(key, "var", "ts").agg(F.avg("x").alias("x"))


def groundwater_signal(sim: DataFrame, mode: str = "gw", weight: float = 1.0, key: str = "guid", ts: str = "ts") -> DataFrame:
    """gw, or gw plus weighted soil moisture where both are there at the same time."""
    if mode not in ("gw", "gw_plus_sm"):
        raise ValueError(f"unknown groundwater signal {mode!r}")
    gw = sim.select(key, ts, "gw").filter("gw is not null").groupBy(key, ts).agg(F.avg("gw").alias("gw"))
    if mode == "gw":
        return gw.select(key, ts, F.col("gw").alias("x"))
    sm = sim.select(key, ts, "sm").filter("sm is not null").groupBy(key, ts).agg(F.avg("sm").alias("sm"))
    return gw.join(sm, [key, ts], "full_outer").select(key, ts, (F.col("gw") + F.lit(float(weight)) * F.col("sm")).alias("x"))


def runoff_depth(sim: DataFrame, params: DataFrame, key: str = "guid", ts: str = "ts") -> DataFrame:
    """Runoff in mm per hour from m3/s and the area; nothing without a valid area."""
    area = params.filter("area_km2 > 0").select(key, "area_km2")
    return sim.join(area, key).select(key, ts, ratio(F.col("q") * 3.6, "area_km2").alias("qmm"))
