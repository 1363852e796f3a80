"""Simulation and parameter files: discovery, reading and derived parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import num, ratio

#: Columns of a simulation file, by our names.
COLUMNS = {"pr": "Prec_mm", "tmp": "Temp_C", "q": "Q_m3s", "of": "Q_OF_m3s", "def": "SubsurfaceDef_P_mm", "gw": "GrwPlus_P_mm", "swe": "SWE_P_mm", "sm": "Soilmoist_P_mm"}


def discover(spark: SparkSession, root: str, kind: str, tr: str = "1H") -> DataFrame:
    """(guid, path) of the ``*_{tr}_{kind}.csv`` files under a folder, whatever the case of the suffix.

    Of several files of a catchment that with the last path counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", F.regexp_extract(name, rf"(?i)^(.*)_{tr}_{kind}\.csv$", 1).alias("guid")).filter("guid != ''")
    last = F.row_number().over(Window.partitionBy("guid").orderBy(F.desc("path")))
    return found.withColumn("_r", last).filter("_r = 1").select("guid", "path")


def _headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header, read on the executors from the first line of each."""
    lines = spark.read.text(paths).withColumn("_f", F.input_file_name()).groupBy("_f").agg(F.first("value").alias("h"))
    out: dict[tuple[str, ...], list[str]] = {}
    for f, h in lines.collect():
        out.setdefault(tuple(x.strip().strip('"') for x in h.split(";")), []).append(f)
    return out


def read_simulations(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The simulation table (guid, ts, pr, tmp, q, of, def, gw, swe, sm) of discovered files.

    Files are read one header layout at a time, as columns would be taken by position otherwise;
    missing columns are null, rows without a time go.
    """
    known = files.select("guid", "path").collect()  # one short row per catchment's file
    parts = []
    for header, paths in _headers(spark, [r["path"] for r in known]).items():
        raw = spark.read.option("sep", ";").option("header", "true").option("enforceSchema", "false").csv(paths)
        have = {c.strip(): c for c in raw.columns}
        cols = [num(F.col(f"`{have[c]}`")).alias(k) if c in have else F.lit(None).cast("double").alias(k) for k, c in COLUMNS.items()]
        name = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(?i)^(.*)_[^_]+_simres\.csv$", 1)
        parts.append(raw.select(name.alias("guid"), F.try_to_timestamp(F.col(f"`{have['Datetime']}`")).alias("ts"), *cols))
    if not parts:
        return spark.createDataFrame([], "guid string, ts timestamp, " + ", ".join(f"`{k}` double" for k in COLUMNS))
    return reduce(DataFrame.unionByName, parts).filter("ts is not null")


def read_parameters(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(guid, par, value) of discovered parameter files; of a repeated key the last line counts, text values go."""
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "guid string, par string, value double")
    lines = spark.read.text(paths).select(F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(?i)^(.*)_[^_]+_param\.csv$", 1).alias("guid"), "value", F.monotonically_increasing_id().alias("_i"))
    pairs = lines.select("guid", F.trim(F.split("value", ";")[0]).alias("par"), num(F.get(F.split("value", ";"), 1)).alias("value"), "_i").filter("value is not null and par != ''")
    return pairs.groupBy("guid", "par").agg(F.max_by("value", "_i").alias("value"))


#: Keys that derived parameters and episodes use.
KEYS = ("area_m2", "heightMin", "height10", "height90", "MRT", "meandailyT")


def wide_parameters(params: DataFrame, key: str = "guid", par: str = "par", value: str = "value", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per catchment with the used keys and, from them, area_km2 and the hypsometric index HI."""
    wide = params.groupBy(key).agg(*[F.max(F.when(F.col(par) == k, F.col(value))).alias(k) for k in keys])
    return wide.withColumns({"area_km2": F.col("area_m2") / 1e6, "HI": ratio(F.col("height10") - F.col("heightMin"), F.col("height90") - F.col("heightMin"))})
