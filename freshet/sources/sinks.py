"""Writers of results."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_event(tables: DataFrame, path: str, keys: dict[str, Column], fmt: str = "parquet", order: str | None = None) -> None:
    """Folders named by ``keys`` (name: expression), one file in each.

    Rows are range-partitioned by the keys, so each folder is written by one task, and a task has
    the folders of neighbouring keys; without that every task would write a file into every folder.
    """
    named = tables.withColumns(keys)
    placed = named.repartitionByRange(*keys).sortWithinPartitions(*keys, *([order] if order else []))
    placed.write.mode("overwrite").partitionBy(*keys).option("header", "true").format(fmt).save(path)


def write_stress(tables: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Event tables in one folder and file per catchment and event number; events without a number stay apart by their time."""
    label = F.coalesce(F.col("No"), F.date_format("event_time", "yyyyMMddHH"))
    write_by_event(tables, path, {"guid_dir": F.col("GUID"), "no_dir": label}, fmt, "Datetime")


def write_panels(panels: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Panel datasets in one folder and file per catchment and event number."""
    label = F.coalesce(F.col("no"), F.date_format("event_ts", "yyyyMMddHH"))
    write_by_event(panels, path, {"guid_dir": F.col("guid"), "no_dir": label}, fmt, "ts")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Episodes, anchors or the feature dictionary."""
    df.write.mode("overwrite").option("header", "true").format(fmt).save(path)


def run_settings(spark: SparkSession, cfg) -> DataFrame:
    """(setting, value) of a configuration."""
    if not is_dataclass(cfg):
        raise ValueError("a dataclass is expected")
    return spark.createDataFrame([(k, str(v)) for k, v in asdict(cfg).items()], "setting string, value string")


def result_folders(input_dir: str) -> dict[str, str]:
    base = input_dir.rstrip("/") + "_results"
    return {"results": base, "plots": base + "/plots"}


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that spark.checkpoint.dir names and read back: plans and lineage end there.

    Lost executors take nothing with them, and nothing is held in memory.  Where the setting is
    absent and Spark runs on one machine it is set to a temporary folder; on a cluster it is
    asked for, as no folder of one machine would do.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
