"""The event catalogue: workbooks or tables of landslide events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import num
from ..operators.stats import info_score
from .workbooks import register

#: Header tokens of the catalogue's columns; an exact name goes before a substring.
TOKENS = {"guid": ("guid",), "event_time": ("tidspunkt",), "no": ("no",), "skred_id": ("skredid",), "mean_annual_flood": ("middelflom", "mean annual flood")}


def find_column(header: list[str], tokens: tuple[str, ...]) -> int | None:
    low = [str(h or "").strip().lower() for h in header]
    for t in tokens:
        if t in low:
            return low.index(t)
    for t in tokens:
        for i, h in enumerate(low):
            if t in h:
                return i
    return None


def _as_time(text: Column) -> Column:
    """A serial day number of a workbook as a day-first date; other texts as they are."""
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), F.date_format(F.timestamp_seconds(F.round(text.try_cast("double") * 86_400).cast("long") - 2_209_161_600), "dd.MM.yyyy HH:mm:ss")).otherwise(text)


def read_workbooks(spark: SparkSession, root: str) -> DataFrame:
    """Raw events of every ``*beskrivelser*.xlsx`` under a folder, whatever the case of its name.

    A sheet's first row has its columns' names; sheets without GUID and time have no events.
    """
    register(spark)
    rows = spark.read.format("workbook").option("name", "beskrivelser").load(root)
    sheet = ["path", "sheet"]
    low = F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    head = rows.filter("row = 0").select(*sheet, low.alias("_names"))

    def place(tokens: tuple[str, ...]) -> Column:
        """An exact name goes before a substring, an earlier token before a later one."""
        exact = [F.array_position("_names", t) for t in tokens]
        inside = [F.array_position(F.transform("_names", lambda x: x.contains(t)), True) for t in tokens]  # noqa: B023
        return F.coalesce(*[F.when(p > 0, p) for p in [*exact, *inside]])

    at = head.select(*sheet, *[place(t).cast("int").alias(f"_{k}") for k, t in TOKENS.items()]).filter("_guid is not null and _event_time is not null")
    cells = rows.filter("row > 0").join(at, sheet)
    value = lambda k: F.try_element_at("cells", F.col(f"_{k}"))
    return cells.select(*[(_as_time(value(k)) if k == "event_time" else value(k)).alias(k) for k in TOKENS])


def clean(raw: DataFrame) -> DataFrame:
    """Typed events: trimmed GUID, day-first time, numeric flood; rows without GUID or time go."""
    text = F.trim(F.col("event_time").cast("string"))
    forms = ("dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    when = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])
    out = raw.select(F.trim(F.col("guid").cast("string")).alias("guid"), F.col("no").cast("string").alias("no"), F.col("skred_id").cast("string").alias("skred_id"), num("mean_annual_flood").alias("mean_annual_flood"), when.alias("event_time"))
    return out.filter("guid is not null and guid != '' and event_time is not null")


_INFO = ["no", "skred_id", "mean_annual_flood"]


def _ranked(events: DataFrame, order: list) -> DataFrame:
    return events.withColumn("_r", F.row_number().over(Window.partitionBy("guid", "skred_id").orderBy(F.desc(info_score(events, _INFO)), *order)))


def best_of_duplicates(events: DataFrame, *order: str) -> DataFrame:
    """Of events with the same GUID and SkredID (missing ones are equal) the most complete one; ties by ``order``."""
    return _ranked(events, list(order)).filter("_r = 1").drop("_r")


def duplicates(events: DataFrame) -> DataFrame:
    """All members of groups with the same GUID and SkredID."""
    n = F.count(F.lit(1)).over(Window.partitionBy("guid", "skred_id"))
    return events.withColumn("n_in_group", n).filter("n_in_group > 1")


def valid_events(events: DataFrame, simulations: DataFrame, parameters: DataFrame) -> DataFrame:
    """Events whose catchment has both files."""
    return events.join(simulations.select("guid"), "guid", "left_semi").join(parameters.select("guid"), "guid", "left_semi")
