"""Selections of fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def devices(ids: str | list[str]) -> Column:
    """Device in a list, or in a comma-separated text."""
    ids = [x.strip() for x in ids.split(",")] if isinstance(ids, str) else ids
    return F.col("device_id").isin(ids)


def _day(text: str) -> Column:
    text = text.strip()
    return F.to_timestamp(F.lit(text), "yyyyMMdd" if len(text) == 8 else "yyyy-MM-dd")


def between_days(dates: str) -> Column:
    """'from,to', both ends included as midnights; an empty text or a single date selects nothing."""
    ends = [x for x in dates.split(",") if x.strip()]
    return F.col("ts").between(_day(ends[0]), _day(ends[1])) if len(ends) == 2 else F.lit(False)


def tag(limits: str, column: str = "device_id") -> Column:
    """'lo,hi': ids whose number after the fifth character lies between (no number counts as 0), or that begin with a digit."""
    lo, hi = (int(x) for x in limits.split(","))
    number = F.coalesce(F.regexp_extract(F.substring(column, 6, 1 << 30), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    return number.between(lo, hi) | F.col(column).rlike("^[0-9]+")


def northeast() -> Column:
    return (F.col("latitude") > 0) & (F.col("longitude") > 0)


def several_fixes(points: DataFrame) -> DataFrame:
    """Fixes of device-days that have more than one."""
    w = Window.partitionBy("device_id", "day")
    return points.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n > 1").drop("_n")


def select_points(points: DataFrame, ids=None, dates: str | None = None, limits: str | None = None) -> DataFrame:
    """The load query: device, date and tag conditions, and positive coordinates; all of it reaches the scan."""
    out = points.filter(northeast())
    if ids:
        out = out.filter(devices(ids))
    if dates:
        out = out.filter(between_days(dates))
    return out.filter(tag(limits)) if limits else out
