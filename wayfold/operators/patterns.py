"""Patterns: devices that move together, days that a device repeats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import lsh, trajectory


def group_patterns(points: DataFrame, min_distance: float = 2000.0, min_cells: int = 5, span: int = 120, level: int = 16) -> DataFrame:
    """Pairs of devices whose tracks of a day share a band, with their days: one job over all days."""
    vectors = trajectory.all_vectors(points, min_distance, min_cells, span, level).withColumnRenamed("device_id", "id")
    return lsh.pair_report(lsh.lsh_pairs(vectors, "day"))


def analyse(points: DataFrame, kind: int, **how) -> DataFrame:
    """The entry by number: 0 finds devices that move together, 1 the days that each device repeats."""
    if kind not in (0, 1):
        raise ValueError("0 (groups) or 1 (repeated days)")
    if kind == 0:
        return group_patterns(points, **how)
    return personal_patterns(trajectory.all_vectors(points, **how))


def merge_sets(groups: list[set]) -> list[set]:
    """Unions of the sets that hang together by common elements."""
    out: list[set] = []
    for g in groups:
        near = [x for x in out if x & g]
        out = [x for x in out if not x & g] + [set(g).union(*near)]
    return out


def merge_dates(pairs: DataFrame, key: str = "device_id") -> DataFrame:
    """Groups of days of each device that hang together by pairs (key, a, b): key, members. A device has at most a few
    thousand days, so its pairs are merged in one task."""
    schema = f"{key} {dict(pairs.dtypes)[key]}, members array<string>"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = merge_sets([{str(a), str(b)} for a, b in zip(pdf["a"], pdf["b"], strict=True)])
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "members": [sorted(x) for x in found]})

    return pairs.select(key, "a", "b").groupBy(key).applyInPandas(merge, schema)


def repeated_days(groups: DataFrame, vectors: DataFrame, least: float = 0.4, neighbours: int = 2, days: int = 3) -> DataFrame:
    """Days of a device with at least ``neighbours`` similar days in their group, where at least ``days`` such remain:
    device_id, day, degree."""
    exact = lsh.jaccard_pairs(vectors.select("device_id", F.col("day").cast("string").alias("id"), "codes"), "device_id", least)
    both = exact.select("device_id", F.col("a").alias("day"), F.col("b").alias("other")).unionByName(exact.select("device_id", F.col("b").alias("day"), F.col("a").alias("other")))
    placed = groups.withColumn("g", F.monotonically_increasing_id()).select("device_id", "g", F.explode("members").alias("day"))
    inside = both.join(placed, ["device_id", "day"]).join(placed.select("device_id", "g", F.col("day").alias("other")), ["device_id", "g", "other"])
    degree = inside.groupBy("device_id", "g", "day").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") >= neighbours)
    enough = degree.groupBy("device_id", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= days).select("device_id", "g")
    return degree.join(enough, ["device_id", "g"], "left_semi").select("device_id", "day", "degree")


def personal_patterns(vectors: DataFrame, hashes: int = lsh.PERSONAL[0], bands: int = lsh.PERSONAL[1]) -> DataFrame:
    """Repeated days of each device, from vectors (device_id, day, codes)."""
    named = vectors.select("device_id", F.col("day").cast("string").alias("id"), "codes")
    return repeated_days(merge_dates(lsh.lsh_pairs(named, "device_id", hashes, bands)), vectors)
