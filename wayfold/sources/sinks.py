"""Sinks: tables, text files, HTML maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "track_event": "device_id STRING, latitude DOUBLE, longitude DOUBLE, altitude DOUBLE, speed DOUBLE, data_type INT, date STRING",
    "compressed_track": "device_id STRING, capturetime BIGINT, latitude DOUBLE, longitude DOUBLE, s2cell BIGINT, pointtype INT",
    "track_user": "user_id BIGINT, name STRING, device_id STRING",
}


def init_tables(spark: SparkSession) -> None:
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def clear_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def write_compressed(points: DataFrame, path: str, truncate: bool = False) -> None:
    """Compressed fixes as Parquet; ``truncate`` replaces what is there."""
    columns = ["device_id", "capturetime", "latitude", "longitude", F.col("cell").alias("s2cell"), F.col("data_type").alias("pointtype")]
    points.select(*columns).write.mode("overwrite" if truncate else "append").parquet(path)


def write_text(lines: DataFrame, path: str) -> None:
    """One text file with a line for each row of the first column, in their order; for reports, which are small."""
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_track_text(raw: DataFrame, quantised: DataFrame, codes: DataFrame, path: str) -> None:
    """Three comma-separated texts below ``path``: fixes, (slot, cell) pairs, codes."""
    raw.select(F.concat_ws(",", "device_id", "capturetime", "longitude", "latitude")).write.mode("overwrite").text(f"{path}/raw")
    quantised.select(F.concat_ws(",", "device_id", "slot", "cell")).write.mode("overwrite").text(f"{path}/space_time")
    codes.select(F.concat_ws(",", "device_id", "code")).write.mode("overwrite").text(f"{path}/codes")


def merge_text(spark: SparkSession, source: str, target: str) -> None:
    """All files below ``source`` as one text."""
    spark.read.option("recursiveFileLookup", True).text(source).coalesce(1).write.mode("overwrite").text(target)


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet/dist/leaflet.css"/><script src="https://unpkg.com/leaflet/dist/leaflet.js"></script>
</head><body><div id="map" style="height:100vh"></div><script>
var map = L.map("map").setView([{lat:.7f}, {lng:.7f}], 13);
L.tileLayer("https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png").addTo(map);
L.polyline({line}).addTo(map);
{markers}
</script></body></html>
"""


def track_html(track: DataFrame, title: str = "track") -> str:
    """A map of one track (latitude, longitude, capturetime): line, a dot for each fix, start red, end green, view at the
    spherical centroid. The rows pass through the driver one by one."""
    from wayfold.functions.geo import centroid

    a, b = centroid(F.col("latitude"), F.col("longitude"))
    middle = track.agg(a.alias("lat"), b.alias("lng")).first()
    line = [[r["latitude"], r["longitude"]] for r in track.select("latitude", "longitude", "capturetime").orderBy("capturetime", "latitude", "longitude").toLocalIterator()]
    colours = ["#3388ff"] * len(line)
    if line:
        colours[-1], colours[0] = "green", "red"
    dots = "\n".join(f'L.circleMarker({p}, {{color: "{c}", radius: 4}}).addTo(map);' for p, c in zip(line, colours, strict=True))
    return _PAGE.format(title=title, lat=middle["lat"] or 0.0, lng=middle["lng"] or 0.0, line=line, markers=dots)
