"""Sources of GPS fixes: event tables, volunteer CSV and PLT files, JDBC, simulated tracks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import geo
from wayfold.functions.scalars import epoch_seconds

POINT = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("altitude", T.FloatType()),
        T.StructField("speed", T.FloatType()),
        T.StructField("data_type", T.IntegerType()),
        T.StructField("date", T.StringType()),
    ]
)
STAY = T.StructType([*POINT.fields[:3], T.StructField("arrive", T.LongType()), T.StructField("leave", T.LongType())])
VOLUNTEER = "geoTime long, latitude double, longitude double, altitude double, course double, horizontalAccuracy double, verticalAccuracy double, speed double, status string, activity string, network string, appStatus string, dayTime string"


def from_events(events: DataFrame) -> DataFrame:
    """Fixes derived from the event table: 20 devices in five crowds that move together by the hour."""
    g, hour, value = F.pmod("user_id", F.lit(20)), F.hour("ts"), F.col("value")
    return events.select(
        F.concat(F.lit("d"), F.lpad(g.cast("string"), 3, "0")).alias("device_id"),
        # thousandths are summed as integers, so that a position is what its decimals say, and lies on an edge that names them
        ((F.lit(23_100) + F.pmod(g, F.lit(5)) * 10 + F.pmod(hour, F.lit(5)) * 6) / 1000.0 + value * F.lit(1e-6)).alias("latitude"),
        ((F.lit(113_200) + F.pmod(g, F.lit(5)) * 15 + F.pmod(hour, F.lit(7)) * 8) / 1000.0 + value * F.lit(1e-6)).alias("longitude"),
        F.lit(0.0).cast("float").alias("altitude"),
        value.cast("float").alias("speed"),
        F.lit(0).alias("data_type"),
        "ts",
        F.to_date("ts").alias("day"),
        F.expr("unix_timestamp(date_trunc('second', ts))").alias("capturetime"),
        "event_id",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value"))


def volunteer_files(spark: SparkSession, path: str, loaded: DataFrame | None = None) -> DataFrame:
    """Fixes of all ``volunteers`` CSV files below ``path``; the device is the file's stem. Stems in ``loaded`` (device_id) are
    left out. A file with a line that can't be read gives no rows, and rows without a positive time are dropped."""
    raw = (
        spark.read.schema(f"{VOLUNTEER}, _broken string").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").csv(path)
    )
    raw = raw.withColumn("file", F.col("_metadata.file_path")).filter(F.col("file").contains("volunteers") & ~F.col("file").rlike(r"/~\$[^/]*$"))
    raw = raw.withColumn("device_id", F.regexp_extract("file", r"([^/]+)\.csv$", 1))
    # a line is broken if Spark says so, or if it lacks its time: the parser can't be asked for its verdict alone
    bad = raw.groupBy("file").agg(F.max(F.col("_broken").isNotNull() | F.col("geoTime").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull()).alias("bad")).filter("bad").select("file")
    good = raw.join(bad, "file", "left_anti").filter("geoTime > 0")
    if loaded is not None:
        good = good.join(loaded.select("device_id").distinct(), "device_id", "left_anti")
    return good.select(
        "device_id", "latitude", "longitude", F.col("altitude").cast("float").alias("altitude"), F.col("speed").cast("float").alias("speed"), F.lit(0).alias("data_type"), F.date_format(F.timestamp_millis("geoTime"), "yyyy-MM-dd HH:mm:ss").alias("date")
    )


def plt_files(spark: SparkSession, path: str, loaded: DataFrame | None = None) -> DataFrame:
    """Fixes of all ``geolife`` PLT files below ``path``: lines of seven fields; the device is the directory two above."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.plt").text(path)
    text = text.withColumn("file", F.col("_metadata.file_path")).filter(F.col("file").contains("geolife")).withColumn("f", F.split("value", ","))
    text = text.filter(F.size("f") == 7).withColumn("device_id", F.regexp_extract("file", r"([^/]+)/[^/]+/[^/]+$", 1))
    if loaded is not None:
        text = text.join(loaded.select("device_id").distinct(), "device_id", "left_anti")
    number = lambda k, kind: F.get("f", F.lit(k)).try_cast(kind)
    return text.select(
        "device_id", number(0, "double").alias("latitude"), number(1, "double").alias("longitude"), number(3, "float").alias("altitude"), F.lit(0.0).cast("float").alias("speed"), F.lit(0).alias("data_type"), F.concat_ws(" ", F.get("f", F.lit(5)), F.trim(F.get("f", F.lit(6)))).alias("date")
    )


def with_time(points: DataFrame, noon_quirk: bool = False) -> DataFrame:
    """ts, day and capturetime (seconds) from the text column ``date``."""
    seconds = epoch_seconds(F.col("date"), noon_quirk)
    return points.withColumn("capturetime", seconds).withColumn("ts", F.timestamp_seconds("capturetime")).withColumn("day", F.to_date(F.substring("date", 1, 10)))


def enriched(points: DataFrame, from_bd: bool = False, noon_quirk: bool = False) -> DataFrame:
    """``with_time``, and, with ``from_bd``, positions turned from BD-09 into GCJ-02."""
    timed = with_time(points, noon_quirk)
    if not from_bd:
        return timed
    lat, lng = geo.bd_to_gcj(F.col("latitude"), F.col("longitude"))
    return timed.withColumns({"latitude": lat, "longitude": lng})


@dataclass
class TrackSource:
    """Where fixes lie: a file format with a path, or ``jdbc``. Options go to the reader as they are; none has a default."""

    format: str = "parquet"
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return reader.load(self.path) if self.path else reader.load()

    @classmethod
    def configured(cls, spark: SparkSession, file: str | None = None, prefix: str = "wayfold.source.") -> "TrackSource":
        """A source from ``key=value`` lines of a file (comments begin with #), else from the session's settings under
        ``prefix``: format, path, and whatever else as an option. What neither names is an error; there are no defaults."""
        if file is not None:
            lines = (r["value"].strip() for r in spark.read.text(file).collect())  # a settings file
            found = {k.strip(): v.strip() for k, sep, v in (x.partition("=") for x in lines if x and not x.startswith("#")) if sep}
        else:
            found = {k[len(prefix) :]: v for k, v in spark.conf.getAll.items() if k.startswith(prefix)}
        if "format" not in found:
            raise ValueError(f"no source is configured: {prefix}format is missing")
        kind, path = found.pop("format"), found.pop("path", None)
        return cls(kind, path, found)

    def load_days(self, spark: SparkSession, days: list[str]) -> DataFrame:
        """Fixes of some days, a JDBC partition for each; other formats filter, which the scan takes over."""
        begins = [f"date >= '{d} 00:00:00' AND date <= '{d} 23:59:59'" for d in days]
        if self.format != "jdbc":
            return self.load(spark).filter(" OR ".join(f"({b})" for b in begins) or "false")
        rest = {k: v for k, v in self.options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(self.options["url"], self.options["dbtable"], predicates=begins, properties=rest)

    def save(self, points: DataFrame, mode: str = "append") -> None:
        writer = points.write.format(self.format).options(**self.options).mode(mode)
        writer.save(self.path) if self.path else writer.save()

    def devices(self, spark: SparkSession) -> DataFrame:
        return self.load(spark).select("device_id").distinct()

    def days(self, spark: SparkSession) -> DataFrame:
        return self.load(spark).select(F.substring(F.col("date").cast("string"), 1, 10).alias("day")).distinct().orderBy("day")


def simulated(spark: SparkSession, devices: int, start: str, end: str, per_day: int = 10, seed: int = 1) -> DataFrame:
    """``per_day`` random fixes a day in [start, end) for devices test_0 ...; all draws hang on ``seed``."""
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1)))
    base = spark.range(devices).select(F.concat(F.lit("test_"), F.col("id").cast("string")).alias("device_id"), days.alias("day"))
    base = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_day))))
    unit = lambda salt: F.pmod(F.xxhash64("device_id", "day", "k", F.lit(seed * 100 + salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    minute = F.floor(unit(5) * 1440).cast("int")
    return base.select(
        "device_id", (unit(1) * 55).alias("latitude"), (F.lit(70) + unit(2) * 66).alias("longitude"), (unit(3) * 10000).cast("float").alias("altitude"), (unit(4) * 100).cast("float").alias("speed"), F.lit(0).alias("data_type"),
        F.format_string("%s %02d:%02d:00", F.col("day").cast("string"), F.floor(minute / 60).cast("int"), minute % 60).alias("date"),
    )


def random_plates(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Random plates (a province symbol and seven letters or digits) and phone-like numbers, for tests of the codes."""
    from wayfold.functions.scalars import PLATE_SYMBOLS

    pick = lambda lo, size, salt: F.substring(F.lit(PLATE_SYMBOLS), lo + 1, size).substr(F.pmod(F.xxhash64("id", F.lit(seed * 1000 + salt)), F.lit(size)).cast("int") + 1, F.lit(1))
    digit = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed * 1000 + salt)), F.lit(10)).cast("string")
    second = (F.lit(3) + F.pmod(F.xxhash64("id", F.lit(seed * 1000 + 50)), F.lit(7))).cast("string")
    return spark.range(n).select("id", F.concat(pick(37, 31, 0), *[pick(1, 36, k) for k in range(1, 8)]).alias("plate"), F.concat(F.lit("1"), second, *[digit(60 + k) for k in range(9)]).alias("phone"))
