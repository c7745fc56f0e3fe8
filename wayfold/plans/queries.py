"""The registered queries over the driver tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import cells, geo, rects, scalars
from wayfold.operators import cluster, filters, graphs, lsh, patterns, spatial, trajectory
from wayfold.sources.tracks import points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SPAN, LEVEL = 3600, 14  # the tables are sparse: an hour to a slot, cells of about 600 m

# Fixed values of the curve, as in functions.cells: place of quadrant 2i+j by orientation, and turns.
_CURVE = "[0,1,3,2,0,3,1,2,2,3,1,0,2,1,3,0]"
_POINTS = """p AS (
  SELECT 'd' || lpad(CAST(user_id % 20 AS VARCHAR), 3, '0') AS device_id,
    23.10 + ((user_id % 20) % 5) * 0.010 + (hour(ts) % 5) * 0.006 + value * 1e-6 AS latitude,
    113.20 + ((user_id % 20) % 5) * 0.015 + (hour(ts) % 7) * 0.008 + value * 1e-6 AS longitude,
    CAST(value AS FLOAT) AS speed, ts, CAST(ts AS DATE) AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS capturetime, event_id
  FROM (SELECT event_id, ts, user_id, value::DOUBLE AS value FROM events))"""
_XYZ = """x AS (SELECT *, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z FROM p)"""


def _hav(a: str, b: str, c: str, d: str, r: str = "6371000.0") -> str:
    h = f"(sin((radians({c}) - radians({a})) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin((radians({d}) - radians({b})) / 2) ** 2)"
    return f"(2 * {r} * atan2(sqrt({h}), sqrt(1 - {h})))"


def _cells(level: int) -> str:
    """CTE c: p with the cell of ``level``; the curve is walked by a recursion over its bits. Faces 0 to 3 only."""
    return f"""
{_XYZ},
uv AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM x),
uw AS (SELECT *, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
  CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM uv),
st AS (SELECT *, floor(1073741824 * CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END)::BIGINT AS i, floor(1073741824 * CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END)::BIGINT AS j FROM uw),
walk AS (
  SELECT event_id, i, j, 29 AS k, face::BIGINT AS id, face & 1 AS o FROM st
  UNION ALL
  SELECT event_id, i, j, k - 1, id * 4 + {_CURVE}[o * 4 + 2 * ((i >> k) & 1) + ((j >> k) & 1) + 1], xor(o, [1,0,0,3][{_CURVE}[o * 4 + 2 * ((i >> k) & 1) + ((j >> k) & 1) + 1] + 1])::INT
  FROM walk WHERE k > 29 - {level}),
c AS (SELECT p.*, (2 * id + 1) * (1::BIGINT << {2 * (30 - level)}) AS cell FROM p JOIN (SELECT event_id, id FROM walk WHERE k = 29 - {level}) USING (event_id))"""


_CODE = f"(cell // (1::BIGINT << 61)) * (1::BIGINT << 61) + ((capturetime - epoch(day)::BIGINT) // {SPAN}) * (1::BIGINT << 45) + (cell % (1::BIGINT << 61)) // 65536"
_VECTORS = f"""v AS (SELECT DISTINCT day, device_id AS id, {_CODE} AS code FROM c)"""


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query; dates leave both engines as text, which has one form everywhere."""

    def add(f):
        def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c, k in out.dtypes if k == "date"})

        QUERIES[f.__name__] = plain
        if sql:
            ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return add


def _with(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"


# ---------------------------------------------------------------- loading and selection


@query(_with(_POINTS, select="SELECT device_id, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, capturetime, day FROM p"), dates=("day",))
def load_points(spark, d):
    return points(spark, d).select("device_id", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "capturetime", "day")


@query("SELECT c_custkey, c_name FROM customer WHERE (coalesce(TRY_CAST(nullif(regexp_extract(substr(c_name, 6), '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) BETWEEN 0 AND 0) OR regexp_matches(c_name, '^[0-9]+')")
def filter_tag(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name").filter(filters.tag("0,0", "c_name"))


@query(_with(_POINTS, select="SELECT device_id, capturetime FROM p WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08' AND latitude > 0 AND longitude > 0 AND device_id IN ('d001', 'd002', 'd007')"))
def filter_date(spark, d):
    return filters.select_points(points(spark, d), "d001,d002, d007", "20240105, 2024-01-08").select("device_id", "capturetime")


@query(_with(_POINTS, select="SELECT DISTINCT day FROM p"), dates=("day",))
def distinct_days(spark, d):
    return points(spark, d).select("day").distinct()


@query(_with(_POINTS, select="SELECT DISTINCT device_id FROM p"))
def distinct_devices(spark, d):
    return points(spark, d).select("device_id").distinct()


@query(_with(_POINTS, select="SELECT device_id, capturetime, event_id FROM (SELECT *, count(*) OVER (PARTITION BY device_id, day) AS n FROM p) WHERE n > 1"))
def several_fixes(spark, d):
    return filters.several_fixes(points(spark, d)).select("device_id", "capturetime", "event_id")


@query(_with(_POINTS, select="SELECT day, lead(day) OVER (ORDER BY day) AS next_day FROM (SELECT DISTINCT day FROM p) QUALIFY next_day IS NOT NULL"), dates=("day", "next_day"))
def day_pairs(spark, d):
    return trajectory.day_pairs(points(spark, d))


@query("SELECT o_orderkey, NOT (l < o OR c < s) AS meets FROM (SELECT o_orderkey, o_orderdate AS o, o_orderdate + INTERVAL 30 DAY AS l, DATE '1995-03-01' AS s, DATE '1995-06-01' AS c FROM orders)".replace("NOT (l < o OR c < s)", "NOT (l < s OR c < o)"))
def interval_meets(spark, d):
    o = F.col("o_orderdate").cast("date")
    meets = scalars.intervals_meet(o, F.date_add(o, 30), F.lit("1995-03-01").cast("date"), F.lit("1995-06-01").cast("date"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", meets.alias("meets"))


# ---------------------------------------------------------------- geometry of positions


@query(_with(_POINTS, select=f"SELECT device_id, event_id, round({_hav('a', 'b', 'latitude', 'longitude')}, 4) AS step FROM (SELECT *, lag(latitude) OVER w AS a, lag(longitude) OVER w AS b FROM p WINDOW w AS (PARTITION BY device_id, day ORDER BY capturetime, event_id)) WHERE a IS NOT NULL"))
def haversine_step(spark, d):
    w = Window.partitionBy("device_id", "day").orderBy("capturetime", "event_id")
    p = points(spark, d).withColumn("a", F.lag("latitude").over(w)).withColumn("b", F.lag("longitude").over(w)).filter("a is not null")
    return p.select("device_id", "event_id", F.round(geo.haversine(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude")), 4).alias("step"))


_PI = "pi()"
_GCJ = f"""g AS (SELECT *, longitude - 105.0 AS dx, latitude - 35.0 AS dy FROM p),
w AS (SELECT *, (20 * sin(6 * dx * {_PI}) + 20 * sin(2 * dx * {_PI})) * 2 / 3 AS rip, 1 - 0.00669342162296594323 * sin(radians(latitude)) ** 2 AS m FROM g),
j AS (SELECT *, -100.0 + 2 * dx + 3 * dy + 0.2 * dy * dy + 0.1 * dx * dy + 0.2 * sqrt(abs(dx)) + rip + (20 * sin(dy * {_PI}) + 40 * sin(dy / 3 * {_PI})) * 2 / 3 + (160 * sin(dy / 12 * {_PI}) + 320 * sin(dy * {_PI} / 30)) * 2 / 3 AS ul,
  300.0 + dx + 2 * dy + 0.1 * dx * dx + 0.1 * dx * dy + 0.1 * sqrt(abs(dx)) + rip + (20 * sin(dx * {_PI}) + 40 * sin(dx / 3 * {_PI})) * 2 / 3 + (150 * sin(dx / 12 * {_PI}) + 300 * sin(dx / 30 * {_PI})) * 2 / 3 AS ur FROM w),
gcj AS (SELECT *, latitude + ul * 180 / (6378245.0 * (1 - 0.00669342162296594323) / (m * sqrt(m)) * {_PI}) AS glat, longitude + ur * 180 / (6378245.0 / sqrt(m) * cos(radians(latitude)) * {_PI}) AS glng FROM j)"""


@query(_with(_POINTS, _GCJ, select="SELECT event_id, round(glat, 6) AS lat, round(glng, 6) AS lng FROM gcj"))
def wgs_to_gcj(spark, d):
    a, b = geo.wgs_to_gcj(F.col("latitude"), F.col("longitude"))
    return points(spark, d).select("event_id", F.round(a, 6).alias("lat"), F.round(b, 6).alias("lng"))


@query(_with(_POINTS, _GCJ, select="SELECT event_id, round(2 * latitude - glat, 6) AS lat, round(2 * longitude - glng, 6) AS lng FROM gcj"))
def gcj_to_wgs(spark, d):
    a, b = geo.gcj_to_wgs(F.col("latitude"), F.col("longitude"))
    return points(spark, d).select("event_id", F.round(a, 6).alias("lat"), F.round(b, 6).alias("lng"))


_BD = "pi() * 3000 / 180"


@query(_with(_POINTS, select=f"SELECT event_id, round(r * sin(t) + 0.006, 6) AS lat, round(r * cos(t) + 0.0065, 6) AS lng FROM (SELECT event_id, sqrt(longitude * longitude + latitude * latitude) + 0.00002 * sin(latitude * {_BD}) AS r, atan2(latitude, longitude) + 0.000003 * cos(longitude * {_BD}) AS t FROM p)"))
def gcj_to_bd(spark, d):
    a, b = geo.gcj_to_bd(F.col("latitude"), F.col("longitude"))
    return points(spark, d).select("event_id", F.round(a, 6).alias("lat"), F.round(b, 6).alias("lng"))


@query(_with(_POINTS, select=f"SELECT event_id, round(r * sin(t), 6) AS lat, round(r * cos(t), 6) AS lng FROM (SELECT event_id, sqrt(x * x + y * y) - 0.00002 * sin(y * {_BD}) AS r, atan2(y, x) - 0.000003 * cos(x * {_BD}) AS t FROM (SELECT event_id, longitude - 0.0065 AS x, latitude - 0.006 AS y FROM p))"))
def bd_to_gcj(spark, d):
    a, b = geo.bd_to_gcj(F.col("latitude"), F.col("longitude"))
    return points(spark, d).select("event_id", F.round(a, 6).alias("lat"), F.round(b, 6).alias("lng"))


@query(_with(_POINTS, _XYZ, select=f"SELECT device_id, day, ((capturetime - epoch(day)::BIGINT) // {SPAN})::INT AS slot, round(degrees(atan2(avg(z), sqrt(avg(x) ** 2 + avg(y) ** 2))), 6) AS lat, round(degrees(atan2(avg(y), avg(x))), 6) AS lng, min(capturetime) AS first FROM x GROUP BY ALL"), dates=("day",))
def slot_centroid(spark, d):
    a, b = geo.centroid(F.col("latitude"), F.col("longitude"))
    slot = scalars.time_slot(F.col("capturetime"), F.col("day"), SPAN)
    return points(spark, d).groupBy("device_id", "day", slot.alias("slot")).agg(F.round(a, 6).alias("lat"), F.round(b, 6).alias("lng"), F.min("capturetime").alias("first"))


@query(_with(_POINTS, select=f"SELECT a.device_id, a.day, round(max({_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}), 4) AS diameter FROM p a JOIN p b ON a.device_id = b.device_id AND a.day = b.day GROUP BY 1, 2"), dates=("day",))
def diameter(spark, d):
    return trajectory.diameter(points(spark, d)).select("device_id", "day", F.round("diameter", 4).alias("diameter"))


@query(_with(_POINTS, select=f"""SELECT a.device_id, a.day, count(DISTINCT a.event_id)::INT AS n, round(coalesce(avg(h) FILTER (WHERE a.event_id < b.event_id), 0), 4) AS mean, round(coalesce(var_pop(h) FILTER (WHERE a.event_id < b.event_id), 0), 2) AS variance
FROM p a JOIN p b ON a.device_id = b.device_id AND a.day = b.day, LATERAL (SELECT {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS h) GROUP BY 1, 2"""), dates=("day",))
def pairwise_distance(spark, d):
    return trajectory.average_distance(points(spark, d), ["device_id", "day"]).select("device_id", "day", "n", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


@query(_with(_POINTS, f"t AS (SELECT *, ((capturetime - epoch(day)::BIGINT) // {4 * SPAN})::INT AS slot FROM p)",
             f"d AS (SELECT a.device_id, a.day, a.slot, a.event_id, a.event_id < b.event_id AS half, {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS h FROM t a JOIN t b ON a.device_id = b.device_id AND a.day = b.day AND a.slot = b.slot)",
             "m AS (SELECT device_id, day, slot, avg(h) FILTER (WHERE half) AS mean, var_pop(h) FILTER (WHERE half) AS v FROM d GROUP BY ALL)", "e AS (SELECT device_id, day, slot, event_id, avg(h) AS own FROM d GROUP BY ALL)",
             select="SELECT t.device_id, t.day, t.slot, capturetime FROM e JOIN m USING (device_id, day, slot) JOIN t USING (event_id) WHERE own <= 50 OR v IS NULL OR v <= 20 OR abs(own - mean) <= 2.0 * sqrt(v)"), dates=("day",))
def two_sigma_filter(spark, d):
    return trajectory.two_sigma(points(spark, d), 4 * SPAN).select("device_id", "day", "slot", "capturetime")


@query(_with(_POINTS, select="SELECT device_id, day, round(min(latitude), 6) AS lat_lo, round(max(latitude), 6) AS lat_hi, round(min(longitude), 6) AS lng_lo, round(max(longitude), 6) AS lng_hi FROM p GROUP BY ALL"), dates=("day",))
def track_bounds(spark, d):
    b = spatial.bounds(points(spark, d), ["device_id", "day"])
    return b.select("device_id", "day", *[F.round(c, 6).alias(c) for c in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")])


@query(_with(_POINTS, select=f"SELECT device_id, day, round(coalesce(sum({_hav('a', 'b', 'latitude', 'longitude')}), 0), 3) AS length FROM (SELECT *, lag(latitude) OVER w AS a, lag(longitude) OVER w AS b FROM p WINDOW w AS (PARTITION BY device_id, day ORDER BY capturetime, latitude, longitude)) GROUP BY ALL"), dates=("day",))
def track_length(spark, d):
    return spatial.track_lengths(points(spark, d), ["device_id", "day"]).select("device_id", "day", F.round("length", 3).alias("length"))


@query(_with(_POINTS, select="SELECT event_id FROM p WHERE latitude BETWEEN 23.11 AND 23.13 AND longitude BETWEEN 113.22 AND 113.26"))
def point_in_rect(spark, d):
    return points(spark, d).filter(spatial.in_rect(F.col("latitude"), F.col("longitude"), 23.11, 23.13, 113.22, 113.26)).select("event_id")


@query(_with(_POINTS, select=f"SELECT event_id FROM p WHERE {_hav('latitude', 'longitude', '23.12', '113.24')} <= 1500"))
def point_in_cap(spark, d):
    return points(spark, d).filter(spatial.in_cap(F.col("latitude"), F.col("longitude"), 23.12, 113.24, 1500.0)).select("event_id")


# ---------------------------------------------------------------- cells and codes


@query(_with(_POINTS, _cells(16), select="SELECT event_id, cell FROM c", recursive=True))
def cell_level16(spark, d):
    return points(spark, d).select("event_id", cells.cell_id(F.col("latitude"), F.col("longitude"), 16).alias("cell"))


@query(_with(_POINTS, _cells(30), select="SELECT event_id, cell AS leaf, ((cell // (1::BIGINT << 38)) * 2 + 1) * (1::BIGINT << 36) AS parent12, 30 AS level FROM c".replace("((cell // (1::BIGINT << 38)) * 2 + 1) * (1::BIGINT << 36)", "(cell // (1::BIGINT << 37)) * (1::BIGINT << 37) + (1::BIGINT << 36)"), recursive=True))
def cell_parent(spark, d):
    c = points(spark, d).select("event_id", cells.cell_id(F.col("latitude"), F.col("longitude")).alias("leaf"))
    return c.select("event_id", "leaf", cells.parent(F.col("leaf"), 12).alias("parent12"), cells.level_of(F.col("leaf")).alias("level"))


@query(_with(_POINTS, _cells(16), select="SELECT event_id, rtrim(lpad(lower(to_hex(cell)), 16, '0'), '0') AS token, cell - ((1::BIGINT << 28) - 1) AS range_min, cell + ((1::BIGINT << 28) - 1) AS range_max, (cell >> 61)::INT AS face FROM c", recursive=True))
def cell_token(spark, d):
    c = points(spark, d).select("event_id", cells.cell_id(F.col("latitude"), F.col("longitude"), 16).alias("c"))
    return c.select("event_id", cells.token(F.col("c")).alias("token"), cells.range_min(F.col("c")).alias("range_min"), cells.range_max(F.col("c")).alias("range_max"), cells.face_of(F.col("c")).alias("face"))


@query(_with(_POINTS, _cells(LEVEL), select=f"SELECT event_id, {_CODE} AS code FROM c", recursive=True))
def st_code_pack(spark, d):
    code = cells.encode(scalars.time_slot(F.col("capturetime"), F.col("day"), SPAN), cells.cell_id(F.col("latitude"), F.col("longitude"), LEVEL))
    return points(spark, d).select("event_id", code.alias("code"))


@query(_with(_POINTS, _cells(LEVEL), select=f"SELECT event_id, (capturetime - epoch(day)::BIGINT) // {SPAN} AS slot, cell, ((capturetime - epoch(day)::BIGINT) // {SPAN}) || '|' || cell AS text FROM c", recursive=True))
def st_code_decode(spark, d):
    c = F.col("code")
    return st_code_pack(spark, d).select("event_id", cells.code_slot(c).alias("slot"), cells.code_cell(c).alias("cell"), cells.code_text(c).alias("text"))


@query(_with(_POINTS, _cells(16), select="SELECT device_id, day, count(DISTINCT cell) AS cells FROM c GROUP BY ALL", recursive=True), dates=("day",))
def distinct_cells(spark, d):
    return points(spark, d).groupBy("device_id", "day").agg(F.count_distinct(cells.cell_id(F.col("latitude"), F.col("longitude"), 16)).alias("cells"))


@query(_with(_POINTS, _cells(16), f"f AS (SELECT a.device_id, a.day, max({_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) AS far FROM p a JOIN p b ON a.device_id = b.device_id AND a.day = b.day GROUP BY 1, 2)", "k AS (SELECT device_id, day, count(DISTINCT cell) AS n, count(*) AS fixes FROM c GROUP BY ALL)",
             select="SELECT device_id, day FROM f JOIN k USING (device_id, day) WHERE far >= 3500 AND n >= 8 AND fixes > 1", recursive=True), dates=("day",))
def movement_filter(spark, d):
    return trajectory.moving(points(spark, d), 3500.0, 8, 16)


@query(_with(_POINTS, _XYZ.replace("x AS (SELECT *,", "x0 AS (SELECT *,"), _cells(15).replace(_XYZ + ",", _XYZ + ","), select=f"SELECT c.device_id, c.day, ((c.capturetime - epoch(c.day)::BIGINT) // {SPAN})::INT AS slot, cell, round(degrees(atan2(avg(z), sqrt(avg(x) ** 2 + avg(y) ** 2))), 6) AS lat, min(c.capturetime) AS first FROM c JOIN x0 USING (event_id) GROUP BY ALL", recursive=True), dates=("day",))
def slot_cells(spark, d):
    a, _ = geo.centroid(F.col("latitude"), F.col("longitude"))
    slot = scalars.time_slot(F.col("capturetime"), F.col("day"), SPAN)
    return points(spark, d).groupBy("device_id", "day", slot.alias("slot"), cells.cell_id(F.col("latitude"), F.col("longitude"), 15).alias("cell")).agg(F.round(a, 6).alias("lat"), F.min("capturetime").alias("first"))


_CENTRES = f"""ce AS (SELECT *, ((i >> {30 - LEVEL}) + 0.5) / (1 << {LEVEL}) AS s, ((j >> {30 - LEVEL}) + 0.5) / (1 << {LEVEL}) AS t FROM st),
cu AS (SELECT *, CASE WHEN s >= 0.5 THEN (4 * s * s - 1) / 3 ELSE (1 - 4 * (1 - s) * (1 - s)) / 3 END AS a, CASE WHEN t >= 0.5 THEN (4 * t * t - 1) / 3 ELSE (1 - 4 * (1 - t) * (1 - t)) / 3 END AS b FROM ce),
cx AS (SELECT device_id, day, capturetime, CASE face WHEN 0 THEN 1 WHEN 1 THEN -a WHEN 2 THEN -a ELSE -1 END AS cx, CASE face WHEN 0 THEN a WHEN 1 THEN 1 WHEN 2 THEN -b ELSE -b END AS cy, CASE face WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN 1 ELSE -a END AS cz FROM cu)"""


@query(_with(_POINTS, _cells(LEVEL), _CENTRES, select=f"SELECT DISTINCT device_id, day, capturetime - (capturetime - epoch(day)::BIGINT) % {SPAN} AS capturetime, round(degrees(atan2(cz, sqrt(cx * cx + cy * cy))), 6) AS latitude, round(degrees(atan2(cy, cx)), 6) AS longitude, 2 AS data_type FROM cx", recursive=True), dates=("day",))
def decode_codes(spark, d):
    v = trajectory.grid_vectors(points(spark, d), SPAN, LEVEL)
    out = trajectory.decode(v, SPAN)
    return out.select("device_id", "day", "capturetime", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "data_type")


# ---------------------------------------------------------------- tracks


@query()
def purify(spark, d):
    return trajectory.purify(points(spark, d))


@query()
def cluster_points(spark, d):
    return trajectory.cluster_quantised(points(spark, d), SPAN)


@query()
def grid_quantise(spark, d):
    return trajectory.grid_quantised(points(spark, d), SPAN, 15)


@query()
def quantise_ratio(spark, d):
    return trajectory.grid_reduction(points(spark, d), SPAN, 15)


@query()
def track_vectors(spark, d):
    return trajectory.track_vectors(points(spark, d), SPAN, LEVEL)


@query()
def track_similarity(spark, d):
    p = points(spark, d)
    return trajectory.similarity(p, trajectory.grid_quantised(p, SPAN, 15), SPAN, LEVEL)


@query()
def compression(spark, d):
    return trajectory.compression(points(spark, d), SPAN, LEVEL)


@query()
def period_summary(spark, d):
    return trajectory.summary(trajectory.compression(points(spark, d), SPAN, LEVEL), ((1, 1, 15, "Jan 1-15"), (1, 16, 31, "Jan 16-31")))


@query("""SELECT CASE WHEN day(o_orderdate) <= 15 THEN CASE WHEN month(o_orderdate) = 7 THEN 'Jul 1-15' ELSE 'Aug 1-15' END ELSE CASE WHEN month(o_orderdate) = 7 THEN 'Jul 16-31' ELSE 'Aug 16-31' END END AS period, count(*) AS tracks
FROM orders WHERE month(o_orderdate) IN (7, 8) GROUP BY 1""")
def period_filter(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(scalars.period(F.col("o_orderdate")).alias("period")).filter("period is not null").groupBy("period").agg(F.count(F.lit(1)).alias("tracks"))


# ---------------------------------------------------------------- similarity and patterns


def _vectors(spark, d):
    return trajectory.grid_vectors(points(spark, d), SPAN, LEVEL).withColumnRenamed("device_id", "id")


_HASHES, _BANDS = lsh.GROUP
_FAMILY = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(lsh.family(_HASHES)))
_DENSE = """n AS (SELECT day, code, row_number() OVER (PARTITION BY day ORDER BY code) - 1 AS x FROM (SELECT DISTINCT day, code FROM v)),
q AS (SELECT day, count(*) AS k FROM n GROUP BY 1),
pr AS (SELECT day, (SELECT min(m) FROM range(2, 3000) r(m) WHERE m > k AND NOT EXISTS (SELECT 1 FROM range(2, 60) s(t) WHERE t * t <= m AND m % t = 0)) AS p FROM q)"""
_SIGNED = f"h(i, a, b) AS (VALUES {_FAMILY}), sg AS (SELECT v.day, v.id, h.i, min(((h.a % (p - 1) + 1) * x + h.b % p) % p) AS s FROM v JOIN n USING (day, code) JOIN pr USING (day), h GROUP BY ALL)"
_BUCKETS = f"""bk AS (SELECT day, id, i % {_BANDS} AS band, string_agg(s::VARCHAR, '-' ORDER BY i) AS bucket FROM sg GROUP BY ALL),
ml AS (SELECT day, band, bucket, string_agg(id, ',' ORDER BY id) AS members FROM bk GROUP BY ALL HAVING count(*) >= 2)"""
_LSH_PAIRS = "lp AS (SELECT DISTINCT x.day, x.id AS a, y.id AS b FROM bk x JOIN bk y ON x.day = y.day AND x.band = y.band AND x.bucket = y.bucket AND x.id < y.id)"
_JACCARD = "sz AS (SELECT day, id, count(*) AS n FROM v GROUP BY ALL), jp AS (SELECT x.day, x.id AS a, y.id AS b, count(*) AS k FROM v x JOIN v y ON x.day = y.day AND x.code = y.code AND x.id < y.id GROUP BY ALL), jq AS (SELECT jp.day, a, b, k / (s.n + t.n - k) AS similarity FROM jp JOIN sz s ON s.day = jp.day AND s.id = a JOIN sz t ON t.day = jp.day AND t.id = b)"


@query(_with(_POINTS, _cells(LEVEL), _VECTORS, _DENSE, _SIGNED, select="SELECT day, id, string_agg(s::VARCHAR, ',' ORDER BY i) AS signature FROM sg GROUP BY ALL", recursive=True), dates=("day",))
def minhash_signatures(spark, d):
    return lsh.signatures(lsh.dense_codes(_vectors(spark, d), "day"), _HASHES).select("day", "id", F.array_join(F.transform("sig", lambda s: s.cast("string")), ",").alias("signature"))


@query(_with(_POINTS, _cells(LEVEL), _VECTORS, _DENSE, _SIGNED, _BUCKETS, select="SELECT day, band::INT AS band, members FROM ml", recursive=True), dates=("day",))
def lsh_buckets(spark, d):
    s = lsh.signatures(lsh.dense_codes(_vectors(spark, d), "day"), _HASHES)
    return lsh.buckets(s, "day", _BANDS).select("day", "band", F.array_join("members", ",").alias("members"))


@query(_with(_POINTS, _cells(LEVEL), _VECTORS, _DENSE, _SIGNED, _BUCKETS, _LSH_PAIRS, select="SELECT day, a, b FROM lp", recursive=True), dates=("day",))
def lsh_pairs(spark, d):
    return lsh.lsh_pairs(_vectors(spark, d)).select("day", "a", "b").distinct()


@query(_with(_POINTS, _cells(LEVEL), _VECTORS, _JACCARD, select="SELECT day, a, b, round(similarity, 6) AS similarity FROM jq WHERE similarity >= 0.4", recursive=True), dates=("day",))
def jaccard_pairs(spark, d):
    return lsh.jaccard_pairs(_vectors(spark, d)).select("day", "a", "b", F.round("similarity", 6).alias("similarity"))


@query(_with(_POINTS, _cells(LEVEL), _VECTORS, _DENSE, _SIGNED, _BUCKETS, _LSH_PAIRS, _JACCARD, select="""SELECT day, a, b, round(max(similarity), 6) AS similarity, string_agg(DISTINCT t, '#' ORDER BY t DESC) AS label FROM (
  SELECT day, a, b, NULL AS similarity, 'LSH' AS t FROM lp UNION ALL SELECT day, a, b, similarity, 'JACCARD' FROM jq WHERE similarity >= 0.4) GROUP BY ALL""", recursive=True), dates=("day",))
def lsh_vs_jaccard(spark, d):
    v = _vectors(spark, d)
    return lsh.hits_against_exact(lsh.lsh_pairs(v), lsh.jaccard_pairs(v)).select("day", "a", "b", F.round("similarity", 6).alias("similarity"), "label")


@query(_with(_POINTS, _cells(LEVEL), _VECTORS, _DENSE, _SIGNED, _BUCKETS, _LSH_PAIRS, select="SELECT a, b, count(*) AS hits, string_agg(day::VARCHAR, '#' ORDER BY day) AS days FROM lp GROUP BY ALL", recursive=True))
def pair_report(spark, d):
    return lsh.pair_report(lsh.lsh_pairs(_vectors(spark, d)))


@query()
def group_patterns(spark, d):
    return patterns.group_patterns(points(spark, d), 2000.0, 5, SPAN, LEVEL)


_PFAMILY = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(lsh.family(lsh.PERSONAL[0])))
_DAY_PAIRS = f"""v AS (SELECT DISTINCT device_id AS day, day::VARCHAR AS id, {_CODE} AS code FROM c), {_DENSE},
{_SIGNED.replace(_FAMILY, _PFAMILY)}, {_BUCKETS.replace(f"i % {_BANDS} ", f"i % {lsh.PERSONAL[1]} ")}, {_LSH_PAIRS}"""


@query(_with(_POINTS, _cells(LEVEL), _DAY_PAIRS, "u AS (SELECT day, a, b FROM lp UNION SELECT day, b, a FROM lp)", "r AS (SELECT day, a, b FROM u UNION SELECT r.day, r.a, u.b FROM r JOIN u ON u.day = r.day AND u.a = r.b)",
             select="SELECT DISTINCT device_id, members FROM (SELECT day AS device_id, a, string_agg(b, ',' ORDER BY b) AS members FROM r GROUP BY ALL)", recursive=True))
def date_merge(spark, d):
    v = trajectory.grid_vectors(points(spark, d), SPAN, LEVEL).select("device_id", F.col("day").cast("string").alias("id"), "codes")
    return patterns.merge_dates(lsh.lsh_pairs(v, "device_id", *lsh.PERSONAL)).select("device_id", F.array_join("members", ",").alias("members"))


_LONG_SLOTS = _DAY_PAIRS.replace(f"// {SPAN})", f"// {4 * SPAN})")


@query(_with(_POINTS, _cells(12), _LONG_SLOTS, _JACCARD, "u AS (SELECT day, a, b FROM lp UNION SELECT day, b, a FROM lp)", "r AS (SELECT day, a, b FROM u UNION SELECT r.day, r.a, u.b FROM r JOIN u ON u.day = r.day AND u.a = r.b)",
             "gr AS (SELECT day, a, min(b) AS g FROM r GROUP BY ALL)", "js AS (SELECT day, a, b FROM jq WHERE similarity >= 0.4 UNION ALL SELECT day, b, a FROM jq WHERE similarity >= 0.4)",
             "dg AS (SELECT js.day, js.a, x.g, count(*) AS degree FROM js JOIN gr x ON x.day = js.day AND x.a = js.a JOIN gr y ON y.day = js.day AND y.a = js.b AND y.g = x.g GROUP BY ALL HAVING count(*) >= 2)",
             select="SELECT day AS device_id, a AS day, degree FROM dg QUALIFY count(*) OVER (PARTITION BY day, g) >= 3", recursive=True))
def personal_patterns(spark, d):
    return patterns.personal_patterns(trajectory.grid_vectors(points(spark, d), 4 * SPAN, 12))


# ---------------------------------------------------------------- scalars


@query("SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(upper(substr(c_mktsegment, 1, 6)), ''), lambda c: (strpos('#ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', c) - 1)::BIGINT)), lambda a, x: a * 70 + x) AS number, upper(substr(c_mktsegment, 1, 6)) AS back FROM customer")
def base70(spark, d):
    text = F.upper(F.substring("c_mktsegment", 1, 6))
    out = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", scalars.base70(text).alias("number"))
    return out.withColumn("back", scalars.base70_text(F.col("number")))


@query("SELECT o_orderkey, CASE WHEN k = 0 THEN 1 WHEN length(s) >= 7 THEN 999 WHEN length(s) >= 3 THEN substr(s, 1, 3)::INT ELSE k::INT END AS top, (CASE WHEN k = 0 OR length(s) < 3 THEN 0 WHEN length(s) >= 7 THEN 3 ELSE length(s) - 3 END)::INT AS magnitude FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS k, floor(o_totalprice)::BIGINT::VARCHAR AS s FROM orders)")
def digit_info(spark, d):
    i = scalars.digit_info(F.floor("o_totalprice").cast("long"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", i.alias("i")).select("o_orderkey", "i.top", "i.magnitude")


@query("SELECT l_orderkey, l_linenumber, (((l_partkey % 1000) << 18) | ((l_suppkey % 100) << 11) | ((CASE WHEN strpos('ABCDE', upper(l_returnflag)) > 0 THEN strpos('ABCDE', upper(l_returnflag)) - 1 ELSE 5 END) << 8) | floor(ln(l_quantity) / ln(3.0) + 1e-12)::INT)::INT AS bits FROM lineitem")
def feature_bits(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    bits = scalars.feature_bits((F.col("l_partkey") % 1000).cast("int"), (F.col("l_suppkey") % 100).cast("int"), F.col("l_returnflag"), F.pow(F.lit(3.0), scalars.log3(F.col("l_quantity").cast("double")) + 1e-12))
    return t.select("l_orderkey", "l_linenumber", bits.alias("bits"))


@query("SELECT s, round(1 - (1 - s ** 4) ** 27, 6) AS p27, round(1 - (1 - s ** 4) ** 65, 6) AS p65 FROM (SELECT k / 100.0::DOUBLE AS s FROM range(0, 101) r(k))")
def lsh_prob_curve(spark, d):
    s = spark.range(101).select((F.col("id") / F.lit(100.0)).alias("s"))
    return s.select("s", F.round(scalars.hit_chance(F.col("s"), 4, 27), 6).alias("p27"), F.round(scalars.hit_chance(F.col("s"), 4, 65), 6).alias("p65"))


@query("SELECT event_id, k AS day, epoch(strptime(t, '%Y-%m-%d %H:%M:%S'))::BIGINT AS seconds, epoch(strptime(t, '%Y-%m-%d %H:%M:%S'))::BIGINT - CASE WHEN substr(t, 12, 2) = '12' THEN 43200 ELSE 0 END AS noon FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 1, 10) AS k FROM events)")
def date_text(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return t.select("event_id", scalars.day_key(F.col("t")).alias("day"), scalars.epoch_seconds(F.col("t")).alias("seconds"), scalars.epoch_seconds(F.col("t"), True).alias("noon"))


@query("SELECT o_orderkey, CASE WHEN k >= 0 THEN 2 * k ELSE -2 * k - 1 END AS z, (1 + floor(ln(greatest(CASE WHEN k >= 0 THEN 2 * k ELSE -2 * k - 1 END, 1)) / ln(128) + 1e-9))::INT AS size FROM (SELECT o_orderkey, (o_custkey - 500)::BIGINT AS k FROM orders)")
def integer_codes(spark, d):
    k = (F.col("o_custkey") - 500).cast("long")
    z = scalars.zigzag(k)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", z.alias("z"), scalars.varint_size(z).alias("size"))


# ---------------------------------------------------------------- clusters and graphs


def _features(spark, d):
    """A customer's set of parts and order months, as features."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", (F.col("l_partkey") % 1000).cast("int").alias("f"))
    return t.groupBy(F.col("l_suppkey").cast("long").alias("idx")).agg(F.sort_array(F.collect_set("f")).alias("features"))


_FEATURES = "ft AS (SELECT DISTINCT l_suppkey::BIGINT AS idx, (l_partkey % 1000)::INT AS f FROM lineitem), fs AS (SELECT idx, count(*) AS n FROM ft GROUP BY 1), fp AS (SELECT x.idx AS a, y.idx AS b, count(*) AS k FROM ft x JOIN ft y ON x.f = y.f AND x.idx <> y.idx GROUP BY ALL), fj AS (SELECT a, b, k / (s.n + t.n - k) AS similarity FROM fp JOIN fs s ON s.idx = a JOIN fs t ON t.idx = b)"


@query(_with(_FEATURES, select="SELECT a, b, round(similarity, 6) AS similarity FROM fj WHERE similarity >= 0.04"))
def feature_pairs(spark, d):
    return cluster.similar(_features(spark, d), 0.04).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_with(_FEATURES, select="SELECT a AS idx, max(d) AS eps FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS rn FROM (SELECT a, round(1 - similarity, 5) AS d FROM fj) WHERE d > 0 AND d < 1) WHERE rn <= 5 GROUP BY 1"))
def eps_heuristic(spark, d):
    return cluster.eps_heuristic(_features(spark, d)).select("idx", F.round("eps", 5).alias("eps"))


def _markets(spark, d):
    """A customer's nation with segment, and nation with size of account: they cluster by nation."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    size = F.floor(F.col("c_acctbal").cast("double") / 5000).cast("int")
    return c.select(F.col("c_custkey").cast("long").alias("idx"), F.array((F.col("c_nationkey") * 100 + F.ascii("c_mktsegment")).cast("int"), (F.lit(10_000) + F.col("c_nationkey") * 100 + size).cast("int")).alias("features"))


_MARKETS = _FEATURES.replace("SELECT DISTINCT l_suppkey::BIGINT AS idx, (l_partkey % 1000)::INT AS f FROM lineitem", "SELECT c_custkey::BIGINT AS idx, (c_nationkey * 100 + ascii(c_mktsegment))::INT AS f FROM customer UNION ALL SELECT c_custkey::BIGINT, (10000 + c_nationkey * 100 + floor(c_acctbal::DOUBLE / 5000))::INT FROM customer")
_CLUSTERS = """near AS (SELECT a, b FROM fj WHERE similarity >= 0.3), core AS (SELECT a AS idx FROM near GROUP BY 1 HAVING count(*) >= 3),
rr AS (SELECT idx, idx AS c FROM core UNION SELECT n.b AS idx, rr.c FROM rr JOIN near n ON n.a = rr.idx JOIN core k ON k.idx = n.b), lb AS (SELECT idx, min(c) AS cluster_id FROM rr GROUP BY 1),
cl AS (SELECT idx, cluster_id FROM lb UNION ALL SELECT n.b, min(lb.cluster_id) FROM near n JOIN lb ON lb.idx = n.a WHERE n.b NOT IN (SELECT idx FROM core) GROUP BY 1)"""


@query(_with(_MARKETS, _CLUSTERS, select="SELECT idx, cluster_id FROM cl", recursive=True))
def dbscan(spark, d):
    return cluster.dbscan(_markets(spark, d), 0.3, 3)


@query()
def dbscan_onehop(spark, d):
    return cluster.dbscan(_features(spark, d), 0.05, 3, transitive=False)


@query(_with(_MARKETS, _CLUSTERS, "ds AS (SELECT x.idx, x.cluster_id AS own, y.cluster_id AS other, avg(1 - coalesce(fj.similarity, 0)) AS m FROM cl x JOIN cl y ON x.idx <> y.idx LEFT JOIN fj ON fj.a = x.idx AND fj.b = y.idx GROUP BY ALL)",
             "xy AS (SELECT cl.idx, min(m) FILTER (WHERE own = other) AS x, min(m) FILTER (WHERE own <> other) AS y FROM cl LEFT JOIN ds USING (idx) GROUP BY 1)", select="SELECT idx, round(CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE (y - x) / nullif(greatest(x, y), 0) END, 6) AS coefficient FROM xy", recursive=True))
def silhouette(spark, d):
    f = _markets(spark, d)
    return cluster.silhouette(f, cluster.dbscan(f, 0.3, 3)).select("idx", F.round("coefficient", 6).alias("coefficient"))


def _edges(spark, d):
    """Nations are linked by the orders of their customers from their suppliers' region, weighed by counts."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").cast("int").alias("r"))
    a, b = n.alias("a"), n.alias("b")
    near = a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.k") < F.col("b.k"))).select(F.col("a.k").alias("src"), F.col("b.k").alias("dst"))
    ring = n.select(F.col("k").alias("src"), ((F.col("k") + 7) % 25).cast("int").alias("dst")).filter("src < dst")
    return near.unionByName(ring).distinct().withColumn("weight", ((F.col("src") * 7 + F.col("dst") * 3) % 11 + 1).cast("double"))


_EDGES = """e0 AS (SELECT DISTINCT src, dst FROM (SELECT a.n_nationkey::INT AS src, b.n_nationkey::INT AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
  UNION ALL SELECT n_nationkey::INT, ((n_nationkey + 7) % 25)::INT FROM nation WHERE n_nationkey < (n_nationkey + 7) % 25)), e AS (SELECT src, dst, ((src * 7 + dst * 3) % 11 + 1)::DOUBLE AS weight FROM e0),
u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""


@query(_with(_EDGES, "r AS (SELECT 0 AS vertex, 0 AS depth UNION SELECT u.dst, depth + 1 FROM r JOIN u ON u.src = r.vertex WHERE depth < 8)", select="SELECT vertex::INT AS vertex, min(depth)::INT AS depth FROM r GROUP BY 1", recursive=True))
def bfs(spark, d):
    return graphs.bfs(graphs.undirected(_edges(spark, d)).distinct().coalesce(1), 0)


@query(_with(_EDGES, "r AS (SELECT 0 AS vertex, 0.0::DOUBLE AS distance, 0 AS k UNION SELECT vertex, min(distance), k FROM (SELECT u.dst AS vertex, distance + weight AS distance, k + 1 AS k FROM r JOIN u ON u.src = r.vertex WHERE k < 12) GROUP BY vertex, k)".replace("UNION SELECT vertex, min(distance), k FROM (SELECT", "UNION SELECT vertex, distance, k FROM (SELECT").replace(" GROUP BY vertex, k)", ")"), select="SELECT vertex::INT AS vertex, min(distance) AS distance FROM r GROUP BY 1", recursive=True))
def shortest_path(spark, d):
    return graphs.shortest_paths(graphs.undirected(_edges(spark, d)).distinct().coalesce(1), 0)


@query(ORACLE["shortest_path"])
def distances_by_graph(spark, d):
    both = graphs.undirected(_edges(spark, d)).withColumn("graph", F.lit(1))
    return graphs.distances(both, 0).select("vertex", "distance")


@query(_with(_EDGES, "r AS (SELECT 0 AS vertex UNION SELECT u.dst FROM r JOIN u ON u.src = r.vertex)", select="SELECT vertex::INT AS vertex, true AS once FROM r", recursive=True))
def depth_first(spark, d):
    """Each vertex once; the order itself is held against a model in the tests."""
    both = graphs.undirected(_edges(spark, d)).withColumn("graph", F.lit(1))
    return graphs.depth_first_orders(both, 0).groupBy("vertex").agg((F.count(F.lit(1)) == 1).alias("once"))


_BEFORE = "(u.weight < r.weight OR u.weight = r.weight AND (least(u.src, u.dst) < r.src OR least(u.src, u.dst) = r.src AND greatest(u.src, u.dst) < r.dst))"
_FOREST = _with(_EDGES, f"r AS (SELECT src, dst, weight, src AS at FROM e UNION SELECT r.src, r.dst, r.weight, u.dst AS at FROM r JOIN u ON u.src = r.at AND {_BEFORE})", select="SELECT src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = e.src AND r.dst = e.dst AND r.at = e.dst)", recursive=True)


@query(_FOREST)
def spanning_tree(spark, d):
    return graphs.minimum_spanning_forest(_edges(spark, d).coalesce(1))


@query(_FOREST)
def spanning_trees_by_graph(spark, d):
    return graphs.spanning_trees(_edges(spark, d).withColumn("graph", F.lit(1))).select("src", "dst", "weight")


# ---------------------------------------------------------------- spatial joins


_SITES = "sites AS (SELECT * FROM (VALUES (1, 23.11, 113.21), (2, 23.12, 113.24), (3, 23.14, 113.27)) t(query_id, qa, qb))"


@query(_with(_POINTS, _SITES, select=f"SELECT query_id, rank, point_id, round(distance, 4) AS distance FROM (SELECT query_id, event_id AS point_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, event_id)::INT AS rank FROM (SELECT *, {_hav('qa', 'qb', 'latitude', 'longitude')} AS distance FROM sites, p) WHERE distance <= 2000) WHERE rank <= 10"))
def knn(spark, d):
    sites = spark.createDataFrame([(1, 23.11, 113.21), (2, 23.12, 113.24), (3, 23.14, 113.27)], "id int, latitude double, longitude double")
    return spatial.nearest(sites, points(spark, d).withColumnRenamed("event_id", "id"), 10, 2000.0).withColumn("distance", F.round("distance", 4))


@query(_with(_POINTS, _cells(13), "bx AS (SELECT DISTINCT device_id, cell FROM c WHERE day < DATE '2024-01-04'), by_ AS (SELECT DISTINCT device_id, cell FROM c WHERE day >= DATE '2024-01-28')", select="SELECT DISTINCT bx.device_id AS a_id, by_.device_id AS b_id FROM bx JOIN by_ USING (cell)", recursive=True))
def range_join(spark, d):
    c = points(spark, d).select(F.col("device_id").alias("id"), "day", cells.cell_id(F.col("latitude"), F.col("longitude"), 13).alias("cell"))
    return spatial.cell_join(c.filter("day < date'2024-01-04'").select("id", "cell").distinct(), c.filter("day >= date'2024-01-28'").select("id", "cell").distinct(), 11)


@query(_with(_POINTS, select=f"SELECT event_id AS point_id, r AS region_id FROM p, (VALUES (1, 23.11, 113.21, 800), (2, 23.12, 113.24, 1500)) t(r, a, b, m) WHERE {_hav('latitude', 'longitude', 'a', 'b')} <= m"))
def cap_join(spark, d):
    from wayfold.functions import sphere

    caps = spark.createDataFrame([(1, 23.11, 113.21, 800.0), (2, 23.12, 113.24, 1500.0)], "id int, a double, b double, m double")
    region = lambda r: sphere.Cap(sphere.point(r["a"], r["b"]), r["m"] / 6371000.0)
    return spatial.point_join(points(spark, d).withColumnRenamed("event_id", "id"), caps, region)


@query()
def covering(spark, d):
    from wayfold.functions import sphere

    boxes = spatial.bounds(points(spark, d), ["device_id"]).withColumnRenamed("device_id", "id")
    return spatial.covering_table(boxes, lambda r: sphere.Rect(r["lat_lo"], r["lat_hi"], r["lng_lo"], r["lng_hi"]))


@query()
def convex_hull(spark, d):
    return spatial.hulls(points(spark, d), "device_id").select("device_id", F.round(F.col("area") * 1e9, 3).alias("area"), F.size("vertices").alias("vertices"))


_AT = "o * 4 + 2 * ((x >> s) & 1) + ((y >> s) & 1) + 1"
_AROUND = f"""nb AS (SELECT DISTINCT face, i >> 17 AS a, j >> 17 AS b FROM st), nq AS (SELECT face, a, b, k, a + dx AS x, b + dy AS y FROM nb, (VALUES (0, 0, 0), (1, 0, -1), (2, 1, 0), (3, 0, 1), (4, -1, 0)) t(k, dx, dy)),
nw AS (SELECT *, 12 AS s, face::BIGINT AS id, face & 1 AS o FROM nq UNION ALL SELECT face, a, b, k, x, y, s - 1, id * 4 + {_CURVE}[{_AT}], xor(o, [1,0,0,3][{_CURVE}[{_AT}] + 1])::INT FROM nw WHERE s >= 0),
nc AS (SELECT a, b, k, (2 * id + 1) * (1::BIGINT << 34) AS cell FROM nw WHERE s = -1)"""


@query(_with(_POINTS, _cells(13), _AROUND, select="SELECT max(cell) FILTER (WHERE k = 0) AS cell, string_agg(cell::VARCHAR, ',' ORDER BY k) FILTER (WHERE k > 0) AS neighbors FROM nc GROUP BY a, b", recursive=True))
def cell_neighbors(spark, d):
    c = points(spark, d).select(cells.cell_id(F.col("latitude"), F.col("longitude"), 13).alias("cell")).distinct()
    return spatial.neighbor_table(c).withColumn("neighbors", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ","))


@query(_with(_POINTS, _XYZ, select="SELECT device_id, date_trunc('hour', ts) AS slot_start, count(*) AS n, round(degrees(atan2(avg(z), sqrt(avg(x) ** 2 + avg(y) ** 2))), 9) AS latitude, round(degrees(atan2(avg(y), avg(x))), 9) AS longitude FROM x GROUP BY ALL"))
def stream_slots(spark, d):
    from wayfold.streaming.slots import slot_counts

    return slot_counts(points(spark, d)).select("device_id", "slot_start", "n", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


@query(_with(_POINTS, select="SELECT device_id, count(*) AS n, true AS few FROM p GROUP BY 1"))
def covering_holds(spark, d):
    """Every fix lies in a cell of the covering of its device's box, of 8 cells at most."""
    laid = covering(spark, d).withColumnRenamed("id", "device_id")
    leaf = points(spark, d).select("device_id", "event_id", cells.cell_id(F.col("latitude"), F.col("longitude")).alias("leaf"))
    inside = leaf.join(laid, "device_id").filter(cells.contains(F.col("cell"), F.col("leaf"))).select("device_id", "event_id").distinct()
    few = laid.groupBy("device_id").agg((F.count(F.lit(1)) <= 8).alias("few"))
    return inside.groupBy("device_id").agg(F.count(F.lit(1)).alias("n")).join(few, "device_id")


# ---------------------------------------------------------------- walking along the curve, points, rectangles


@query(_with(_POINTS, _cells(10), "n AS (SELECT DISTINCT cell, cell // (1::BIGINT << 41) AS place FROM c)",
             select="""SELECT cell, unnest(range(0, 64)) AS k, ((place * 64 + k) * 2 + 1) * (1::BIGINT << 34) AS child13, ((place + 3) * 2 + 1) * (1::BIGINT << 40) AS ahead, ((CASE WHEN place > 100000 THEN place - 100000 ELSE 0 END) * 2 + 1) * (1::BIGINT << 40) AS back,
  ((CASE WHEN place + 4 * 1048576 >= 6 * 1048576 THEN place - 2 * 1048576 ELSE place + 4 * 1048576 END) * 2::HUGEINT + 1) * (1::HUGEINT << 40) - CASE WHEN (CASE WHEN place + 4 * 1048576 >= 6 * 1048576 THEN place - 2 * 1048576 ELSE place + 4 * 1048576 END) >= 4 * 1048576 THEN (1::HUGEINT << 64) ELSE 0 END AS around FROM n""".replace("AS around", "AS around_"), recursive=True).replace("SELECT cell, unnest", "SELECT * EXCLUDE (around_), around_::BIGINT AS around FROM (SELECT cell, unnest") + ")")
def cell_walk(spark, d):
    c = F.col("cell")
    n = points(spark, d).select(cells.cell_id(F.col("latitude"), F.col("longitude"), 10).alias("cell")).distinct()
    n = n.select("cell", F.posexplode(cells.children_at_level(c, 13)).alias("k", "child13"), cells.advance(c, 3).alias("ahead"), cells.advance(c, -100_000).alias("back"), cells.advance_wrap(c, 4 << 20).alias("around"))
    return n.withColumn("k", F.col("k").cast("long"))


@query("SELECT o_orderkey, greatest(0, least(30, round(log2(1.459213746386106062 / (1 + o_custkey)) + 20)))::INT AS level FROM orders")
def closest_level(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", cells.closest_level((1 + F.col("o_custkey")) / F.lit(float(1 << 20))).alias("level"))


@query("SELECT k, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AS valid, greatest(-90, least(90, lat)) AS lat, CASE WHEN (lng + 7200) % 360 > 180 THEN (lng + 7200) % 360 - 360 ELSE (lng + 7200) % 360 END AS lng FROM (SELECT s_suppkey::BIGINT AS k, (s_suppkey * 7 % 240 - 120)::DOUBLE AS lat, (s_suppkey * 37 % 1000 - 500)::DOUBLE AS lng FROM supplier)")
def normal_points(spark, d):
    k = F.col("s_suppkey").cast("long")
    lat, lng = (k * 7 % 240 - 120).cast("double"), (k * 37 % 1000 - 500).cast("double")
    at = rects.normalized_point(lat, lng)
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("k"), rects.is_valid_point(lat, lng).alias("valid"), at["lat"].alias("lat"), at["lng"].alias("lng"))


# rectangles a and b and a point of each supplier; in SQL by west side and width
_RECTS = """r0 AS (SELECT s_suppkey::BIGINT AS k FROM supplier),
r AS (SELECT k, (k * 7 % 120 - 60)::DOUBLE AS a_lo, (k * 7 % 120 - 60 + k % 20)::DOUBLE AS a_hi, (k * 37 % 360 - 180)::DOUBLE AS a, (k * 13 % 200)::DOUBLE AS wa,
  (k * 11 % 120 - 60)::DOUBLE AS b_lo, (k * 11 % 120 - 60 + k % 47)::DOUBLE AS b_hi, (k * 53 % 360 - 180)::DOUBLE AS b, (k * 29 % 190)::DOUBLE AS wb, (k * 17 % 170 - 85)::DOUBLE AS lat, (k * 71 % 360 - 180)::DOUBLE AS lng FROM r0),
o AS (SELECT *, (b - a + 360) % 360 AS ab, (a - b + 360) % 360 AS ba, (lng - a + 360) % 360 AS po FROM r)"""


def _turned(x: str) -> str:
    return f"CASE WHEN {x} > 180 THEN ({x} + 180) % 360 - 180 ELSE {x} END"


def _rects(spark, d) -> DataFrame:
    k = F.col("s_suppkey").cast("long")

    def one(lat, high, west, wide):
        east = west + wide
        return rects.rect(lat, lat + high, west.cast("double"), F.when(east > 180, (east + 180) % 360 - 180).otherwise(east))

    a, b = one(k * 7 % 120 - 60, k % 20, k * 37 % 360 - 180, k * 13 % 200), one(k * 11 % 120 - 60, k % 47, k * 53 % 360 - 180, k * 29 % 190)
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("k"), a.alias("a"), b.alias("b"), (k * 17 % 170 - 85).cast("double").alias("lat"), (k * 71 % 360 - 180).cast("double").alias("lng"))


def _sides(r: Column) -> list:
    return [r[c].alias(c) for c in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")]


@query(_with(_RECTS, select="SELECT k, lat BETWEEN a_lo AND a_hi AND po <= wa AS has_point, a_lo <= b_lo AND b_hi <= a_hi AND ab + wb <= wa AS has_rect, a_lo <= b_hi AND b_lo <= a_hi AND (ab <= wa OR ba <= wb) AS meets FROM o"))
def rect_relations(spark, d):
    a, b = F.col("a"), F.col("b")
    return _rects(spark, d).select("k", rects.contains(a, F.col("lat"), F.col("lng")).alias("has_point"), rects.contains_rect(a, b).alias("has_rect"), rects.intersects(a, b).alias("meets"))


@query(_with(_RECTS, "w AS (SELECT *, CASE WHEN po <= wa THEN a WHEN 360 - po < po - wa THEN lng ELSE a END AS lo, CASE WHEN po <= wa THEN a + wa WHEN 360 - po < po - wa THEN a + wa ELSE lng END AS hi FROM o)",
             select=f"SELECT k, least(a_lo, lat) AS lat_lo, greatest(a_hi, lat) AS lat_hi, lo AS lng_lo, {_turned('hi')} AS lng_hi FROM w"))
def rect_add_point(spark, d):
    return _rects(spark, d).select("k", rects.add_point(F.col("a"), F.col("lat"), F.col("lng")).alias("r")).select("k", *_sides(F.col("r")))


@query(_with(_RECTS, "w AS (SELECT *, ab > 0 AND ab <= wa AND ba <= wb AS round, CASE WHEN ab <= wa THEN true WHEN ba <= wb THEN false ELSE ab - wa <= ba - wb END AS first FROM o)",
             "z AS (SELECT *, CASE WHEN first THEN a ELSE b END AS lo, CASE WHEN first THEN greatest(wa, ab + wb) ELSE greatest(wb, ba + wa) END AS wide FROM w)",
             select=f"SELECT k, least(a_lo, b_lo) AS lat_lo, greatest(a_hi, b_hi) AS lat_hi, CASE WHEN round OR wide >= 360 THEN -180 ELSE lo END AS lng_lo, CASE WHEN round OR wide >= 360 THEN 180 ELSE {_turned('lo + wide')} END AS lng_hi FROM z"))
def rect_union(spark, d):
    return _rects(spark, d).select("k", rects.union(F.col("a"), F.col("b")).alias("r")).select("k", *_sides(F.col("r")))


@query(_with(_RECTS, "w AS (SELECT *, CASE WHEN ab <= wa AND ba <= wb AND ab > 0 THEN CASE WHEN wb < wa THEN b ELSE a END WHEN ab <= wa THEN b ELSE a END AS lo, CASE WHEN ab <= wa AND ba <= wb AND ab > 0 THEN least(wa, wb) WHEN ab <= wa THEN least(wb, wa - ab) ELSE least(wa, wb - ba) END AS wide FROM o WHERE a_lo <= b_hi AND b_lo <= a_hi AND (ab <= wa OR ba <= wb))",
             select=f"SELECT k, greatest(a_lo, b_lo) AS lat_lo, least(a_hi, b_hi) AS lat_hi, lo AS lng_lo, {_turned('lo + wide')} AS lng_hi FROM w"))
def rect_intersection(spark, d):
    return _rects(spark, d).select("k", rects.intersection(F.col("a"), F.col("b")).alias("r")).filter("r is not null").select("k", *_sides(F.col("r")))


@query(_with(_RECTS, select=f"SELECT k, greatest(-90, a_lo - 7) AS lat_lo, least(90, a_hi + 7) AS lat_hi, CASE WHEN wa + 340 >= 360 THEN -180 WHEN a - 170 < -180 THEN a + 190 ELSE a - 170 END AS lng_lo, CASE WHEN wa + 340 >= 360 THEN 180 ELSE {_turned('a + wa + 170')} END AS lng_hi FROM r"))
def rect_expanded(spark, d):
    return _rects(spark, d).select("k", rects.expanded(F.col("a"), 7, 170).alias("r")).select("k", *_sides(F.col("r")))


@query(_with(_RECTS, select="SELECT k, least(a_lo, b_lo) AS lat_lo, greatest(a_lo, b_lo) AS lat_hi, CASE WHEN ab <= 180 THEN a ELSE b END AS lng_lo, CASE WHEN ab <= 180 THEN b ELSE a END AS lng_hi FROM o"))
def rect_of_points(spark, d):
    a, b = F.col("a"), F.col("b")
    return _rects(spark, d).select("k", rects.from_point_pair(a["lat_lo"], a["lng_lo"], b["lat_lo"], b["lng_lo"]).alias("r")).select("k", *_sides(F.col("r")))


def _meridian(lat: str, lng: str, at: str, lo: str, hi: str) -> str:
    """SQL: radians from a point to a stretch of a meridian."""
    foot = f"degrees(atan2(sin(radians({lat})), cos(radians({lat})) * cos(radians({at} - ({lng})))))"
    aside = f"abs(asin(cos(radians({lat})) * sin(radians({at} - ({lng})))))"
    ends = ", ".join(_hav(lat, lng, e, at, "1.0") for e in (lo, hi))
    return f"CASE WHEN {foot} BETWEEN {lo} AND {hi} AND cos(radians({at} - ({lng}))) > 0 THEN {aside} ELSE least({ends}) END"


@query(_with(_RECTS, select=f"SELECT k, round(6371000.0 * CASE WHEN po <= wa THEN radians(greatest(a_lo - lat, lat - a_hi, 0)) ELSE least({_meridian('lat', 'lng', 'a', 'a_lo', 'a_hi')}, {_meridian('lat', 'lng', '(a + wa)', 'a_lo', 'a_hi')}) END, 2) AS metres FROM o"))
def rect_point_distance(spark, d):
    return _rects(spark, d).select("k", F.round(rects.distance_to_point(F.col("a"), F.col("lat"), F.col("lng")), 2).alias("metres"))


def _gaps() -> str:
    a, b = ("a_lo", "a_hi", "a", "(a + wa)"), ("b_lo", "b_hi", "b", "(b + wb)")
    return ", ".join(_meridian(p[corner], p[x], q[y], q[0], q[1]) for x, y in ((3, 2), (2, 3)) for p, q, x, y in ((a, b, x, y), (b, a, y, x)) for corner in (0, 1))


@query(_with(_RECTS, select=f"SELECT k, round(6371000.0 * CASE WHEN ab <= wa OR ba <= wb THEN radians(greatest(b_lo - a_hi, a_lo - b_hi, 0)) ELSE least({_gaps()}) END, 2) AS metres FROM o"))
def rect_distance(spark, d):
    return _rects(spark, d).select("k", F.round(rects.distance(F.col("a"), F.col("b")), 2).alias("metres"))


# ---------------------------------------------------------------- polygons


@query("SELECT n_nationkey::INT AS k, true AS areas_add_up, true AS rest_is_less, n_nationkey % 3 <> 0 AS meets, n_nationkey % 5 = 0 AND n_nationkey % 3 <> 0 AS holds FROM nation")
def polygon_booleans(spark, d):
    """Two shapes for each nation: apart for every third key, one inside the other for every fifth of the rest."""

    def combine(batches):
        import numpy as np
        import pandas as pd

        from wayfold.functions import polygons, sphere

        for pdf in batches:
            out = []
            for k in pdf["k"].tolist():
                at, other = sphere.point(3.0 * k - 36, 14.0 * k - 170), sphere.point(3.0 * k - 36 + (40 if k % 3 == 0 else 0 if k % 5 == 0 else 4), 14.0 * k - 170)
                a, b = [sphere.regular_loop(at, 0.1, 16)], [sphere.regular_loop(other, 0.04 if k % 5 == 0 else 0.09, 11)]
                both, either, rest = polygons.intersection(a, b), polygons.union(a, b), polygons.difference(a, b)
                x, y, z, u, v = (sphere.polygon_area(p) for p in (both, either, rest, a, b))
                out.append((k, bool(np.isclose(x + y, u + v, rtol=1e-9)), bool(np.isclose(z, u - x, rtol=1e-9)), polygons.intersects(a, b), polygons.contains(a, b)))
            yield pd.DataFrame(out, columns=["k", "areas_add_up", "rest_is_less", "meets", "holds"])

    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k")).mapInPandas(combine, "k int, areas_add_up boolean, rest_is_less boolean, meets boolean, holds boolean")


@query("SELECT o_orderpriority AS date, string_agg(n || ':' || ms, ', ' ORDER BY n, ms) AS costs FROM (SELECT DISTINCT o_orderpriority, (o_custkey % 5)::INT AS n, (o_custkey % 7)::BIGINT AS ms FROM orders) GROUP BY 1")
def cost_report(spark, d):
    costs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("date"), (F.col("o_custkey") % 5).cast("int").alias("n"), (F.col("o_custkey") % 7).cast("long").alias("ms"))
    return lsh.cost_report(costs.distinct())


@query(_with(_POINTS, select=f"SELECT event_id, round(r * sin(t), 6) AS latitude, round(r * cos(t), 6) AS longitude, capturetime FROM (SELECT event_id, capturetime, sqrt(x * x + y * y) - 0.00002 * sin(y * {_BD}) AS r, atan2(y, x) - 0.000003 * cos(x * {_BD}) AS t FROM (SELECT event_id, capturetime, longitude - 0.0065 AS x, latitude - 0.006 AS y FROM p))"))
def enriched_points(spark, d):
    from wayfold.sources.tracks import enriched

    raw = points(spark, d).withColumn("date", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts", "day", "capturetime")
    return enriched(raw, from_bd=True).select("event_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "capturetime")


@query()
def quantisation_report(spark, d):
    return trajectory.quantisation_report(points(spark, d), SPAN, LEVEL, "any")


@query(_with(_POINTS, select="SELECT device_id, capturetime, latitude, longitude, k::INT AS data_type FROM p, range(3) t(k)").replace("latitude, longitude, k::INT", "round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, k::INT"))
def tagged_union(spark, d):
    p = points(spark, d)
    return trajectory.tagged_union(p, p, p).select("device_id", "capturetime", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "data_type")
