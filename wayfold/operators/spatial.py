"""Spatial joins on cells, rectangles, caps and polygons, and the geometry kernels as DataFrame operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import cells, geo, sphere

# ---------------------------------------------------------------- predicates


def in_rect(lat: Column, lng: Column, lat_lo, lat_hi, lng_lo, lng_hi) -> Column:
    """Closed rectangle in degrees; lng_lo > lng_hi crosses the antimeridian."""
    a, b, c, d = (F.lit(v) if not isinstance(v, Column) else v for v in (lat_lo, lat_hi, lng_lo, lng_hi))
    return lat.between(a, b) & F.when(c <= d, lng.between(c, d)).otherwise((lng >= c) | (lng <= d))


def in_cap(lat: Column, lng: Column, axis_lat, axis_lng, radius_m) -> Column:
    """Within ``radius_m`` metres of the axis: squared chord against squared chord."""
    a, b, r = (F.lit(v) if not isinstance(v, Column) else v for v in (axis_lat, axis_lng, radius_m))
    p, q = geo.xyz(lat, lng), geo.xyz(a, b)
    half = F.sin(r / (2 * geo.EARTH_M))
    return sum(((x - y) * (x - y) for x, y in zip(p, q, strict=True)), F.lit(0.0)) <= 4 * half * half


def rect_area(lat_lo: Column, lat_hi: Column, lng_lo: Column, lng_hi: Column) -> Column:
    width = lng_hi - lng_lo
    return F.radians(F.when(width >= 0, width).otherwise(width + 360)) * F.abs(F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo)))


# ---------------------------------------------------------------- joins

BROADCAST_ROWS = 10_000  # regions or queries, each with at most some hundred cells


def _small(df: DataFrame) -> bool:
    """Whether a side has few enough rows to be sent to every task; counted, not guessed."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _cell_or_none(level: int) -> Column:
    """The cell of a position, 0 (no cell's id) for none: a key that can't be null is not made a second time by a filter for it."""
    return F.coalesce(cells.cell_id(F.col("latitude"), F.col("longitude"), level), F.lit(0).cast("long")).alias("cell")


def covering_table(regions: DataFrame, region, max_cells: int = 8, max_level: int = 20, interior: bool = False) -> DataFrame:
    """(id, cell) of the coverings of ``regions`` (id and parameters); ``region`` makes a region of a row."""
    kind = dict(regions.dtypes)["id"]

    def cover(batches):
        for pdf in batches:
            out = [(r["id"], c) for r in pdf.to_dict("records") for c in sphere.signed_ids(sphere.covering(region(r), max_cells, max_level=max_level, interior=interior))]
            yield pd.DataFrame(out, columns=["id", "cell"])

    return regions.mapInPandas(cover, f"id {kind}, cell long")


def cell_join(a: DataFrame, b: DataFrame, level: int = 10) -> DataFrame:
    """Pairs (a_id, b_id) of cell unions (id, cell) that overlap: cells meet by an equi-join on their ancestor at ``level``
    (coarser ones on each descendant there), then the ranges are compared. Pairs appear once."""

    def keyed(df: DataFrame) -> DataFrame:
        up = cells.parent(F.col("cell"), level)
        first = cells.parent(cells.range_min(F.col("cell")), level)
        count = F.when(cells.level_of(F.col("cell")) >= level, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (F.lit(level) - cells.level_of(F.col("cell")))).cast("int")))
        start = F.when(cells.level_of(F.col("cell")) >= level, up).otherwise(first)
        step = F.lit(1 << (2 * (30 - level) + 1)).cast("long")
        return df.select("id", "cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: start + k * step)).alias("key"))

    x, y = keyed(a).alias("x"), keyed(b).alias("y")
    met = x.join(y, F.col("x.key") == F.col("y.key")).filter(cells.intersects(F.col("x.cell"), F.col("y.cell")))
    return met.select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id")).distinct()


def point_join(points: DataFrame, regions: DataFrame, region, level: int = 12, max_cells: int = 64) -> DataFrame:
    """(point_id, region_id) of points (id, latitude, longitude) inside regions: points meet coverings by an equi-join on the
    cell of ``level``, and the exact test follows on what meets."""
    laid = covering_table(regions, region, max_cells, level)
    own = cells.level_of(F.col("cell"))
    count = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (F.lit(level) - own)).cast("int"))
    first = cells.parent(cells.range_min(F.col("cell")), level)
    laid = laid.select(F.col("id").alias("region_id"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: first + k * F.lit(1 << (2 * (30 - level) + 1)).cast("long"))).alias("cell"))
    keyed = points.select(F.col("id").alias("point_id"), "latitude", "longitude", _cell_or_none(level))
    own_side = F.broadcast if _small(regions) else lambda df: df
    met = keyed.join(own_side(laid.distinct()), "cell").join(own_side(regions.withColumnRenamed("id", "region_id")), "region_id")
    columns = [c for c in regions.columns if c != "id"]
    kinds = dict(met.dtypes)

    def test(batches):
        for pdf in batches:
            keep = []
            for _, part in pdf.groupby("region_id", sort=False):
                inside = region(part.iloc[0][columns].to_dict()).contains(sphere.point(part["latitude"].to_numpy(), part["longitude"].to_numpy()))
                keep.append(part[inside])
            yield pd.concat(keep)[["point_id", "region_id"]] if keep else pdf[["point_id", "region_id"]]

    return met.mapInPandas(test, f"point_id {kinds['point_id']}, region_id {kinds['region_id']}")


def nearest(queries: DataFrame, points: DataFrame, k: int, radius_m: float, level: int | None = None) -> DataFrame:
    """The k nearest points (id, latitude, longitude) of each query within ``radius_m``: query_id, rank, point_id, distance.
    Queries are laid on the cell of ``level`` they lie in and its neighbours, which hold the whole radius."""
    edge = 2.0 / 3.0 * 2**0.5  # narrowest width of a level-0 cell over its halvings
    if level is None:
        level = max(0, min(30, int(np.floor(np.log2(edge * geo.EARTH_M / radius_m)))))

    def around(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c = sphere.cell_of(sphere.point(r.latitude, r.longitude), level)
                near = [c, *sphere.all_neighbors(c, level)] if level >= 1 else [sphere.cell_at(f, 0, 0, 0) for f in range(6)]
                rows += [(r.id, r.latitude, r.longitude, x) for x in sphere.signed_ids(near)]
            yield pd.DataFrame(rows, columns=["query_id", "qa", "qb", "cell"])

    kinds = dict(queries.dtypes)
    asked = queries.select("id", "latitude", "longitude").mapInPandas(around, f"query_id {kinds['id']}, qa double, qb double, cell long").distinct()
    laid = points.select(F.col("id").alias("point_id"), "latitude", "longitude", _cell_or_none(level))
    met = laid.join(F.broadcast(asked) if _small(queries) else asked, "cell").withColumn("distance", geo.haversine(F.col("qa"), F.col("qb"), F.col("latitude"), F.col("longitude"))).filter(F.col("distance") <= radius_m)
    w = Window.partitionBy("query_id").orderBy("distance", "point_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "point_id", "distance")


def edge_crossings(a: DataFrame, b: DataFrame, level: int = 10) -> DataFrame:
    """(a_id, b_id, kind) of edges (id, lat1, lng1, lat2, lng2) that cross (1) or share a vertex (0). Edges meet by the cells
    of ``level`` of points along them and of the cells around those."""
    step = 0.5 * sphere.average_area(level) ** 0.5

    def lay(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                p, q = sphere.point(r.lat1, r.lng1), sphere.point(r.lat2, r.lng2)
                n = max(1, int(np.ceil(float(sphere.angle(p, q)) / step)))
                own = {sphere.cell_of(sphere.interpolate(t / n, p, q), level) for t in range(n + 1)}
                rows += [(r.id, r.lat1, r.lng1, r.lat2, r.lng2, x) for x in sphere.signed_ids(own | {y for x in own for y in sphere.all_neighbors(x, level)})]
            yield pd.DataFrame(rows, columns=["id", "lat1", "lng1", "lat2", "lng2", "cell"])

    keyed = lambda df, s: df.select("id", "lat1", "lng1", "lat2", "lng2").mapInPandas(lay, f"id {dict(df.dtypes)['id']}, lat1 double, lng1 double, lat2 double, lng2 double, cell long").select("cell", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "lat1", "lng1", "lat2", "lng2")])
    met = keyed(a, "a").join(keyed(b, "b"), "cell").drop("cell").distinct()

    def test(batches):
        for pdf in batches:
            v = {s: (sphere.point(pdf[f"{s}_lat1"].to_numpy(), pdf[f"{s}_lng1"].to_numpy()), sphere.point(pdf[f"{s}_lat2"].to_numpy(), pdf[f"{s}_lng2"].to_numpy())) for s in "ab"}
            kind = np.array([sphere.crossing(v["a"][0][i], v["a"][1][i], v["b"][0][i], v["b"][1][i]) for i in range(len(pdf))], dtype=np.int32)
            yield pdf[["a_id", "b_id"]].assign(kind=kind)[kind >= 0]

    kinds = dict(met.dtypes)
    return met.mapInPandas(test, f"a_id {kinds['a_id']}, b_id {kinds['b_id']}, kind int")


# ---------------------------------------------------------------- geometry of groups


def track_lengths(points: DataFrame, keys: list[str]) -> DataFrame:
    """Length of each track in metres, as a sum over steps; native."""
    w = Window.partitionBy(*keys).orderBy("capturetime", "latitude", "longitude")
    step = geo.haversine(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return points.withColumn("step", step).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least rectangle of each group, away from the antimeridian; native."""
    return points.groupBy(*keys).agg(F.min("latitude").alias("lat_lo"), F.max("latitude").alias("lat_hi"), F.min("longitude").alias("lng_lo"), F.max("longitude").alias("lng_hi"))


def hulls(points: DataFrame, key: str) -> DataFrame:
    """Convex hull of each group: key, area (steradians), vertices. A group first shrinks to its distinct positions."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = sphere.convex_hull(sphere.point(pdf["latitude"].to_numpy(), pdf["longitude"].to_numpy()))
        lat, lng = sphere.lat_lng(hull) if len(hull) else (np.zeros(0), np.zeros(0))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "area": [sphere.loop_area(hull)], "vertices": [[{"lat": a, "lng": b} for a, b in zip(lat, lng, strict=True)]]})

    distinct = points.select(key, "latitude", "longitude").distinct()
    return distinct.groupBy(key).applyInPandas(one, f"{key} {dict(points.dtypes)[key]}, area double, vertices array<struct<lat:double,lng:double>>")


def neighbor_table(df: DataFrame, column: str = "cell") -> DataFrame:
    """``df`` with the four edge neighbours of a cell column."""

    def near(batches):
        for pdf in batches:
            yield pdf.assign(neighbors=[sphere.signed_ids(sphere.edge_neighbors(c)) for c in sphere.unsigned_ids(pdf[column])])

    kinds = ", ".join(f"{c} {k}" for c, k in df.dtypes)
    return df.mapInPandas(near, f"{kinds}, neighbors array<long>")
