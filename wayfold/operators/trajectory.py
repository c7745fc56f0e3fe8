"""Operators on device-days: outliers, quantisation, space-time vectors, similarity of tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import cells, tracks
from wayfold.functions.scalars import TOLERANCE, time_slot

KEY = ["device_id", "day"]


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct fixes by time; ties by position, as input order says nothing."""
    return pdf.drop_duplicates(["capturetime", "latitude", "longitude"]).sort_values(["capturetime", "latitude", "longitude"], kind="stable")


def _purified(pdf: pd.DataFrame, speed: float, reach: float) -> pd.DataFrame:
    """Filtered fixes of a device-day, however many there are."""
    pdf = _sorted(pdf)
    return pdf.iloc[tracks.purify(*(pdf[c].to_numpy() for c in ("capturetime", "latitude", "longitude")), speed, reach, most=None)]


_FIX = "device_id string, day date, capturetime long, latitude double, longitude double"
_FIXES = [x.split()[0] for x in _FIX.split(", ")]


def purify(points: DataFrame, speed: float = tracks.SPEED, reach: float = tracks.REACH) -> DataFrame:
    """Device-days without fixes that the best chain of reachable fixes leaves out."""
    return points.select(*_FIXES).groupBy(*KEY).applyInPandas(lambda p: _purified(p, speed, reach)[_FIXES], _FIX)


def _calm(pdf: pd.DataFrame, span: int, k: float) -> pd.DataFrame:
    """Fixes of a device-day that lie with the others of their slot, with the slot."""
    slot = (pdf["capturetime"].to_numpy() - int(pd.Timestamp(pdf["day"].iloc[0]).timestamp())) // span
    order = np.argsort(slot, kind="stable")
    lat, lng, keep = pdf["latitude"].to_numpy()[order], pdf["longitude"].to_numpy()[order], np.ones(len(pdf), bool)
    slot = slot[order]
    cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(slot)], strict=True):
        if b - a > 1:
            keep[a:b] = tracks.calm(lat[a:b], lng[a:b], k)
    return pdf[_FIXES].iloc[order].assign(slot=slot.astype(np.int32))[keep]


def two_sigma(points: DataFrame, span: int, k: float = 2.0) -> DataFrame:
    """Fixes of each slot of ``span`` seconds that lie with the others; one pass over each device-day."""
    return points.select(*_FIXES).groupBy(*KEY).applyInPandas(lambda p: _calm(p, span, k), f"{_FIX}, slot int")


def clean(points: DataFrame, span: int, k: float = 2.0) -> DataFrame:
    """``two_sigma`` of ``purify``, in one pass over each device-day."""

    return points.select(*_FIXES).groupBy(*KEY).applyInPandas(lambda p: _calm(_purified(p, tracks.SPEED, tracks.REACH), span, k), f"{_FIX}, slot int")


def _measured(points: DataFrame, keys: list[str], measure, schema: str, *more: str) -> DataFrame:
    """``measure(lat, lng, rows)`` of each group, a tuple of what ``schema`` names."""
    kinds = dict(points.dtypes)
    names = [x.split()[0] for x in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = measure(pdf["latitude"].to_numpy(), pdf["longitude"].to_numpy(), pdf)
        return pdf[keys].iloc[:1].assign(**dict(zip(names, got, strict=True)))

    return points.select(*dict.fromkeys([*keys, "latitude", "longitude", *more])).groupBy(*keys).applyInPandas(one, ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema]))


def average_distance(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population variance of the pairwise distances of each group (0 for a single fix), in blocks of rows."""
    return _measured(points, keys, lambda lat, lng, _: (len(lat), *tracks.pair_moments(lat, lng)), "n int, mean double, variance double")


def diameter(points: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Largest pairwise distance of each group, 0 for a single position: of its convex hull's corners."""
    return _measured(points, keys, lambda lat, lng, _: (tracks.diameter(lat, lng),), "diameter double")


def _gridded(pdf: pd.DataFrame, span: int, level: int) -> pd.DataFrame:
    """Purified, calm fixes of a device-day joined by slot and cell; fixes without a position have no cell."""
    good = _calm(_purified(pdf, tracks.SPEED, tracks.REACH), span, 2.0)
    t, lat, lng, slot = (good[c].to_numpy() for c in ("capturetime", "latitude", "longitude", "slot"))
    known = ~(np.isnan(lat) | np.isnan(lng))
    cell = np.where(known, cells.cell_ids(np.where(known, lat, 0.0), np.where(known, lng, 0.0), level), 0)
    order = np.lexsort((cell, slot))
    first = np.flatnonzero(np.r_[True, (slot[order][1:] != slot[order][:-1]) | (cell[order][1:] != cell[order][:-1])][: len(order)])
    a, b = np.radians(lat[order]), np.radians(lng[order])
    x, y, z = (np.add.reduceat(v, first) / np.diff(np.r_[first, len(order)]) for v in (np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)))
    at = order[first]
    out = good.iloc[at][[*KEY, "slot"]].assign(cell=pd.array(cell[at], "Int64"), latitude=np.degrees(np.arctan2(z, np.sqrt(x * x + y * y))), longitude=np.degrees(np.arctan2(y, x)), capturetime=np.minimum.reduceat(t[order], first))
    out.loc[~known[at], "cell"] = pd.NA
    return out


def grid_quantised(points: DataFrame, span: int = 120, level: int = 15) -> DataFrame:
    """Purified, calm fixes joined by device-day, slot and cell: spherical centroid and first time. One pass over each device-day,
    which only what is joined leaves."""
    return points.select(*_FIXES).groupBy(*KEY).applyInPandas(lambda p: _gridded(p, span, level), "device_id string, day date, slot int, cell long, latitude double, longitude double, capturetime long")


def grid_reduction(points: DataFrame, span: int = 120, level: int = 15) -> DataFrame:
    """``reduction`` by ``grid_quantised``, counted where the fixes are joined; device-days of which nothing is left stay out."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[KEY].iloc[:1].assign(n_raw=len(pdf), n_quantised=len(_gridded(pdf, span, level)))

    counted = points.select(*_FIXES).dropna(subset=KEY).groupBy(*KEY).applyInPandas(count, "device_id string, day date, n_raw long, n_quantised long")
    return counted.filter("n_quantised > 0").withColumn("reduction", _saved())


def _clustered(calm: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Greedy clusters of the fixes of a device-day, given by time with their slot."""
    out = tracks.clusters(*(calm[c].to_numpy() for c in ("capturetime", "latitude", "longitude", "slot")), radius)
    got = pd.DataFrame(out, columns=["slot", "latitude", "longitude", "capturetime"]).sort_values(["capturetime", "slot"], kind="stable")
    return got.assign(device_id=calm["device_id"].iloc[0], day=calm["day"].iloc[0])[[*_FIXES, "slot"]] if len(got) else calm[[*_FIXES, "slot"]]


def cluster_quantised(points: DataFrame, span: int = 120, radius: float = tracks.NEAR) -> DataFrame:
    """Purified fixes, calm in their slot, joined by greedy clusters; one pass over each device-day."""
    return points.select(*_FIXES).groupBy(*KEY).applyInPandas(lambda p: _clustered(_calm(_purified(p, tracks.SPEED, tracks.REACH), span, 2.0), radius), f"{_FIX}, slot int")


def track_vectors(points: DataFrame, span: int = 1200, level: int = 16, radius: float = tracks.NEAR) -> DataFrame:
    """Space-time codes of each device-day, by time; device-days of a single fix have none."""
    from wayfold.operators.filters import several_fixes

    coded = cluster_quantised(several_fixes(points), span, radius).withColumn("code", cells.encode(F.col("slot"), cells.cell_id(F.col("latitude"), F.col("longitude"), level)))
    return coded.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("capturetime", "code"))), lambda s: s["code"]).alias("codes"))


def grid_vectors(points: DataFrame, span: int = 3600, level: int = 14) -> DataFrame:
    """Codes of the (slot, cell) pairs that a device-day touches, without cleaning: native from scan to vector."""
    coded = points.select(*KEY, cells.encode(time_slot(F.col("capturetime"), F.col("day"), span), cells.cell_id(F.col("latitude"), F.col("longitude"), level)).alias("code"))
    return coded.groupBy(*KEY).agg(F.sort_array(F.collect_set("code")).alias("codes"))


def moving(points: DataFrame, min_distance: float = 2000.0, min_cells: int = 5, level: int = 16) -> DataFrame:
    """Device-days (keys only) of more than one fix that span ``min_distance`` metres and ``min_cells`` cells: one pass over each
    device-day, put before the sequential operators, so device-days that drop out never reach them."""
    placed = points.withColumn("cell", cells.cell_id(F.col("latitude"), F.col("longitude"), level))

    def measure(lat: np.ndarray, lng: np.ndarray, pdf: pd.DataFrame) -> tuple[bool]:
        return (len(lat) > 1 and pdf["cell"].nunique() >= min_cells and tracks.spans(lat, lng, min_distance),)

    return _measured(placed, KEY, measure, "moves boolean", "cell").filter("moves").select(*KEY)


def all_vectors(points: DataFrame, min_distance: float = 2000.0, min_cells: int = 5, span: int = 120, level: int = 16) -> DataFrame:
    return track_vectors(points.join(moving(points, min_distance, min_cells, level), KEY, "left_semi"), span, level)


def decode(vectors: DataFrame, span: int = 120) -> DataFrame:
    """Fixes of codes: cell centre, slot start as time, data_type 2."""
    code = F.col("code")
    one = vectors.select(*KEY, F.explode("codes").alias("code"))
    at = cells.cell_center(cells.code_cell(code))
    out = one.select(*KEY, (F.unix_timestamp(F.col("day").cast("timestamp")) + cells.code_slot(code) * span).alias("capturetime"), at.alias("at"))
    return out.select(*KEY, "capturetime", F.col("at.lat").alias("latitude"), F.col("at.lng").alias("longitude"), F.lit(2).alias("data_type"))


def similarity(a: DataFrame, b: DataFrame, time_error: int = 600, level: int = 16, counts: tuple[str, ...] = ()) -> DataFrame:
    """Alignment of the tracks that ``a`` and ``b`` hold for the same device-day; those that only one holds are left out.
    ``counts`` names columns for the number of fixes of each."""
    tolerance, names = TOLERANCE.get(level, 200), ["capturetime", "latitude", "longitude"]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({k: [] for k in (*KEY, "similarity", *counts)})
        key = x[["device_id", "day"]].iloc[:1].reset_index(drop=True)
        x, y = (v.sort_values(names, kind="stable") for v in (x, y))
        value = tracks.similarity(*(v[c].to_numpy() for v in (x, y) for c in names), time_error, tolerance)
        return key.assign(similarity=value, **dict(zip(counts, (len(x), len(y)), strict=False)))

    schema = ", ".join(["device_id string, day date, similarity double", *[f"{c} long" for c in counts]])
    return a.select(*_FIXES).groupBy(*KEY).cogroup(b.select(*_FIXES).groupBy(*KEY)).applyInPandas(meet, schema)


def compression(points: DataFrame, span: int = 120, level: int = 16) -> DataFrame:
    """Per device-day: similarity of the cleaned track with its clusters and with its decoded codes, and bytes of each form
    (fixes: three 8-byte fields and the device id; codes: one). One pass cleans and clusters each device-day, a second one
    aligns its three tracks."""
    from wayfold.operators.filters import several_fixes

    tolerance, names = TOLERANCE.get(level, 200), ("capturetime", "latitude", "longitude")

    def forms(pdf: pd.DataFrame) -> pd.DataFrame:
        calm = _calm(_purified(pdf, tracks.SPEED, tracks.REACH), span, 2.0)
        both = pd.concat([calm.assign(clustered=False), _clustered(calm, tracks.NEAR).assign(clustered=True)])
        return both.assign(fixes=len(pdf))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        clean, clusters = pdf[~pdf["clustered"]], pdf[pdf["clustered"]]
        decoded = clusters[["then", "lat", "lng"]].set_axis(names, axis=1)
        if not len(clean) or not len(clusters):
            return pd.DataFrame({k: [] for k in (*KEY, "st_similarity", "vec_similarity", "fixes", "clusters")})
        a, b, c = ([v[x].to_numpy() for x in names] for v in (v.sort_values(list(names), kind="stable") for v in (clean, clusters, decoded)))
        st, vec = (tracks.similarity(*a, *v, span, tolerance) for v in (b, c))
        return clean[[*KEY, "fixes"]].iloc[:1].assign(st_similarity=st, vec_similarity=vec, clusters=len(clusters))[[*KEY, "st_similarity", "vec_similarity", "fixes", "clusters"]]

    both = several_fixes(points.select(*_FIXES).dropna(subset=KEY)).groupBy(*KEY).applyInPandas(forms, f"{_FIX}, slot int, clustered boolean, fixes long")
    code = cells.encode(F.col("slot"), cells.cell_id(F.col("latitude"), F.col("longitude"), level))
    both = both.withColumn("code", F.when(F.col("clustered"), code)).withColumn("at", cells.cell_center(cells.code_cell(F.col("code"))))
    both = both.withColumn("then", F.unix_timestamp(F.col("day").cast("timestamp")) + cells.code_slot(F.col("code")) * span)
    both = both.select(*_FIXES, "clustered", "fixes", "then", F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"))
    met = both.groupBy(*KEY).applyInPandas(meet, "device_id string, day date, st_similarity double, vec_similarity double, fixes long, clusters long")
    name = F.length("device_id")
    size = lambda n, fields, to: (F.col(n) * (8 * fields + name)).alias(to)
    return met.select(*KEY, "st_similarity", "vec_similarity", size("fixes", 3, "org_bytes"), size("clusters", 3, "st_bytes"), size("clusters", 1, "vec_bytes"))


def summary(records: DataFrame, periods=None) -> DataFrame:
    """Compression by half-month: tracks, mean similarities, bytes and ratios."""
    from wayfold.functions.scalars import PERIODS, period

    out = records.withColumn("period", period(F.col("day"), periods or PERIODS)).filter("period is not null").groupBy("period")
    out = out.agg(F.count(F.lit(1)).alias("tracks"), F.avg("st_similarity").alias("st"), F.avg("vec_similarity").alias("vec"), F.sum("org_bytes").alias("org"), F.sum("st_bytes").alias("stb"), F.sum("vec_bytes").alias("vecb"))
    mb = lambda c: F.round(F.col(c) / (1024.0 * 1024.0), 3)
    return out.select(
        "period", "tracks", F.round("st", 5).alias("st_similarity"), F.round("vec", 5).alias("vec_similarity"), mb("org").alias("org_mb"), mb("stb").alias("st_mb"), mb("vecb").alias("vec_mb"),
        F.round(F.col("org") / F.col("stb"), 3).alias("st_ratio"), F.round(F.col("org") / F.col("vecb"), 3).alias("vec_ratio"),
    )


def _saved() -> Column:
    return F.round((F.col("n_raw") - F.col("n_quantised")) / F.col("n_raw"), 4)


def reduction(points: DataFrame, quantised: DataFrame) -> DataFrame:
    """Per device-day: fixes before and after, and the share saved (4 decimals)."""
    a = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_raw"))
    b = quantised.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_quantised"))
    return a.join(b, KEY).withColumn("reduction", _saved())


def quantisation_report(points: DataFrame, span: int = 120, level: int = 15, mode: str = "") -> DataFrame:
    """Per device-day: fixes before and after quantising, the share saved, the similarity of both tracks, and the mode of travel
    that the caller names. Rows are appended where the caller writes them. Fixes are counted where the tracks are aligned, so
    they are quantised once."""
    points = points.dropna(subset=KEY)
    met = similarity(points, grid_quantised(points, span, level), span, level, ("n_raw", "n_quantised"))
    return met.select(*KEY, "n_raw", "n_quantised", _saved().alias("reduction"), "similarity", F.lit(mode).alias("mode"))


def tagged_union(raw: DataFrame, quantised: DataFrame, purified: DataFrame) -> DataFrame:
    """Fixes of all three forms, told apart by data_type (0 raw, 1 quantised, 2 purified)."""
    forms = [df.select(*_FIXES).withColumn("data_type", F.lit(k)) for k, df in enumerate((raw, quantised, purified))]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


def day_pairs(points: DataFrame) -> DataFrame:
    """Each day with its successor among the days that have fixes."""
    days = points.select("day").distinct()
    return days.withColumn("next_day", F.lead("day").over(Window.orderBy("day"))).filter("next_day is not null")
