"""Device-days of any length are filtered whole: more than 20 000 fixes are no other case."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import tracks
from wayfold.operators import patterns, trajectory

N, SPAN, LEVEL = 21_000, 3600, 14


@pytest.fixture(scope="module")
def long_days(spark):
    """Three devices that stay where they are from 8 to 14 o'clock, a fix each second, a and c at one place; and the same with a
    wild fix in each other hour, at places that all share and none reaches."""
    day = int(np.datetime64("2024-01-10").astype("datetime64[s]").astype(int))
    still, wild = [], []
    for device, lat in (("a", 23.1), ("b", 23.4), ("c", 23.1)):
        key = [F.lit(device).alias("device_id"), F.to_date(F.lit("2024-01-10")).alias("day")]
        still.append(spark.range(N).select(*key, (day + 8 * SPAN + F.col("id")).alias("capturetime"), (lat + F.col("id") % 500 * 1e-7).alias("latitude"), F.lit(113.2).alias("longitude")))
        hours = spark.range(24).filter("id < 8 or id > 13")
        wild.append(hours.select(*key, (day + F.col("id") * SPAN + 7).alias("capturetime"), (24.0 + F.col("id") * 0.01).alias("latitude"), F.lit(114.2).alias("longitude")))
    a, b = (x[0].unionByName(x[1]).unionByName(x[2]) for x in (still, wild))
    a = a.coalesce(1).cache()
    return a, a.unionByName(b).coalesce(1).cache()


def rows(df):
    return sorted(map(repr, df.collect()))


def greedy(t, lat, lng, speed=tracks.SPEED, reach=tracks.REACH):
    """The filter line by line."""
    taken, best = set(), None
    for i in range(len(t)):
        if i in taken:
            continue
        chain = [i]
        for j in range(i + 1, len(t)):
            k, dt = chain[-1], t[j] - t[chain[-1]]
            d = tracks.distance(lat[k], lng[k], lat[j], lng[j])
            if dt > 0 and d < speed * dt and d < reach:
                chain.append(j)
                taken.add(j)
        own = (len({(lat[k], lng[k]) for k in chain}), t[chain[-1]] - t[i], i)
        if best is None or own > best[0]:
            best = own, chain
    return best[1]


@pytest.mark.parametrize("wide", [0.05, 0.4, 8.0])
def test_purify_looks_far_by_cubes(monkeypatch, wide):
    monkeypatch.setattr(tracks, "AHEAD", 4)
    rng = np.random.default_rng(int(wide * 100))
    t = np.sort(rng.integers(0, 20_000, 240))
    lat, lng = 23 + rng.uniform(-wide, wide, 240), 113 + rng.uniform(-wide, wide, 240)
    lat[::3], lng[::3] = 23 + rng.uniform(0, 0.01, 80), 113 + rng.uniform(0, 0.01, 80)
    assert tracks.purify(t, lat, lng).tolist() == greedy(t, lat, lng)


def test_purify_of_long_track_with_outliers():
    """50 000 fixes, every tenth somewhere else: no square of them."""
    rng = np.random.default_rng(5)
    t, k = np.sort(rng.integers(0, 86400, 50_000)), np.arange(50_000) % 10 == 0
    lat, lng = (np.where(k, c + rng.uniform(-20, 20, len(t)), c + rng.uniform(0, 1e-4, len(t))) for c in (23.0, 113.0))
    began = time.thread_time()
    kept = tracks.purify(t, lat, lng, most=None)
    assert time.thread_time() - began < 10 and len(kept) > 25_000 and not k[kept].any()


def test_purify_of_long_days(spark, long_days):
    still, wild = long_days
    assert rows(trajectory.purify(wild)) == rows(still.select("device_id", "day", "capturetime", "latitude", "longitude"))


def test_cluster_points_of_long_days(long_days):
    still, wild = long_days
    assert rows(trajectory.cluster_quantised(wild, SPAN)) == rows(trajectory.cluster_quantised(still, SPAN))


def test_compression_of_long_days(long_days):
    still, wild = (trajectory.compression(x, SPAN, LEVEL).drop("org_bytes") for x in long_days)
    assert rows(wild) == rows(still)


def test_grid_quantise_of_long_days(long_days):
    still, wild = long_days
    assert rows(trajectory.grid_quantised(wild, SPAN, 15)) == rows(trajectory.grid_quantised(still, SPAN, 15))


def test_group_patterns_of_long_days(long_days):
    """Wild fixes make no pair of devices that never meet."""
    got = patterns.group_patterns(long_days[1], span=SPAN, level=LEVEL)
    assert [tuple(sorted(r.asDict()[c] for c in ("a", "b"))) for r in got.collect()] == [("a", "c")]


def test_period_summary_of_long_days(long_days):
    still, wild = (trajectory.summary(trajectory.compression(x, SPAN, LEVEL), ((1, 1, 15, "Jan 1-15"),)).first() for x in long_days)
    assert wild.tracks == still.tracks == 3 and (wild.st_similarity, wild.vec_similarity) == (still.st_similarity, still.vec_similarity)
    assert wild.st_ratio == pytest.approx(still.st_ratio * (N + 18) / N, abs=2e-3)


def test_quantisation_report_of_long_days(long_days):
    still, wild = (trajectory.quantisation_report(x, SPAN, 15) for x in long_days)
    assert {r.n_raw for r in wild.collect()} == {N + 18}
    assert rows(wild.select("device_id", "n_quantised")) == rows(still.select("device_id", "n_quantised"))


def test_quantise_ratio_of_long_days(long_days):
    still, wild = (trajectory.grid_reduction(x, SPAN, 15) for x in long_days)
    assert {r.n_raw for r in wild.collect()} == {N + 18}
    assert rows(wild.select("device_id", "n_quantised")) == rows(still.select("device_id", "n_quantised"))


def test_track_similarity_of_long_days(long_days):
    still, wild = long_days
    assert rows(trajectory.similarity(still, trajectory.grid_quantised(wild, SPAN, 15), SPAN, LEVEL)) == rows(trajectory.similarity(still, trajectory.grid_quantised(still, SPAN, 15), SPAN, LEVEL))


def test_track_vectors_of_long_days(long_days):
    still, wild = (trajectory.track_vectors(x, SPAN, LEVEL) for x in long_days)
    assert rows(wild) == rows(still)
