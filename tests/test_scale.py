"""Work that must not grow with the square of its input."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import cells, geo, tracks
from wayfold.operators import cluster, trajectory
from wayfold.sources.tracks import points


def crowded(n):
    """Fixes of a day that share their seconds and jump by the hour."""
    rng = np.random.default_rng(7)
    t = np.sort(rng.integers(0, 86400, n)) // 4 * 4
    off = rng.uniform(0, 560, n) * 1e-6
    return t, 23.1 + t // 3600 % 5 * 0.006 + off, 113.2 + t // 3600 % 7 * 0.008 + off


def test_purify_of_crowded_track():
    began = time.thread_time()
    kept = tracks.purify(*crowded(8000))
    assert time.thread_time() - began < 5 and (np.diff(kept) > 0).all()


def test_calm_of_crowded_slot():
    t, lat, lng = crowded(8000)
    began = time.thread_time()
    kept = tracks.calm(lat, lng)
    assert time.thread_time() - began < 1.5 and kept.any()
    for n in (2, 3, 40, 300):
        lat, lng = (np.random.default_rng(n).integers(0, 40, (2, n)) ** 2 * 1e-4) + 23
        d = tracks.distance(lat[:, None], lng[:, None], lat[None], lng[None])
        pairs = n * (n - 1)
        mean = d.sum() / pairs
        variance = (d * d).sum() / pairs - mean**2
        average = d.sum(axis=1) / n
        assert (tracks.calm(lat, lng) == (average <= 50) | (variance <= 20) | (np.abs(average - mean) <= 2 * np.sqrt(max(0, variance)))).all()


def test_clusters_of_slots_are_those_of_each_slot():
    t, lat, lng = crowded(3000)
    slot = t // 3600
    want = [(int(s), *c) for s in np.unique(slot) for c in tracks.cluster(t[slot == s], lat[slot == s], lng[slot == s], 20.0)]
    assert tracks.clusters(t, lat, lng, slot, 20.0) == want


def test_similarity_holds_no_matrix():
    t, lat, lng = crowded(3000)
    tracemalloc.start()
    got = tracks.similarity(t, lat, lng, t, lat, lng, 60, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.9 < got <= 1 and peak < 40e6


@pytest.mark.parametrize("swap", [False, True])
def test_similarity_of_long_and_short_track(swap):
    """No step of its own for each fix of the longer track."""
    a, b = crowded(20000), crowded(24)
    began = time.thread_time()
    for _ in range(5):
        got = tracks.similarity(*b, *a, 60, 200) if swap else tracks.similarity(*a, *b, 60, 200)
        assert 0 < got < 1
    assert time.thread_time() - began < 0.25


def test_compression_makes_two_passes(spark, tiny):
    plan = trajectory.compression(points(spark, tiny), 3600, 14)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2 and "FlatMapCoGroups" not in plan


def test_quantisation_report_quantises_once(spark, tiny):
    p = points(spark, tiny)
    got = trajectory.quantisation_report(p, 3600, 14, "any")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    grid = trajectory.grid_quantised(p, 3600, 14)
    want = trajectory.reduction(p, grid).join(trajectory.similarity(p, grid, 3600, 14), trajectory.KEY).withColumn("mode", F.lit("any"))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_grid_is_joined_in_one_pass(spark, tiny):
    """Against clean fixes joined by native cells and centroids, rows without a position or a key among them."""
    odd = points(spark, tiny).limit(40).withColumn("k", F.monotonically_increasing_id() % 4)
    odd = odd.withColumn("latitude", F.when(F.col("k") > 0, F.col("latitude"))).withColumn("device_id", F.when(F.col("k") == 3, "far").when(F.col("k") == 0, F.format_string("lost%d", "event_id")).otherwise(F.col("device_id"))).drop("k")
    for p in (points(spark, tiny), odd):
        p = p.cache()
        grid = trajectory.grid_quantised(p, 3600, 14)
        plan = grid._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInPandas") == 1 and "Aggregate" not in plan
        native = trajectory.clean(p, 3600).withColumn("cell", F.when(F.col("latitude").isNotNull(), cells.cell_id(F.col("latitude"), F.col("longitude"), 14)))
        lat, lng = geo.centroid(F.col("latitude"), F.col("longitude"))
        native = native.groupBy("device_id", "day", "slot", "cell").agg(lat.alias("latitude"), lng.alias("longitude"), F.min("capturetime").alias("capturetime"))
        assert grid.dtypes == native.dtypes
        got, want = ({tuple(r)[:4]: tuple(r)[4:] for r in x.collect()} for x in (grid, native))
        assert got.keys() == want.keys() and len(got) > 5
        for key, at in want.items():
            assert got[key] == pytest.approx(at, abs=1e-9) if None not in at else got[key][0] is None
        share = trajectory.grid_reduction(p, 3600, 14)
        assert "Join" not in share._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, share.collect())) == sorted(map(tuple, trajectory.reduction(p, native).collect()))


def test_cells_of_arrays(spark):
    rng = np.random.default_rng(6)
    lat, lng = np.r_[rng.uniform(-90, 90, 600), 0, 90, -90, 45, -45], np.r_[rng.uniform(-180, 180, 600), 0, 0, 180, 45, -135]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lat, lng, strict=True)], "lat double, lng double").coalesce(1)
    levels = (0, 1, 13, 15, 29, 30)
    rows = df.select(*[cells.cell_id(F.col("lat"), F.col("lng"), k).alias(f"c{k}") for k in levels]).collect()
    for k in levels[:4]:
        assert cells.cell_ids(lat, lng, k).tolist() == [r[f"c{k}"] for r in rows]
    for k in levels[4:]:  # sines may differ in their last bit
        assert np.mean(cells.cell_ids(lat, lng, k) == [r[f"c{k}"] for r in rows]) > 0.9


def test_moving_needs_no_hull(spark, tiny, monkeypatch):
    """A device-day that plainly spans the distance, or plainly doesn't, is told without its diameter."""
    t, lat, lng = crowded(5000)
    exact = tracks.diameter(lat, lng)
    monkeypatch.setattr(tracks, "diameter", None)
    assert tracks.spans(lat, lng, 0.9 * exact) and not tracks.spans(lat, lng, 2.1 * exact)
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for width in (1e-6, 0.1, 60.0):
            lat, lng = rng.uniform(-width, width, (2, n))
            exact = tracks.diameter(lat, lng)
            for share in (0.0, 0.3, 0.7, 0.95, 1 - 1e-9, 1 + 1e-9, 1.05, 1.5, 3.0):
                assert tracks.spans(lat, lng, share * exact + 1e-12) == (exact >= share * exact + 1e-12)


def brute(rows, least):
    sets = {i: set(f) for i, f in rows}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a != b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def feature_rows(features, size, n=60):
    """Rows of random sets, each a few times."""
    rng = np.random.default_rng(features)
    kinds = [sorted({int(x) for x in rng.integers(0, features, size)}) for _ in range(n // 3)]
    return [(i, kinds[int(rng.integers(0, len(kinds)))]) for i in range(n)]


@pytest.mark.parametrize(("features", "size"), [(12, 6), (200, 5)])
def test_clusters_of_equal_rows(spark, features, size):
    rows = feature_rows(features, size)
    df = spark.createDataFrame(rows, "idx long, features array<int>")
    found, _ = cluster.classes(df)
    assert cluster._Pairs(found, 0.0).dense == (features == 12)
    for least in (0.0, 0.3):
        assert {(r.a, r.b): round(r.similarity, 9) for r in cluster.similar(df, least).collect()} == {k: round(v, 9) for k, v in brute(rows, least).items()}
    near = {}
    for a, b in sorted(brute(rows, 0.3)):
        near.setdefault(a, []).append(b)
    assert {r.idx: r.cluster_id for r in cluster.dbscan(df, 0.3, 4, transitive=False).collect()} == cluster.expand(sorted(near), near, 4)
    got = {r.idx: round(r.eps, 5) for r in cluster.eps_heuristic(df, 4).collect()}
    apart = {i: sorted(round(1 - v, 5) for (a, _), v in brute(rows, 0.0).items() if a == i and v < 1)[:4] for i, _ in rows}
    assert got == {i: d[-1] for i, d in apart.items() if d}


@pytest.mark.parametrize(("features", "least", "opens"), [(30, 0.3, 20), (10, 0.1, 1)])
def test_one_hop_meets_few(spark, monkeypatch, features, least, opens):
    """More classes than a block: clusters are those of ``expand``, and classes that an opener meets don't meet each other."""
    rng = np.random.default_rng(features)
    rows = [(i, sorted({int(x) for x in rng.integers(0, features, 6)})) for i in range(600)]
    df, met, meet = spark.createDataFrame(rows, "idx long, features array<int>"), [], cluster._Pairs.meet

    def counted(self, left=None, right=None, *more, **named):
        assert self.dense
        met.append(np.prod([self.found.count() if x is None else x.count() for x in (left, right)]))
        return meet(self, left, right, *more, **named)

    monkeypatch.setattr(cluster._Pairs, "meet", counted)
    got = {r.idx: r.cluster_id for r in cluster.dbscan(df, least, 4, transitive=False).collect()}
    near = {}
    for a, b in sorted(brute(rows, least)):
        near.setdefault(a, []).append(b)
    assert got == cluster.expand(sorted(near), near, 4) and len(set(got.values())) >= opens
    classes = len({tuple(f) for _, f in rows})
    assert classes > 256 and max(met) < classes * classes


@pytest.mark.parametrize(("features", "k"), [(30, 3), (150, 5), (12, 40), (700, 5)])
def test_eps_deals_out_no_pairs(spark, monkeypatch, features, k):
    """The nearest classes come from blocks: pairs of all classes are neither rows nor sorted. Rows of equal sets, empty ones and
    ones with a null are among them."""
    for name, value in (("ROWS", 13), ("COLUMNS", 9), ("SLICE", 4)):
        monkeypatch.setattr(cluster, name, value, raising=False)
    monkeypatch.setattr(cluster._Pairs, "meet", None)
    rng = np.random.default_rng(features)
    rows = [(i, [] if i % 40 == 7 else sorted({int(x) for x in rng.integers(0, features, 1 + i % (features // 2 + 1))})) for i in range(160)]
    rows += [(200 + i, rows[3 * i][1]) for i in range(30)] + [(300, [1, 2, None]), (301, [None])]
    df = spark.createDataFrame(rows, "idx long, features array<int>")
    assert cluster._Pairs(cluster.classes(df)[0], 0.0).dense
    apart = {}
    for a, f in rows:
        for b, g in rows:
            shared = len(set(f) & set(g) - {None})
            both = len(set(f)) + len(set(g)) - shared
            if a != b and 0 < shared < both:
                apart.setdefault(a, []).append(round(1 - shared / both, 5))
    got = {r.idx: round(r.eps, 5) for r in cluster.eps_heuristic(df, k).collect()}
    assert got == {i: sorted(d)[:k][-1] for i, d in apart.items()}


def test_nearest_of_many_features(spark):
    """More features than floats of 4 bytes count exactly."""
    rng = np.random.default_rng(1)
    rows = [(i, [x for x in range(4000) if rng.random() < 0.9]) for i in range(12)]
    df = spark.createDataFrame(rows, "idx long, features array<int>")
    assert cluster._Pairs(cluster.classes(df)[0], 0.0).dense
    got = {r.idx: round(r.eps, 5) for r in cluster.eps_heuristic(df, 3).collect()}
    apart = {i: sorted(round(1 - v, 5) for (a, _), v in brute(rows, 0.0).items() if a == i)[2] for i, _ in rows}
    assert got == apart


def test_copies_make_no_pairs(spark):
    """4000 rows of 4 sets: 16 million pairs of rows, 12 of classes."""
    df = spark.range(4000).select(F.col("id").alias("idx"), F.array((F.col("id") % 4).cast("int"), F.lit(9)).alias("features"))
    began = time.time()
    found = cluster.dbscan(df, 0.3, 3)
    assert found.select("cluster_id").distinct().count() == 1 and found.count() == 4000
    assert cluster.dbscan(df, 0.3, 3, transitive=False).filter("cluster_id = 0").count() == 4000
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and time.time() - began < 120
    value = cluster.silhouette(df, df.select("idx", (F.col("idx") % 4).alias("cluster_id"))).agg(F.min("coefficient"), F.max("coefficient"), F.count("idx")).first()
    assert tuple(value) == (1.0, 1.0, 4000)
