import datetime as dt


import pytest
from pyspark.sql import functions as F

from wayfold.operators import cluster, filters, graphs, lsh, patterns, spatial, trajectory
from wayfold.sources import sinks, tracks

NINE = [("dev_a", "19:57:07", 23.3967826, 113.46415649), ("dev_a", "19:58:38", 23.3967770, 113.46419673), ("dev_a", "19:58:48", 23.396577, 113.464189), ("dev_a", "19:59:08", 23.397729, 113.462625)]
NINE += [("dev_b", *r[1:]) for r in NINE] + [("dev_b", "19:59:45", 23.397749, 113.462635)]


@pytest.fixture(scope="module")
def nine(spark):
    rows = [(d, a, b, 0.0, 0.0, 0, f"2023-07-04 {t}") for d, t, a, b in NINE]
    return tracks.with_time(spark.createDataFrame(rows, tracks.POINT))


def test_track_flow(spark, nine):
    assert trajectory.purify(nine).count() == 9
    wild = nine.withColumn("latitude", F.when((F.col("device_id") == "dev_a") & F.col("date").endswith("19:58:48"), F.lit(26.9)).otherwise(F.col("latitude")))
    assert trajectory.purify(wild).groupBy("device_id").count().orderBy("device_id").collect()[0]["count"] == 3
    v = trajectory.track_vectors(nine, 120, 16).orderBy("device_id").collect()
    assert len(v) == 2 and {c >> 45 & 0xFFFF for c in v[0].codes} == {598, 599}
    back = trajectory.decode(spark.createDataFrame(v), 120)
    assert back.agg(F.max(F.abs(F.col("latitude") - 23.397))).first()[0] < 0.003
    same = trajectory.similarity(nine, nine, 600, 16).collect()
    assert all(0.9 < r.similarity <= 1 for r in same)  # ties may leave the diagonal
    got = trajectory.compression(nine).orderBy("device_id").collect()
    assert got[0].org_bytes == 4 * (24 + 5) and 0 < got[0].st_similarity <= 1
    assert trajectory.summary(trajectory.compression(nine)).collect()[0].period == "Jul 1-15"
    assert trajectory.moving(nine, 100.0, 1).count() == 2 and trajectory.moving(nine, 2000.0, 1).count() == 0


def test_filters(spark, nine):
    ids = spark.createDataFrame([("test_0",), ("test_7",), ("13x",), ("abcdefg",), ("test_12",)], "device_id string")
    assert {r[0] for r in ids.filter(filters.tag("0,0")).collect()} == {"test_0", "13x", "abcdefg"}
    assert {r[0] for r in ids.filter(filters.tag("5,12")).collect()} == {"test_7", "test_12", "13x"}
    assert nine.filter(filters.between_days("20230704, 2023-07-05")).count() == 9 and nine.filter(filters.between_days("20230704")).count() == 0
    assert filters.select_points(nine, ["dev_b"]).count() == 5 and filters.several_fixes(nine).count() == 9


@pytest.fixture(scope="module")
def vectors(spark):
    sets = {"A": [1, 2, 3, 4], "B": [1, 2, 3, 4], "C": [1, 2, 3, 9], "D": [7, 8], "E": [1, 1, 2, 3, 4]}
    return spark.createDataFrame([(dt.date(2024, 1, 1), k, v) for k, v in sets.items()], "day date, id string, codes array<long>")


def test_lsh(spark, vectors):
    exact = {(r.a, r.b): round(r.similarity, 6) for r in lsh.jaccard_pairs(vectors).collect()}
    assert exact == {("A", "B"): 1, ("A", "C"): 0.6, ("A", "E"): 1, ("B", "C"): 0.6, ("B", "E"): 1, ("C", "E"): 0.6}
    pairs = lsh.lsh_pairs(vectors)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert {("A", "B"), ("A", "E"), ("B", "E")} <= found and not any("D" in p for p in found)
    report = lsh.pair_report(pairs).collect()
    assert report[0].hits == 1 and report[0].days == "2024-01-01"
    labels = {r.label for r in lsh.hits_against_exact(pairs, lsh.jaccard_pairs(vectors)).collect()}
    assert labels <= {"LSH", "JACCARD", "LSH#JACCARD"} and "LSH#JACCARD" in labels


def test_hit_rate_follows_the_curve(spark):
    import random

    rng = random.Random(2)
    rows = []
    for k in range(200):
        codes = rng.sample(range(200000), 100)
        common, rest = codes[:40], codes[40:]
        rows += [(k, "a", common + rest[:30]), (k, "b", common + rest[30:])]  # 40 of 100: similarity 0.4
    v = spark.createDataFrame(rows, "day int, id string, codes array<long>")
    hit = lsh.lsh_pairs(v).select("day").distinct().count() / 200
    assert abs(hit - 0.504) < 0.2


def test_patterns(spark):
    assert sorted(map(sorted, patterns.merge_sets([{1, 2}, {2, 3}, {4, 5}]))) == [[1, 2, 3], [4, 5]]
    days = [dt.date(2024, 1, k) for k in range(1, 5)]
    v = spark.createDataFrame([("d", x, [1, 2, 3]) for x in days[:3]] + [("d", days[3], [9])], "device_id string, day date, codes array<long>")
    got = patterns.personal_patterns(v).collect()
    assert {r.day for r in got} == {"2024-01-01", "2024-01-02", "2024-01-03"} and {r.degree for r in got} == {2}


def test_clusters(spark):
    f = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 2, 3]), (2, [1, 2, 4]), (3, [8, 9]), (4, [8, 9]), (5, [50])], "idx long, features array<int>")
    got = {r.idx: r.cluster_id for r in cluster.dbscan(f, 0.5, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert {r.idx: r.cluster_id for r in cluster.dbscan(f, 0.5, 1, transitive=True).collect()} == got
    s = {r.idx: r.coefficient for r in cluster.silhouette(f, cluster.dbscan(f, 0.5, 1)).collect()}
    assert s[3] == 1.0 and s[0] == pytest.approx(1 - 0.25)
    assert cluster.silhouette(f, cluster.dbscan(f, 0.5, 1), parity=True).count() == 5
    assert {r.idx: r.eps for r in cluster.eps_heuristic(f).collect()} == {0: 0.5, 1: 0.5, 2: 0.5}


EDGES = [tuple(x) for x in ("AB", "AF", "AG", "BC", "BF", "CD", "CE", "CF", "DE", "EF", "EG", "FG")]
WEIGHT = [12, 16, 14, 10, 7, 3, 5, 6, 4, 2, 8, 9]


def test_graphs(spark):
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(EDGES, WEIGHT, strict=True)], "src string, dst string, weight double").coalesce(1)
    both = graphs.undirected(edges)
    pdf = edges.toPandas()
    assert graphs.kruskal(pdf)["weight"].sum() == graphs.prim(pdf)["weight"].sum() == 36
    assert graphs.minimum_spanning_forest(edges).agg(F.sum("weight")).first()[0] == 36
    want = {"A": 0, "B": 12, "C": 22, "D": 22, "E": 18, "F": 16, "G": 14}
    assert {r.vertex: r.distance for r in graphs.shortest_paths(both, "A").collect()} == want == graphs.dijkstra(both.toPandas(), "A")
    assert {r.vertex: r.depth for r in graphs.bfs(both, "A").collect()} == {"A": 0, "B": 1, "F": 1, "G": 1, "C": 2, "E": 2, "D": 3}
    assert graphs.depth_first(both.toPandas(), "A") == list("ABCDEFG")
    bad = spark.createDataFrame([("a", "b", 1.0), ("b", "a", -3.0)], "src string, dst string, weight double").coalesce(1)
    with pytest.raises(ValueError, match="negative cycle"):
        graphs.shortest_paths(bad, "a")


def test_spatial(spark):
    import numpy as np

    from wayfold.functions import sphere

    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform([10, 20], [10.2, 20.2], (300, 2)))]
    pts = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    q = pts.filter("id < 10")
    got = {(r.query_id, r.rank): r.point_id for r in spatial.nearest(q, pts, 3, 5000.0).collect()}
    v = sphere.point(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    for k in range(10):
        d = sphere.angle(v, v[k]) * 6371000.0
        order = [int(i) for i in np.argsort(d)[:3] if d[i] <= 5000]
        assert [got[k, r + 1] for r in range(len(order))] == order
    square = spark.createDataFrame([(1, "10.05:20.05, 10.05:20.15, 10.15:20.15, 10.15:20.05")], "id int, t string")
    region = lambda r: sphere.Polygon([sphere.parse_points(r["t"])])
    inside = {r.point_id for r in spatial.point_join(pts, square, region, level=11).collect()}
    sure = {k for k, a, b in rows if 10.051 < a < 10.149 and 20.051 < b < 20.149}
    assert sure <= inside and len(inside) - len(sure) < 10
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0)], "id int, lat1 double, lng1 double, lat2 double, lng2 double")
    g = spark.createDataFrame([(7, -0.5, 0.5, 0.5, 0.5), (8, 1.0, 0.0, 2.0, 0.0), (9, 0.0, 1.0, 1.0, 1.0)], "id int, lat1 double, lng1 double, lat2 double, lng2 double")
    assert {(r.b_id, r.kind) for r in spatial.edge_crossings(e, g, 8).collect()} == {(7, 1), (9, 0)}


def test_sources_and_sinks(spark, nine, tmp_path):
    (tmp_path / "geolife/007/Trajectory").mkdir(parents=True)
    (tmp_path / "geolife/007/Trajectory/a.plt").write_text("head\nWGS 84\n39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\n39.8,116.2,0,490,39744.1,2008-10-23,02:53:10\n")
    (tmp_path / "volunteers").mkdir()
    head = "geoTime,latitude,longitude,altitude,course,horizontalAccuracy,verticalAccuracy,speed,status,activity,network,appStatus,dayTime\n"
    (tmp_path / "volunteers/vol1.csv").write_text(head + "1690000000000,23.1,113.2,1,0,1,1,2.5,a,b,c,d,e\n0,23.1,113.2,1,0,1,1,2.5,a,b,c,d,e\n")
    (tmp_path / "volunteers/vol2.csv").write_text(head + "bad,23.1,113.2,1,0,1,1,2.5,a,b,c,d,e\n")
    plt = tracks.plt_files(spark, str(tmp_path)).collect()
    assert len(plt) == 2 and plt[0].device_id == "007" and plt[0].date == "2008-10-23 02:53:04"
    csv = tracks.volunteer_files(spark, str(tmp_path)).collect()
    assert [r.device_id for r in csv] == ["vol1"] and csv[0].date == "2023-07-22 04:26:40"
    assert tracks.plt_files(spark, str(tmp_path), spark.createDataFrame([("007",)], "device_id string")).count() == 0
    src = tracks.TrackSource("parquet", str(tmp_path / "t"))
    src.save(nine.select([f.name for f in tracks.POINT]))
    assert src.devices(spark).count() == 2 and src.days(spark).count() == 1
    html = sinks.track_html(nine.filter("device_id = 'dev_a'"))
    assert html.count("circleMarker") == 4 and '"red"' in html and '"green"' in html
    sinks.write_text(nine.select("device_id"), str(tmp_path / "txt"))
    sinks.merge_text(spark, str(tmp_path / "txt"), str(tmp_path / "one"))
    assert spark.read.text(str(tmp_path / "one")).count() == 9
    sim = tracks.simulated(spark, 3, "2023-07-30", "2023-08-02")
    assert sim.count() == 90 and sim.select(F.substring("date", 1, 10)).distinct().count() == 3
    assert {len(r.plate) for r in tracks.random_plates(spark, 5).collect()} == {8}
    sinks.init_tables(spark)
    sinks.clear_table(spark, "track_event")
    assert spark.table("track_event").count() == 0



def test_stream(spark, tiny, tmp_path):
    from wayfold.streaming import slots

    q = slots.slot_counts(slots.event_stream(spark, tiny)).writeStream.outputMode("complete").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("slots").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tiny}/events.parquet").count()


def test_entry(spark, tiny):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and entry.entry(spark).count() > 0
    for name in ("decode_codes", "purify", "period_summary", "spanning_tree", "covering", "convex_hull"):
        assert queries[name](spark, tiny).count() > 0
