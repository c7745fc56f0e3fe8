"""Sources by settings, entries by number, comparisons with costs, graphs by key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfold.operators import cluster, graphs, lsh, patterns, trajectory
from wayfold.sources.tracks import TrackSource, enriched, points, simulated


def test_configured_source(spark, tmp_path):
    (tmp_path / "source.conf").write_text("# where tracks lie\nformat = parquet\npath = %s/t\nmergeSchema=true\n" % tmp_path)
    source = TrackSource.configured(spark, str(tmp_path / "source.conf"))
    assert source == TrackSource("parquet", f"{tmp_path}/t", {"mergeSchema": "true"})
    made = simulated(spark, 3, "2024-01-01", "2024-01-04", 5)
    source.save(made, "overwrite")
    two = source.load_days(spark, ["2024-01-01", "2024-01-03"])
    assert two.count() == 30 and source.load_days(spark, []).count() == 0
    assert "PushedFilters: [Or" in two._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        TrackSource.configured(spark, prefix="nowhere.")
    spark.conf.set("nowhere.format", "csv")
    assert TrackSource.configured(spark, prefix="nowhere.").format == "csv"
    spark.conf.unset("nowhere.format")
    assert enriched(made).select("ts", "day", "capturetime").first() is not None


def test_entries(spark, tiny):
    p = points(spark, tiny)
    how = {"min_distance": 2000.0, "min_cells": 5, "span": 3600, "level": 14}
    assert patterns.analyse(p, 0, **how).columns == ["a", "b", "hits", "days"]
    assert patterns.analyse(p, 1, **how).columns == ["device_id", "day", "degree"]
    with pytest.raises(ValueError):
        patterns.analyse(p, 2)


def test_timed_comparison(spark):
    rows = [(dt.date(2024, 1, 1), f"d{k}", [1, 2, 3, 4 + k % 2]) for k in range(6)] + [(dt.date(2024, 1, 2), f"d{k}", [k, k + 1]) for k in range(6)]
    hits, costs = lsh.timed_comparison(spark.createDataFrame(rows, "day date, id string, codes array<long>"), [2, 6])
    assert {(r.date, r.n) for r in costs.collect()} == {(d, n) for d in ("2024-01-01", "2024-01-02") for n in (2, 6)}
    exact = sum(r.pairs for r in hits.filter("n = 6 and date = '2024-01-01' and label like '%JACCARD%'").collect())
    assert exact == 15 and [r.date for r in lsh.cost_report(costs).collect()] == ["2024-01-01", "2024-01-02"]


def test_graphs_by_key(spark):
    edges = spark.createDataFrame([(g, a, b, w) for g in (1, 2) for a, b, w in ((0, 1, 2.0), (0, 2, 5.0), (1, 2, 1.0 * g), (2, 3, 1.0))], "graph int, src int, dst int, weight double")
    order = {(r.graph, r.vertex): r.place for r in graphs.depth_first_orders(edges, 0).collect()}
    assert order == {(g, v): v for g in (1, 2) for v in range(4)}
    far = {(r.graph, r.vertex): r.distance for r in graphs.distances(edges, 0).collect()}
    assert far[1, 3] == 4.0 and far[2, 3] == 5.0


def test_own_neighbours(spark):
    rows = spark.createDataFrame([(k, [k]) for k in range(9)], "idx long, features array<int>")

    def close(features):
        a, b = features.select(F.col("idx").alias("a")), features.select(F.col("idx").alias("b"))
        return a.join(b, (F.abs(F.col("a") - F.col("b")) == 1) & (F.col("a") != 4) & (F.col("b") != 4))

    found = {r.idx: r.cluster_id for r in cluster.dbscan(rows, 0.0, 1, transitive=True, neighbours=close).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5, 7: 5, 8: 5}


def test_report_of_quantising(spark, tiny):
    p = points(spark, tiny)
    got = trajectory.quantisation_report(p, 3600, 14, "bus").collect()
    assert got and all(0 <= r.similarity <= 1 and r.n_quantised <= r.n_raw and r.mode == "bus" for r in got)
