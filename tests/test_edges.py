"""Positions on the edges that queries name."""

import datetime as dt

from pyspark.sql import functions as F

from wayfold.operators import spatial
from wayfold.sources.tracks import from_events


def test_fixes_on_an_edge(spark):
    rows = [(k, dt.datetime(2024, 1, 1, hour), user, 0.0) for k, (hour, user) in enumerate((h, u) for h in range(24) for u in range(5))]
    p = from_events(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")).collect()
    for (_, ts, user, _), r in zip(rows, p, strict=True):
        assert r.latitude == float(f"23.{100 + user * 10 + ts.hour % 5 * 6}") and r.longitude == float(f"113.{200 + user * 15 + ts.hour % 7 * 8}")
    inside = spark.createDataFrame([(r.latitude, r.longitude) for r in p], "a double, b double").filter(spatial.in_rect(F.col("a"), F.col("b"), 23.11, 23.13, 113.22, 113.26))
    want = sum(110 <= 100 + u * 10 + t.hour % 5 * 6 <= 130 and 220 <= 200 + u * 15 + t.hour % 7 * 8 <= 260 for _, t, u, _ in rows)
    assert inside.count() == want
