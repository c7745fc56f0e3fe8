"""Analytics on movement tracks, Spark-first."""
