"""Line deduplication by winnowing, in DataFrame operations only.

Lines that are not blank are hashed (trimmed of spaces). Of every ``min_run`` consecutive line hashes the least is selected
(winnowing): two equal runs of at least ``min_run`` lines are guaranteed to share a selected fingerprint at the same place.
Only around fingerprints that occur more than once are positions joined: each of the ``min_run`` windows that select the
fingerprint, left and right of it, is joined with the first position (by doc_id, then text hash, then line) of that same
window in the corpus, so a match grows line by line in both directions and never meets all pairs of a group. Adjacent
matches are merged into runs, and the lines of every run that occurs earlier are deleted.

Work is linear in a document's lines: split lines are columns of their own, never made anew for a line. Tables that a hot
line's rows are joined with are written first, so that Spark can split the hot side.

Exactly the lines covered by a window of ``min_run`` non-blank lines that occurs at an earlier position are deleted.
Null texts stay null; empty texts stay. Rows equal in doc_id and text count as one document. A null doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import table

MIN_RUN = 3


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_wf_d", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("_wf_t", F.xxhash64("text"))


def _solid(lines):
    """(place among all lines, trimmed line) of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"] != "")


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, owner: str = "query") -> DataFrame:
    """Runs to delete: _wf_d, _wf_t (the document) and runs, an array of (lo, hi) among its non-blank lines."""
    hashed = _keys(docs).select("_wf_d", "_wf_t", F.transform(_solid(F.split("text", "\n")), lambda s: F.xxhash64(s["x"])).alias("h")).filter(F.size("h") >= min_run)
    each = hashed.select("_wf_d", "_wf_t", "h", F.posexplode(F.slice("h", F.lit(1), F.size("h") - (min_run - 1))).alias("s", "h0"))
    window = [F.col("h0"), *[F.get("h", F.col("s") + k) for k in range(1, min_run)]]
    each = each.select("_wf_d", "_wf_t", "s", F.least(*window).alias("print"), F.xxhash64(*window).alias("k1"), F.xxhash64(F.lit(1), *window).alias("k2"))
    # the selected fingerprints: the window minima, once for each place where they stand
    picked = hashed.select(
        F.explode(
            F.expr(f"filter(transform(sequence(0, size(h) - {min_run}), s -> struct(s, array_min(slice(h, s + 1, {min_run})) as p)), "
                   f"(w, k) -> k = 0 or w.p != array_min(slice(h, k, {min_run})) or get(h, k - 1) = w.p)")
        ).alias("w")
    ).select(F.col("w.p").alias("print"))
    again = table(picked.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"), "line-prints", owner)
    near = table(each.join(again, "print", "left_semi").drop("print"), "line-near", owner)
    first = near.groupBy("k1", "k2").agg(F.min(F.struct("_wf_d", "_wf_t", "s")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2", "first")
    later = near.join(table(first, "line-first", owner), ["k1", "k2"]).filter(F.struct("_wf_d", "_wf_t", "s") > F.col("first")).select("_wf_d", "_wf_t", "s").distinct()
    w = Window.partitionBy("_wf_d", "_wf_t").orderBy("s")
    part = later.withColumn("new", (F.col("s") > F.lag("s", 1, -(10**6)).over(w) + min_run).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = part.groupBy("_wf_d", "_wf_t", "run").agg(F.min("s").alias("lo"), (F.max("s") + (min_run - 1)).alias("hi"))
    return runs.groupBy("_wf_d", "_wf_t").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, owner: str = "query") -> DataFrame:
    """``docs`` with text without its later repeated runs, and n_lines, n_removed (non-blank lines)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]  # a column of that name gives way
    runs = repeated_runs(docs.select("doc_id", "text"), min_run, owner).withColumnRenamed("runs", "_wf_runs")
    both = _keys(docs).join(runs, ["_wf_d", "_wf_t"], "left")
    # each of these is used several times above it, so Spark keeps it a column instead of putting it into the lambdas
    both = both.withColumn("_wf_lines", F.split("text", "\n"))
    both = both.withColumn("_wf_solid", F.transform(_solid(F.col("_wf_lines")), lambda s: s["i"]))
    gone = F.flatten(F.transform("_wf_runs", lambda r: F.slice(F.col("_wf_solid"), r["lo"] + 1, r["hi"] - r["lo"] + 1)))
    both = both.withColumn("_wf_dead", F.when(F.size("_wf_solid") > 0, gone))
    left = F.array_except(F.sequence(F.lit(0), F.size("_wf_lines") - 1), F.col("_wf_dead"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_wf_lines"), i)), "\n")
    return both.select(
        *[F.when(F.col("_wf_dead").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_wf_solid")).alias("n_lines"),
        F.when(F.col("_wf_dead").isNull(), F.lit(0)).otherwise(F.size("_wf_dead")).alias("n_removed"),
    )
