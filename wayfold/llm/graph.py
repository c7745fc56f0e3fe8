"""Connected components of a distributed edge list."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import adopt, release, table


def components(edges: DataFrame, owner: str = "query") -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): label is the least vertex of its component.

    Least labels spread along edges, then every label is replaced by its label's label, until nothing changes: few rounds
    even for long chains. Each round is a written table, so lineage stays short and a lost executor costs one round; a round's
    table goes when the next one is written."""
    mine = [f"{owner}-{uuid.uuid4().hex}" for _ in range(3)]  # the edges, and rounds in turn
    both = table(edges.selectExpr("a as u", "b as v").unionByName(edges.selectExpr("b as u", "a as v")).distinct(), "cc-edges", mine[2])
    labels = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels = table(labels, "cc-labels", mine[0])
    for turn in count(1):
        seen = both.join(labels, "v").select(F.col("u").alias("v"), "label", F.lit(None).cast("long").alias("old")).unionByName(labels.select("v", "label", F.col("label").alias("old")))
        low = seen.groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = low.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.v"), "left").select("x.v", F.least(F.col("x.label"), F.coalesce("y.label", "x.label")).alias("label"), "x.old")
        new = table(jump, "cc-labels", mine[turn % 2])
        changed = not new.filter("label <> old").isEmpty()
        release(mine[1 - turn % 2])
        labels = new.select("v", "label")
        if not changed:
            release(mine[2])
            adopt(mine[turn % 2], owner)
            return labels
