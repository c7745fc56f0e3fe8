"""Exact k nearest binary codes by incremental multi-index hashing.

Codes (64 bits a word, any number of words) are cut into ``segments`` parts, each within a word and an index of its own.
Radii grow by one: in round r each query still open looks up, in every index, the values that differ from its own in
exactly r bits; queries are dealt to tasks by the number of these probes. After round r every code
within a Hamming distance of ``segments * (r + 1) - 1`` has been met (one of its parts lies within r), so a query is closed
once its k-th verified distance is no more than that: nothing unseen can be nearer, ties included. A code is verified once,
in the round and index where it first turns up, so no pair is made twice. Equal codes are one class with its k + 1 least
ids, which is exact. Rows with a null id or vector, or a null or non-finite component, take no part. Ties go to the smaller
id; fewer than k rows give all there are; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import lean, table
from wayfold.llm.vectors import nearest, usable

TASK_PROBES = 500_000


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, code): bit j of a code (of its word j div 64, where it has several) says whether component j is above 0; and the
    number of bits."""
    rows = usable(vectors, id_col, vec_col, drop_zero=False)
    first = rows.select(F.octet_length("vec").alias("n")).first()
    bits = (first["n"] if first else 8) // 8

    def pack(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(batch.num_rows, bits) > 0
            padded = np.concatenate([x, np.zeros((len(x), -bits % 64), bool)], axis=1)
            words = np.ascontiguousarray(np.packbits(padded, axis=1, bitorder="little")).view("<i8")
            code = pa.array(words[:, 0]) if bits <= 64 else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), code], names=["id", "code"])

    return rows.mapInArrow(lean(pack), f"id long, code {'long' if bits <= 64 else 'array<long>'}"), bits


def _mask(width: int) -> int:
    """The lowest ``width`` bits, as a signed 64-bit number."""
    return (1 << width) - 1 if width < 64 else -1


def search(codes: DataFrame, bits: int, asks, k: int = 10, segments: int | None = None, owner: str = "query") -> DataFrame:
    """The k nearest codes of each row for whose id ``asks(id)`` is true: query_id, rank, vec_id, distance."""
    words = max(1, -(-bits // 64))
    own, asked = [f"c{i}" for i in range(words)], [f"q{i}" for i in range(words)]
    rows = table(codes.select("id", *[(F.col("code") if words == 1 else F.get("code", F.lit(i))).alias(c) for i, c in enumerate(own)]), "mih-rows", owner)
    w = Window.partitionBy(*own).orderBy("id")
    base = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1).groupBy(*own).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    base = table(base, "mih-codes", owner)
    asking = table(rows.filter(asks(F.col("id"))).select(*[F.col(c).alias(q) for c, q in zip(own, asked, strict=True)], F.col("id").alias("query_id")), "mih-asking", owner)
    total = rows.count()
    # parts of about log2(rows) bits, none across two words
    bounds: list[tuple[int, int, int]] = []  # word, first bit, width
    for i in range(words):
        n = min(64, bits - 64 * i)
        m = max(1, min(n, round((segments or bits / log2(max(4, total))) * n / bits)))
        bounds += [(i, n * j // m, n * (j + 1) // m - n * j // m) for j in range(m)]
    segments = len(bounds)
    part = lambda c, j: F.shiftrightunsigned(c[bounds[j][0]], bounds[j][1]).bitwiseAND(F.lit(_mask(bounds[j][2])))
    pieces = F.array(*[F.struct(F.lit(j).alias("seg"), part([F.col(c) for c in own], j).alias("val")) for j in range(segments)])
    index = base.select(*own, "ids", F.explode(pieces).alias("p")).select(*own, "ids", "p.seg", "p.val")

    def flip(batches: Iterator[pa.RecordBatch], r: int) -> Iterator[pa.RecordBatch]:
        """For each query and index the values that differ from its own in exactly ``r`` bits."""
        for batch in batches:
            q = [batch.column(c).to_numpy().view(np.uint64) for c in asked]
            for j, (word, first, width) in enumerate(bounds):
                masks = np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], dtype=np.uint64)
                mine = (q[word] >> np.uint64(first)) & np.uint64(_mask(width) & (2**64 - 1))
                for lo in range(0, len(mine) if len(masks) else 0, 256):
                    val = (mine[lo : lo + 256, None] ^ masks).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(x[lo : lo + 256], len(masks)).view(np.int64)) for x in q], pa.array(np.full(len(val), j, np.int32)), pa.array(val)], names=[*asked, "seg", "val"])

    need = min(k, max(0, total - 1)) + 1  # a query's own row counts at distance 0
    active = table(asking.select(*asked).distinct(), "mih-active", owner)
    kinds = ", ".join(f"{c} long" for c in asked)
    best = None
    for r in range(max(width for *_, width in bounds) + 1):
        each = sum(comb(width, r) for *_, width in bounds)  # probes a query
        tasks = max(1, active.count() * each // TASK_PROBES)
        met = active.repartition(tasks).mapInArrow(lean(lambda x, r=r: flip(x, r)), f"{kinds}, seg int, val long").join(index.hint("merge"), ["seg", "val"])
        apart = [F.col(q).bitwiseXOR(F.col(c)) for q, c in zip(asked, own, strict=True)]
        dists = F.array(*[F.bit_count(part(apart, j)) for j in range(segments)])
        once = (F.array_min(dists) == r) & (F.array_position(dists, r) == F.col("seg") + 1)
        distance = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
        met = met.filter(once).select(*asked, "ids", distance.alias("distance"))
        seen = met.withColumn("id", F.explode("ids")).select(*asked, "distance", "id")
        if best is not None:
            seen = seen.unionByName(best.join(active, asked, "left_semi"))
        top = Window.partitionBy(*asked).orderBy("distance", "id")
        now = table(seen.withColumn("rn", F.row_number().over(top)).filter(F.col("rn") <= k + 1).drop("rn"), f"mih-best{r}", owner)
        proven = now.groupBy(*asked).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).filter((F.col("n") >= need) & (F.col("far") <= segments * (r + 1) - 1))
        best = now if best is None else table(best.join(active, asked, "left_anti").unionByName(now), f"mih-all{r}", owner)
        active = table(active.join(proven, asked, "left_anti"), f"mih-open{r}", owner)
        if active.isEmpty():
            break
    q = F.array(*asked).alias("q")
    return nearest(best.select(q, F.array("id").alias("ids"), "distance"), asking.select(q, "query_id"), k, [F.asc("distance")]).select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
