"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

A document longer than a bin is cut into full bins and a rest. Rests are packed largest first: bins lie in the order of
their free room, each with bitmaps of the sources and of the duplicate clusters it holds, and a document goes to the
tightest bin that has room and no conflict: the search starts at the least sufficient room and takes successor after
successor until a compatible bin is found, else it opens a bin. A bin never holds two rows of a duplicate cluster (near copies
of each other by way of any number of documents: word 5-grams, Jaccard 0.8 or more; or rows that share a key the caller names,
or a text), nor more than ``max_per_source`` documents of a source (one bitmap plane for each). The bitmaps are exact: a bit for each source and
each cluster with several members among the rows of a shard.

Rows are dealt into shards of about ``shard_rows`` by a hash of their row number, so no key decides where a row goes and a
hot source or cluster is spread; each shard packs by itself. Rows of size 0 (null or empty text) get no bin. Null sources
are a source, null clusters conflict with nothing. Ties in size go by id and row number. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import jaccard
from wayfold.llm.common import WORD, table

CAPACITY = 2048
SHARD_ROWS = 8192
MAX_PER_SOURCE = 2
PACKED = "row_no long, doc_id long, piece int, from_token long, n_tokens long, bin_id long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, max_per_source: int, copies: list[int] | None = None) -> list[int]:
    """The bin of each item, in the order given. ``clusters``, and ``copies`` of the same numbering: -1 conflicts with nothing."""
    room: list[int] = []  # free room << 32 | bin, ascending
    planes: list[list[int]] = []  # of each bin: source bitmaps
    held: list[int] = []  # of each bin: cluster bitmap
    out = []
    for size, source, cluster, copy in zip(sizes, sources, clusters, copies or [-1] * len(sizes), strict=True):
        bit, mark = 1 << source, (1 << cluster if cluster >= 0 else 0) | (1 << copy if copy >= 0 else 0)
        found = -1
        for at in range(bisect_left(room, size << 32), len(room)):
            b = room[at] & 0xFFFFFFFF
            if not held[b] & mark and any(not p & bit for p in planes[b]):
                found = b
                free = (room.pop(at) >> 32) - size
                break
        if found < 0:
            found, free = len(held), capacity - size
            planes.append([0] * max_per_source)
            held.append(0)
        plane = next(i for i, p in enumerate(planes[found]) if not p & bit)
        planes[found][plane] |= bit
        held[found] |= mark
        if free:
            insort(room, free << 32 | found)
        out.append(found)
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS, owner: str = "query") -> DataFrame:
    """Pack ``items`` (doc_id long, source string, cluster long, size long; row_no long and copy long where it has them); one row
    (``PACKED``) a piece. Rows of one cluster, and rows of one copy, never share a bin."""
    row_no = F.col("row_no") if "row_no" in items.columns else F.monotonically_increasing_id().alias("row_no")
    copy = F.col("copy") if "copy" in items.columns else F.lit(None).cast("long").alias("copy")
    base = table(items.select(row_no, "doc_id", "source", "cluster", copy, "size"), "pack-items", owner)
    shards = max(1, -(-base.count() // shard_rows))
    base = base.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0]) << 32
        rows = rows.assign(rest=rows["size"] % capacity)
        src = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        marks, used = {}, 0
        for kind in ("cluster", "copy"):
            many = rows[kind].notna() & rows.duplicated(kind, keep=False) & (rows["rest"] > 0)
            marks[kind] = pd.Series(-1, index=rows.index)
            number, names = pd.factorize(rows.loc[many, kind])
            marks[kind][many] = number + used
            used += len(names)
        rows = rows.assign(src=src, clu=marks["cluster"], cop=marks["copy"]).sort_values(["rest", "doc_id", "row_no"], ascending=[False, True, True])
        some = rows[rows["rest"] > 0]
        bins = best_fit(some["rest"].tolist(), some["src"].tolist(), some["clu"].tolist(), capacity, max_per_source, some["cop"].tolist())
        out = [
            some.assign(piece=(some["size"] // capacity), from_token=some["size"] - some["rest"], n_tokens=some["rest"], bin_id=[shard | b for b in bins]),
            (empty := rows[rows["size"] == 0]).assign(piece=0, from_token=0, n_tokens=0, bin_id=pd.Series(pd.NA, index=empty.index, dtype="Int64")),
        ]
        full = rows[rows["size"] >= capacity]
        full = full.loc[full.index.repeat(full["size"] // capacity)]
        if len(full):
            piece = full.groupby("row_no").cumcount()
            first = max(bins, default=-1) + 1
            out.append(full.assign(piece=piece, from_token=piece * capacity, n_tokens=capacity, bin_id=[shard | (first + i) for i in range(len(full))]))
        got = pd.concat([x[["row_no", "doc_id", "piece", "from_token", "n_tokens", "bin_id"]].astype({"bin_id": "Int64", "doc_id": "Int64"}) for x in out if len(x)])
        return got

    return base.groupBy("shard").applyInPandas(one, PACKED)


def items(docs: DataFrame, cluster: str | None = None, extra: dict | None = None) -> DataFrame:
    """Documents as items: size in words, duplicate cluster by the hash of the text (empty: none). With ``cluster``, a column,
    rows that agree in it (nulls agree too) are a cluster, and rows of equal text copies."""
    text = F.col("text")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    own = F.when(size > 0, F.xxhash64(text))
    marks = [own.alias("cluster")] if cluster is None else [F.when(size > 0, F.xxhash64(cluster)).alias("cluster"), own.alias("copy")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *marks, size.alias("size"), *[c for c in ("row_no",) if c in docs.columns], *[v.alias(k) for k, v in (extra or {}).items()])


def near_items(docs: DataFrame, owner: str = "query") -> DataFrame:
    """Documents as items whose clusters are the components of near copies. Sizes are counted where the join reads the texts, and
    sources come along with it, so texts are not read again."""
    own = {"source": F.col("source").cast("string"), "copy": F.xxhash64("text")}
    group = jaccard.near_duplicates(docs, ngram=5, percent=80, owner=owner, every=False, carry=own)
    return group.select("doc_id", "source", F.col("root").alias("cluster"), F.when(F.col("n_words") > 0, F.col("copy")).alias("copy"), F.col("n_words").alias("size"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS, owner: str = "query", cluster: str | None = None) -> DataFrame:
    """Pack ``docs`` (doc_id, source, text): clusters are near copies, or rows that agree in the column ``cluster``."""
    return pack(near_items(docs, owner) if cluster is None else items(docs, cluster), capacity, max_per_source, shard_rows, owner)
