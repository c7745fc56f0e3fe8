"""Mixing sources to target weights by fixed-length token blocks.

Every source is one long stream of tokens: its documents in the order of a hash of their row. Streams are cut into blocks of
``block_tokens``; those of a source of less than ``LEAST_BLOCKS`` such blocks into as many shorter ones, so that whole blocks
come within about 1 % of its target too. Targets follow the weights by water-filling, no source above ``max_repeat`` times its size. The output is
a sequence of shards of ``shard_slots`` slots; the count of slots that each source gets in each shard is drawn by splitting
the quotas along a binary tree of shards (a multivariate hypergeometric draw at each node, seeded by the node): that is the
multinomial draw, given that the totals are the quotas, and every shard can be drawn by itself on any executor. The i-th
slot of a source takes block ``permutation(i mod n)`` of round ``i div n`` (a Feistel network with cycle walking, so no
permutation is stored), and slots meet documents by an equi-join on (source, block).

Null or empty texts have size 0 and are never taken. Null sources are a source of their own, the last. Rows may repeat, ids
may be null or tie: each row counts by itself. An empty table gives no rows. Other columns (of clashing names too) are passed on
by ``mixed_documents`` and not read otherwise. Reruns agree: all draws hang on ``seed`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import WORD, column_bytes, lean, slices, table, words

BLOCK_TOKENS = 64
SHARD_SLOTS = 1024
LEAST_BLOCKS = 128
_DRAW_LIMIT = 500_000_000


def targets(sizes: list[int], weights: list[float], total: float, max_repeat: float = 2.0) -> list[float]:
    """Share ``total`` by weight; what is above ``max_repeat`` times a source's size is shared again by weight."""
    caps = [max_repeat * s for s in sizes]
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight >= caps[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _hyper(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Hypergeometric draw, by its normal limit where numpy's own goes no further."""
    if draws <= 0 or good <= 0:
        return 0
    if bad <= 0 or draws >= good + bad:
        return min(good, draws)
    if good < _DRAW_LIMIT and bad < _DRAW_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    mean = draws * good / n
    sd = (mean * (bad / n) * ((n - draws) / max(1, n - 1))) ** 0.5
    return int(min(good, draws, max(0, draws - bad, round(rng.normal(mean, sd)))))


def draw_shard(quotas: list[int], shard_slots: int, shard: int, seed: int) -> tuple[list[int], list[int]]:
    """Slots of each source in a shard, and the first index of each in its source's stream of slots."""
    total = sum(quotas)
    shards = max(1, -(-total // shard_slots))
    counts, starts, lo, hi = list(quotas), [0] * len(quotas), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        here, left_slots = sum(counts), (mid - lo) * shard_slots
        left, slots, rest = [], min(left_slots, here), here
        for c in counts:
            x = _hyper(rng, c, rest - c, slots)
            left.append(x)
            rest -= c
            slots -= x
        if shard < mid:
            counts, hi = left, mid
        else:
            starts = [a + b for a, b in zip(starts, left, strict=True)]
            counts, lo = [c - x for c, x in zip(counts, left, strict=True)], mid
    return counts, starts


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), for the given indices: four Feistel rounds, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            f = (right + np.uint64((key * 4 + r + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f = f * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def lay_out(docs: DataFrame, owner: str = "query") -> DataFrame:
    """Each row of ``docs`` (row_key, doc_id, source, size) with ``first``, its place in its source's stream of tokens.

    Prefix sums in two steps, so that a source with a third of all rows is spread: sums by (source, bucket) with buckets of
    a hash, their running totals, then running sums inside each bucket."""
    rows = docs.count()
    buckets = max(8, rows // 2048)
    docs = docs.withColumn("bucket", F.pmod("row_key", F.lit(buckets)).cast("int"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    parts = max(1, buckets // 4096)  # running totals of very many buckets go in two steps themselves
    w = Window.partitionBy("source", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("part", F.floor(F.col("bucket") * F.lit(parts) / F.lit(buckets)).cast("int")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    tops = sums.groupBy("source", "part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.alias("s").join(tops.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.part") == F.col("t.part"))).select("s.source", "s.bucket", (F.col("before") + F.col("base")).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("row_key", "doc_id", "size", "_wf_row").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket"))).select("d.row_key", "d._wf_row", "d.doc_id", "d.source", "d.size", (F.col("start") + F.col("inside")).cast("long").alias("first"))


def sized(docs: DataFrame) -> DataFrame:
    """Each row's hash (its place in the order), number (if ``docs`` has _wf_row), doc_id, source and size in words."""
    number = F.col("_wf_row") if "_wf_row" in docs.columns else F.lit(0).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.xxhash64("doc_id", "source", "text").alias("row_key"), number.alias("_wf_row"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 7, owner: str = "query"
) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` (doc_id, source, text). Returns (documents, slots).

    documents: row_key, doc_id, source, size, first, source_size, target, n_blocks, quota, block_tokens: where each document lies in its
    source's stream. slots: shard, source_no, block, source: the mix itself, a block of a source for each output slot.
    Only one row a source reaches the driver."""
    spark = docs.sparkSession
    base = table(sized(docs), "mix-sizes", owner)
    by = base.groupBy("source").agg(F.sum("size").alias("n")).collect()
    by = sorted(by, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))  # UTF-8 order is code-point order
    sizes = [int(r["n"] or 0) for r in by]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(by))], share * sum(sizes), max_repeat)
    steps = [max(1, min(block_tokens, s // LEAST_BLOCKS)) for s in sizes]
    blocks = [-(-s // step) for s, step in zip(sizes, steps, strict=True)]
    quotas = [min(max_repeat * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, goal, blocks, strict=True)]
    facts = spark.createDataFrame(
        [(i, r["source"], s, float(t), b, q, step) for i, (r, s, t, b, q, step) in enumerate(zip(by, sizes, goal, blocks, quotas, steps, strict=True))],
        "source_no int, source string, source_size long, target double, n_blocks long, quota long, block_tokens long",
    )
    placed = lay_out(base, owner).alias("d").join(F.broadcast(facts).alias("f") if len(by) < 10_000 else facts.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")))
    placed = placed.select("d.row_key", "d._wf_row", "d.doc_id", "d.source", "d.size", "d.first", "f.source_no", "f.source_size", "f.target", "f.n_blocks", "f.quota", "f.block_tokens")
    shards = -(-sum(quotas) // shard_slots)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, starts = draw_shard(quotas, shard_slots, shard, seed)
                number, block = [], []
                for s, (c, a) in enumerate(zip(counts, starts, strict=True)):
                    if c:
                        index = np.arange(a, a + c)
                        rounds, place = index // blocks[s], index % blocks[s]
                        got = np.empty(c, np.int64)
                        for r in np.unique(rounds):
                            got[rounds == r] = permute(place[rounds == r], blocks[s], seed * 1_000_003 + s * 31 + int(r))
                        number.append(np.full(c, s, np.int32))
                        block.append(got)
                if number:
                    number, block = np.concatenate(number), np.concatenate(block)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), shard, np.int64)), pa.array(number), pa.array(block)], names=["shard", "source_no", "block"])

    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism + shards // 256))
    slots = spark.range(0, shards, 1, tasks).mapInArrow(lean(fill), "shard long, source_no int, block long")
    return placed, slots


def pieces(placed: DataFrame) -> DataFrame:
    """Each document's share of each block it lies in: source_no, block, from_token, n (tokens of the document)."""
    last = F.col("first") + F.col("size")
    cut = placed.filter("size > 0 and quota > 0").withColumn("block", F.explode(F.expr("sequence(first div block_tokens, (first + size - 1) div block_tokens)")))
    lo, hi = F.greatest(F.col("first"), F.col("block") * F.col("block_tokens")), F.least(last, (F.col("block") + 1) * F.col("block_tokens"))
    return cut.select("source_no", "block", "row_key", "_wf_row", "doc_id", "size", "first", (lo - F.col("first")).alias("from_token"), (hi - lo).alias("n"))


def taken(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """Per document: the words that the mix takes of it, repeats counted."""
    used = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    key = ["source_no", "first", "row_key", "doc_id", "size"]
    got = pieces(placed).join(used.hint("merge"), ["source_no", "block"]).groupBy(*key).agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    a, b = placed.alias("a"), got.alias("b")
    same = (F.col("a.source_no") == F.col("b.source_no")) & (F.col("a.first") == F.col("b.first")) & (F.col("a.size") == F.col("b.size"))
    return a.join(b.hint("merge"), same, "left").select("a.doc_id", "a.source", "a.row_key", "a.size", "a.source_size", "a.target", F.coalesce(F.col("b.taken"), F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, owner: str = "query", block_tokens: int = BLOCK_TOKENS, **how) -> DataFrame:
    """The mix as documents: a row of ``docs`` for each time it is taken, its text the words of the blocks taken that time
    (the text itself where all are), stretches that don't adjoin parted by a line break. n_chars follows the text."""
    names = docs.columns
    base = table(docs.withColumn("_wf_row", F.monotonically_increasing_id()), "mix-docs", owner)
    placed, slots = mix_sources(base, block_tokens=block_tokens, owner=owner, **how)
    used = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).cast("int").alias("times"))
    part = pieces(placed).join(used.hint("merge"), ["source_no", "block"]).groupBy("_wf_row").agg(F.sort_array(F.collect_list(F.struct("from_token", "n", "times"))).alias("_wf_parts"))
    both = base.join(part.hint("merge"), "_wf_row").select(*names, "_wf_parts")
    schema = docs.schema
    at, has_n = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            data, offsets = column_bytes(whole.column("text"))
            for i, j in slices(offsets, 4 << 20):
                batch = whole.slice(i, j - i)
                row, text = [], []
                for d, parts in enumerate(batch.column("_wf_parts").to_pylist()):
                    own = data[offsets[i + d] : offsets[i + d + 1]]
                    starts, ends, _ = words(own, np.array([0, len(own)]))
                    raw = own.tobytes()
                    for time in range(1, max(p["times"] for p in parts) + 1):
                        runs: list[list[int]] = []
                        for p in parts:
                            if p["times"] >= time:
                                if runs and runs[-1][1] == p["from_token"]:
                                    runs[-1][1] += p["n"]
                                else:
                                    runs.append([p["from_token"], p["from_token"] + p["n"]])
                        row.append(d)
                        text.append((raw if runs == [[0, len(starts)]] else b"\n".join(raw[starts[a] : ends[b - 1]] for a, b in runs)).decode())
                columns = list(pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).take(pa.array(row, pa.int64())).columns)
                columns[at] = pa.array(text, pa.string())
                if has_n >= 0:
                    columns[has_n] = pa.array([len(x) for x in text]).cast(columns[has_n].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(lean(cut), schema)
