"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Unit vectors are projected on ``hashes`` Gaussian directions a table and cut into cells of ``width``; the cells of a table
make a bucket. A query does not look into its own bucket only: from the distances of its projections to the cell walls
follows how likely a neighbour at the expected distance (``reach``) lies in each bucket, and it visits buckets in the order
of that likelihood until, over all tables, the estimated chance to meet such a neighbour is ``success``. The candidates of
all tables are merged and ranked by the exact cosine of the original vectors.

``reach`` comes from a bounded sample (at most about ``sample_rows`` rows: only the spread of cosines is measured). Every
row is indexed and every probed bucket is read whole. Buckets are dealt into parts of about ``part_rows`` rows; a bucket of
more rows is dealt by a hash of the row as well, and its queries go to each of its parts. Equal vectors are one class, kept
with its k + 1 least ids, which is exact and keeps large groups of copies off one task. Queries that have met fewer than k
candidates are answered by a scan of all rows, in blocks of queries. Rows that ``vectors.usable`` leaves out take no part.
An empty table gives no rows. Other columns, whatever their names, are not read; ties in score go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import lean, mix, signed, table
from wayfold.llm.vectors import classes, nearest, usable

TABLES, WIDTH, SUCCESS = 4, 1.5, 0.96
SAMPLE_ROWS, PART_ROWS, SCAN_BLOCK = 2000, 4096, 2048
_HEAVY_LIMIT, BLOCK_PAIRS = 10_000, 1_000_000


def _unit(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    return x, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.17, good to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


class Family:
    """``tables`` p-stable hash functions of ``hashes`` directions each."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a, self.b, self.width = rng.normal(size=(tables, dim, hashes)), rng.uniform(0, width, (tables, hashes)), width

    def project(self, unit: np.ndarray, t: int) -> np.ndarray:
        return unit @ self.a[t] + self.b[t]

    def key(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), np.uint64)
        for k in range(cells.shape[1]):
            out = mix(out ^ (cells[:, k].astype(np.int64).view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        return signed(out)

    def probes(self, spot: np.ndarray, reach: float, chance: float) -> np.ndarray:
        """Cells of the buckets to visit, most likely first, until their estimated chance adds up to ``chance``.

        Buckets are the perturbations of the query's own: a cell to either side in some directions. Those above a threshold of
        likelihood are put together direction by direction, leaving out what can't get there any more, and the threshold falls
        until there are enough; so the work follows the number of buckets visited, not the number of all."""
        cells, likely = [], []
        for x in spot:
            lo, hi = int(np.floor((x - 3.5 * reach) / self.width)), int(np.floor((x + 3.5 * reach) / self.width))
            p = np.diff(_normal_cdf((np.arange(lo, hi + 2) * self.width - x) / reach))
            order = np.argsort(-p, kind="stable")
            order = order[p[order] > 1e-3]
            cells.append(lo + order)
            likely.append(p[order])
        best = np.cumprod([1.0, *(p[0] for p in likely[::-1])])[::-1]  # what the directions from each on can still contribute
        least = best[0] / 2
        while True:
            sums, picks = np.ones(1), [np.zeros(1, np.int64)]
            for d, p in enumerate(likely):
                grown = sums[:, None] * p
                at, cell = np.nonzero(grown * best[d + 1] >= least)
                sums, picks = grown[at, cell], [*(x[at] for x in picks), cell]
            if sums.sum() >= chance or least < best[0] * 1e-3 ** len(likely):
                order = np.argsort(-sums, kind="stable")
                n = int(np.searchsorted(np.cumsum(sums[order]), chance)) + 1
                return np.stack([c[x[order[:n]]] for c, x in zip(cells, picks[1:], strict=True)], axis=1)
            least /= 4


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each q."""
    order = np.lexsort((c, -s, q))
    first = np.r_[True, q[order][1:] != q[order][:-1]]
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def search(vectors: DataFrame, asks, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, hashes: int | None = None, width: float = WIDTH, success: float = SUCCESS, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 5, owner: str = "query") -> DataFrame:
    """The k nearest rows of each row for whose id the Column ``asks(id)`` is true: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = table(usable(vectors, id_col, vec_col), "ann-rows", owner)
    base = table(classes(rows, k + 1), "ann-classes", owner)
    asking = rows.filter(asks(F.col("id"))).join(base.select("vec", F.col("class_id").alias("q")), "vec").select("q", F.col("id").alias("query_id"))
    asking = table(asking, "ann-asking", owner)
    n = base.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    hashes = hashes or max(4, round(log(max(n, 2) / 4) / log(5)))
    sample = [bytes(r["vec"]) for r in base.filter(F.pmod(F.xxhash64("class_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(min(1.0, sample_rows / n) * (1 << 20)))).select("vec").limit(2 * sample_rows).collect()]
    reach = 1.0
    if len(sample) > 20:
        _, u = _unit(sample)
        cos = (u[: len(u) // 2] @ u[len(u) // 2 :].T).ravel()
        goal = min(1.0, float(cos.mean() + cos.std() * NormalDist().inv_cdf(1 - min(0.5, k / n))))
        reach = max(0.2, sqrt(max(0.0, 2 - 2 * goal)))
    dim = len(base.select("vec").first()["vec"]) // 8
    family = Family(dim, tables, hashes, width, seed)
    chance = 1 - (1 - success) ** (1 / tables)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, u = _unit(batch.column("vec").to_pylist())
                for t in range(tables):
                    key = family.key(np.floor(family.project(u, t) / width))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), batch.column("class_id"), batch.column("vec")], names=["t", "bucket", "c", "vec"])

    laid = base.select("class_id", "vec").mapInArrow(lean(index), "t int, bucket long, c long, vec binary")
    sizes = laid.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n"))
    heavy_from = max(4 * part_rows, tables * n // _HEAVY_LIMIT + 1)  # so at most _HEAVY_LIMIT buckets are heavy
    heavy = {(r["t"], r["bucket"]): -(-r["n"] // part_rows) for r in sizes.filter(F.col("n") >= heavy_from).collect()}
    parts = max(1, -(-n // part_rows))

    def place(t: int, buckets: np.ndarray, spread: np.ndarray | None) -> list[np.ndarray]:
        """Part of each bucket; with ``spread`` (hashes of rows) of each row."""
        home = t * parts + buckets.view(np.uint64) % np.uint64(parts)
        out = [home.astype(np.int64)]
        if heavy:
            for (ht, hb), m in heavy.items():
                if ht == t and (at := np.flatnonzero(buckets == hb)).size:
                    extra = (tables + 1) * parts + (hb % (1 << 40)) * 4096
                    if spread is not None:
                        out[0][at] = extra + (spread[at] % np.uint64(m)).astype(np.int64)
                    else:
                        out[0][at] = -1
                        out.append(extra + np.arange(m))
        return out

    def to_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(part=np.int64(0))
            for t in pdf["t"].unique():
                at = pdf["t"] == t
                pdf.loc[at, "part"] = place(int(t), pdf.loc[at, "bucket"].to_numpy(), mix(pdf.loc[at, "c"].to_numpy().view(np.uint64)))[0]
            yield pdf[["part", "bucket", "c", "vec"]]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("vec").to_pylist()
            _, u = _unit(raw)
            out: list[tuple] = []
            for t in range(tables):
                spots = family.project(u, t)
                for i, q in enumerate(batch.column("class_id").to_pylist()):
                    buckets = family.key(family.probes(spots[i], reach, chance))
                    home, *more = place(t, buckets, None)
                    for p in np.unique(home[home >= 0]):
                        out.append((int(p), q, buckets[home == p].tobytes(), raw[i]))
                    gone = buckets[home < 0]
                    for extra in more:  # a heavy bucket: all its parts
                        hb = [b for b in gone if (tables + 1) * parts + (int(b) % (1 << 40)) * 4096 == int(extra[0])]
                        out.extend((int(p), q, np.array(hb, np.int64).tobytes(), raw[i]) for p in extra)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(("part", "q", "buckets", "vec"), x, strict=True)) for x in out], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "q", "buckets", "vec"), x, strict=True)) for x in out], schema=schema)

    schema = pa.schema([("part", pa.int64()), ("q", pa.int64()), ("buckets", pa.binary()), ("vec", pa.binary())])
    who = asking.select(F.col("q").alias("class_id")).distinct()
    probes = base.join(who, "class_id").select("class_id", "vec").mapInArrow(lean(ask), "part long, q long, buckets binary, vec binary")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return none
        left = left.sort_values("bucket", kind="stable")
        x, ux = _unit(left["vec"].tolist())
        y, uy = _unit(right["vec"].tolist())
        bucket = left["bucket"].to_numpy()
        asked = [np.frombuffer(b, np.int64) for b in right["buckets"]]
        which, wants = np.repeat(np.arange(len(asked)), [len(a) for a in asked]), np.concatenate(asked)
        order = np.argsort(wants, kind="stable")
        which, wants = which[order], wants[order]
        got, held = [], 0

        def reduce(got: list) -> list:
            q, c, s = (np.concatenate(z) for z in zip(*got, strict=True))
            keep = _best(q, c, s, k + 3)
            return [(q[keep], c[keep], s[keep])]

        there, starts = np.unique(bucket, return_index=True)
        for b, lo, hi in zip(there, starts, np.r_[starts[1:], len(bucket)], strict=True):
            a, z = np.searchsorted(wants, [b, b], side="left")[0], np.searchsorted(wants, b, side="right")
            if a == z:
                continue
            step = max(1, BLOCK_PAIRS // (hi - lo))
            for at in range(a, z, step):
                qs = which[at : min(z, at + step)]
                s = uy[qs] @ ux[lo:hi].T
                got.append((np.repeat(qs, hi - lo), np.tile(np.arange(lo, hi), len(qs)), s.ravel()))
                held += s.size
                if held >= BLOCK_PAIRS:
                    got, held = reduce(got), 0
        if not got:
            return none
        ((q, c, _),) = reduce(got)
        return pd.DataFrame({"q": right["q"].to_numpy()[q], "c": left["c"].to_numpy()[c], "score": _cosine(y[q], x[c])})

    found = laid.mapInPandas(to_parts, "part long, bucket long, c long, vec binary").groupBy("part").cogroup(probes.groupBy("part")).applyInPandas(meet, "q long, c long, score double")
    hits = found.groupBy("q", "c").agg(F.max("score").alias("score")).join(base.select(F.col("class_id").alias("c"), "ids"), "c").select("q", "ids", "score")
    out = table(nearest(hits, asking, k, [F.desc("score")]).select("query_id", "rank", "vec_id", "score"), "ann-out", owner)
    enough = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, rows.count() - 1))
    short = table(asking.join(enough, "query_id", "left_anti"), "ann-short", owner)
    if short.isEmpty():
        return out
    scanned = nearest(_scan(base, short.select("q").distinct().join(base.select(F.col("class_id").alias("q"), "vec"), "q"), k), short, k, [F.desc("score")])
    return out.join(short.select("query_id"), "query_id", "left_anti").unionByName(scanned.select("query_id", "rank", "vec_id", "score"))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosine of rows; summed the same way wherever a pair is met."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _scan(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Every class of ``base`` against the query classes (q, vec), in blocks of SCAN_BLOCK queries."""
    out, last = None, None
    while True:
        block = (asked if last is None else asked.filter(F.col("q") > last)).orderBy("q").limit(SCAN_BLOCK).collect()
        if not block:
            return out
        last = block[-1]["q"]
        ids, (y, uy) = np.array([r["q"] for r in block]), _unit([bytes(r["vec"]) for r in block])

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, y=y, uy=uy) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, ux = _unit(batch.column("vec").to_pylist())
                    s = uy @ ux.T
                    q, c = np.divmod(np.arange(s.size), s.shape[1])
                    keep = _best(q, c, s.ravel(), k + 3)
                    q, c = q[keep], c[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column("ids").take(pa.array(c)), pa.array(_cosine(y[q], x[c]))], names=["q", "ids", "score"])

        part = base.select("vec", "ids").mapInArrow(lean(scan), "q long, ids array<long>, score double")
        out = part if out is None else out.unionByName(part)
