"""Banded MinHash over sets of codes, exact Jaccard pairs, and what is built on them."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP, PERSONAL = (108, 27), (260, 65)  # hashes and bands, for devices of a day and for days of a device


def family(hashes: int, seed: int = 7) -> list[tuple[int, int]]:
    """Coefficients of ``hashes`` functions (a x + b) mod p; they are reduced modulo p where they are used."""
    rng = random.Random(seed)
    return [(rng.randrange(1, 1 << 31), rng.randrange(0, 1 << 31)) for _ in range(hashes)]


def dense_codes(vectors: DataFrame, key: str) -> DataFrame:
    """``vectors`` (key, id, codes) with the codes of each key numbered from 0 in their order, and p, the least prime above
    the number of codes. Numbering runs inside a slot of a key, and the slots' sizes say where each begins, so a day is not
    one task's work."""
    each = vectors.select(key, F.explode(F.array_distinct("codes")).alias("code")).distinct().withColumn("slot", F.shiftright("code", 45))
    sizes = each.groupBy(key, "slot").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.select(key, "slot", (F.sum("n").over(Window.partitionBy(key).orderBy("slot")) - F.col("n")).alias("begin"))
    inside = each.withColumn("rn", F.row_number().over(Window.partitionBy(key, "slot").orderBy("code")) - 1)
    numbered = inside.join(begins, [key, "slot"]).select(key, "code", (F.col("begin") + F.col("rn")).alias("x"))
    count = sizes.groupBy(key).agg(F.sum("n").alias("n"))
    divides = lambda x: F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(x)).cast("int"))), lambda d: (x % d == 0) & (d < x))
    ahead = F.sequence((F.col("n") + 1).cast("int"), (F.col("n") + 500).cast("int"))  # no gap between primes of 32 bits is wider
    count = count.withColumn("p", F.array_min(F.filter(ahead, lambda x: (x >= 2) & ~divides(x))))
    out = vectors.select(key, "id", F.explode(F.array_distinct("codes")).alias("code")).join(numbered, [key, "code"])
    return out.groupBy(key, "id").agg(F.sort_array(F.collect_list("x")).alias("xs")).join(count.select(key, "p"), key)


def signatures(dense: DataFrame, hashes: int, seed: int = 7) -> DataFrame:
    """Column sig: the least hash of each function over the ids xs, all functions of a set at once (Arrow batches: the native
    fold of hashes x ids lambdas is interpreted)."""
    a, b = (np.array(v, dtype=np.int64) for v in zip(*family(hashes, seed), strict=True))

    def least(xs: pd.Series, p: pd.Series) -> pd.Series:
        def one(x: np.ndarray, q: int) -> np.ndarray:
            out = np.full(hashes, np.iinfo(np.int64).max)
            first, add = (a % (q - 1) + 1)[:, None], (b % q)[:, None]
            for lo in range(0, len(x), 4096):  # q < 2**31, so products fit
                out = np.minimum(out, ((first * x[None, lo : lo + 4096] + add) % q).min(axis=1))
            return out

        return pd.Series([one(np.asarray(x, dtype=np.int64), int(q)) for x, q in zip(xs, p, strict=True)])

    return dense.withColumn("sig", F.pandas_udf(least, "array<long>")("xs", "p"))


def buckets(signed: DataFrame, key: str, bands: int, min_size: int = 2) -> DataFrame:
    """Members of each bucket (key, band, bucket) of at least ``min_size``; band of a hash is its number modulo ``bands``."""
    rows = F.size("sig") / F.lit(bands)
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), (rows - 1).cast("int")), lambda r: F.get("sig", r * bands + b)), "-"))
    laid = signed.select(key, "id", F.posexplode(band).alias("band", "bucket"))
    return laid.groupBy(key, "band", "bucket").agg(F.sort_array(F.collect_list("id")).alias("members")).filter(F.size("members") >= min_size)


def clusters(found: DataFrame, key: str) -> DataFrame:
    """Distinct member lists of each key with a number: cluster_id, members."""
    some = found.select(key, "members").distinct()
    return some.withColumn("cluster_id", F.row_number().over(Window.partitionBy(key).orderBy(F.array_join("members", ","))) - 1)


def cluster_pairs(grouped: DataFrame, key: str) -> DataFrame:
    """Pairs a < b of each cluster: key, a, b, cluster_id."""
    pair = F.flatten(F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return grouped.select(key, "cluster_id", F.explode(pair).alias("p")).select(key, "p.a", "p.b", "cluster_id")


def lsh_pairs(vectors: DataFrame, key: str = "day", hashes: int = GROUP[0], bands: int = GROUP[1], seed: int = 7, min_size: int = 2) -> DataFrame:
    """Pairs of ids of a key that share a band: key, a, b, cluster_id."""
    return cluster_pairs(clusters(buckets(signatures(dense_codes(vectors, key), hashes, seed), key, bands, min_size), key), key)


def jaccard_pairs(vectors: DataFrame, key: str = "day", least: float = 0.4) -> DataFrame:
    """Pairs of ids of a key whose sets of codes reach the similarity: key, a, b, similarity. An inverted index: codes that
    pairs share are counted after an equi-join on (key, code); no pair without a shared code is ever made."""
    sized = vectors.select(key, "id", F.array_distinct("codes").alias("codes")).withColumn("n", F.size("codes"))
    flat = sized.select(key, "id", "n", F.explode("codes").alias("code"))
    a, b = flat.alias("a"), flat.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.code") == F.col("b.code")) & (F.col("a.id") < F.col("b.id")))
    met = met.groupBy(F.col(f"a.{key}").alias(key), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("k"))
    return met.withColumn("similarity", F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).filter(F.col("similarity") >= least).select(key, "a", "b", "similarity")


def hits_against_exact(lsh: DataFrame, exact: DataFrame, key: str = "day") -> DataFrame:
    """Both kinds of pairs side by side: similarity (null if only LSH has it) and label LSH, JACCARD or LSH#JACCARD."""
    both = lsh.select(key, "a", "b", F.lit(None).cast("double").alias("similarity"), F.lit("LSH").alias("t")).distinct().unionByName(exact.select(key, "a", "b", "similarity", F.lit("JACCARD").alias("t")))
    return both.groupBy(key, "a", "b").agg(F.max("similarity").alias("similarity"), F.array_join(F.sort_array(F.collect_set("t"), asc=False), "#").alias("label"))


def cost_report(costs: DataFrame) -> DataFrame:
    """Costs (date, n, ms) as a row for each date: n and ms of each data set, ascending, as one text."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("n", "ms"))), lambda s: F.concat_ws(":", s["n"].cast("string"), s["ms"].cast("string")))
    return costs.groupBy("date").agg(F.array_join(each, ", ").alias("costs")).orderBy("date")


def timed_comparison(vectors: DataFrame, sizes: list[int], key: str = "day", least: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """For each number of devices (the first by name): LSH pairs against exact pairs, and what both took. Returns (hits, costs):
    label counts by date and size, most telling first, and (date, n, ms) of LSH."""
    import time

    spark = vectors.sparkSession
    hits, costs = None, []
    for n in sizes:
        some = vectors.join(vectors.select("id").distinct().orderBy("id").limit(n), "id", "left_semi").persist()
        dates = sorted(str(r[0]) for r in some.select(key).distinct().collect())  # a row a day
        for date in dates:
            own = some.filter(F.col(key).cast("string") == date)
            begin = time.perf_counter()
            found = lsh_pairs(own, key).persist()
            found.count()
            costs.append((date, n, int(1000 * (time.perf_counter() - begin))))
            told = hits_against_exact(found, jaccard_pairs(own, key, least), key).groupBy(F.lit(date).alias("date"), F.lit(n).alias("n"), "label").agg(F.count(F.lit(1)).alias("pairs"))
            told = spark.createDataFrame(told.collect(), told.schema)  # three labels at most
            hits = told if hits is None else hits.unionByName(told)
            found.unpersist()
        some.unpersist()
    return hits.orderBy("date", "n", F.reverse("label")), spark.createDataFrame(costs, "date string, n int, ms long")


def pair_report(pairs: DataFrame, key: str = "day", distinct_days: bool = True) -> DataFrame:
    """Pairs with the number of their hits and their days joined by '#', most hits first. Without ``distinct_days`` each
    cluster that a pair shares on a day counts."""
    seen = pairs.select(key, "a", "b").distinct() if distinct_days else pairs.select(key, "a", "b", "cluster_id").distinct()
    out = seen.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "#").alias("days"))
    return out.orderBy(F.desc("hits"), "a", "b")
