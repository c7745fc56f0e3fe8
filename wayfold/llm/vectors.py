"""Rows of a vector table as bytes: one dimension, finite, not zero."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import lean


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", drop_zero: bool = True) -> DataFrame:
    """(id, vec): vectors as float64 bytes. Rows with a null id or vector, a null or non-finite component, no component,
    only zeros (if ``drop_zero``) or another length than most rows take no part."""
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    dims = base.filter("id is not null and vec is not null").groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    dim = int(dims[0]["n"]) if dims else 0

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)  # null components become NaN
            x = flat.reshape(-1, dim) if dim else np.zeros((batch.num_rows, 0))
            ok = np.isfinite(x).all(axis=1)
            if drop_zero:
                ok &= (x != 0).any(axis=1)
            x = np.ascontiguousarray(x[ok] + 0.0)  # no negative zeros: equal vectors have equal bytes
            data = pa.Array.from_buffers(pa.binary(8 * max(dim, 1)), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok)), data], names=["id", "vec"])

    return base.filter(F.col("id").isNotNull() & (F.size("vec") == dim) & (F.size("vec") > 0)).mapInArrow(lean(take), "id long, vec binary")


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: class_id (its least id), vec, ids (its ``keep`` least ids, ascending)."""
    w = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("class_id"), "vec", "ids")


def nearest(hits: DataFrame, asking: DataFrame, k: int, order: list) -> DataFrame:
    """From hits (q: class of the query, ids of the found class, measures) the k nearest of each query row of ``asking`` (q, query_id),
    without itself; ``order`` sorts hits, ties go to the smaller id."""
    w = Window.partitionBy("q").orderBy(*order, "vec_id")
    top = hits.withColumn("vec_id", F.explode("ids")).drop("ids").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1).drop("rn")
    one = Window.partitionBy("query_id").orderBy(*order, "vec_id")
    return asking.join(top, "q").filter("vec_id != query_id").withColumn("rank", F.row_number().over(one)).filter(F.col("rank") <= k)
