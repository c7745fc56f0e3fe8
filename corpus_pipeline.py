"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

language ID: rows whose text is rejected (null, without a letter, or far from every language's centroids) go.
line dedup: later copies of runs of three lines or more go; a document of which no line is left goes.
near duplicates: word 5-grams, Jaccard 0.8 or more; of each group of linked documents that of the least doc_id stays.
mixing: sources by weight, block by block; a document appears once for each time it is taken.
packing: pieces of documents in bins of 2048 words, none with two rests of a document (however the mix cut its repeats; rows
without a doc_id count as one document here) or of equal texts.

Hard rows: a null or empty text is rejected by the first stage, which lets no such row on; the others keep what they get (a
null text has no lines and no shingles, is never taken by the mix and gets no bin). A null doc_id comes last where the least
stays; among equal ids the first row as read. Repeated rows are near copies of each other, so one stays. Null sources are a
source, the last. Columns besides doc_id, text, lang, source and n_chars are passed on; names that begin with _wf_ are taken.
An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import jaccard, langid, lines, mixing, packing
from wayfold.llm.common import read_table, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    told = langid.identify(docs, langid.fit(docs.select("doc_id", "text", "lang")))
    return told.filter(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs).filter("n_lines = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    owner = "pipeline-3"
    base = table(docs.withColumn("_wf_row", F.monotonically_increasing_id()), "pipeline-rows", owner)
    group = jaccard.near_duplicates(base.select(F.col("_wf_row").alias("doc_id"), "text"), ngram=5, percent=80, owner=owner, every=False)
    named = group.select(F.col("doc_id").alias("_wf_row"), F.col("component_id").alias("component")).join(base.select("_wf_row", "doc_id"), "_wf_row")
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_wf_row")).alias("first")).select("first._wf_row")
    return base.join(kept, "_wf_row", "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, owner="pipeline-4")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, owner="pipeline-5", cluster="doc_id").drop("row_no")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: No SQL states nearest-centroid training, the draws of the mix, or best-fit packing; tests/llm/test_stages.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = table(docs, f"pipeline-{name}", f"pipeline-out{k}")
    return docs
