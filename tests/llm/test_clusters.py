"""Packing never puts two near copies, or two repeats of a document, into one bin."""

import collections
import random

from wayfold.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def bins(packed):
    out = collections.defaultdict(list)
    for r in packed.collect():
        if r.bin_id is not None:
            out[r.bin_id].append(r)
    return out


def test_repeats_of_a_document(spark):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(130, 400))) for _ in range(60)]
    docs = spark.createDataFrame([(None if k < 2 else k, t, "en", rng.choice("abc"), len(t)) for k, t in enumerate(texts)], SCHEMA)
    mixed = mixing.mixed_documents(docs).persist()
    by = collections.defaultdict(set)
    for r in mixed.collect():
        by[r.doc_id].add(r.text)
    assert sum(len(v) > 1 for v in by.values()) > 10  # repeats with texts of their own
    got = bins(corpus_pipeline.pack(spark, mixed, ""))
    assert all(len({r.doc_id for r in b}) == len(b) for b in got.values())
    assert sum(r.n_tokens for b in got.values() for r in b) == packing.items(mixed).agg({"size": "sum"}).first()[0]


def test_equal_texts_of_other_ids(spark):
    docs = spark.createDataFrame([(k, "same words here", "en", str(k), 15) for k in range(5)], SCHEMA)
    assert len(bins(packing.pack_documents(docs, cluster="doc_id"))) == 5


def test_near_copies(spark):
    base = [f"t{k}" for k in range(120)]
    rows = [(k % 20, " ".join(w if j != 3 * k else "own" for j, w in enumerate(base)), "en", str(k), 0) for k in range(30)]  # ids repeat
    rows += [(None, " ".join(base), "en", "x", 0), (None, " ".join(base), "en", "y", 0), (90, "other words", "en", "z", 0), (91, "", "en", "z", 0)]
    got = bins(packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert all(sum(r.n_tokens == 120 for r in b) == 1 for b in got.values()) and len(got) == 32


def test_keys_meet_in_buckets():
    """Keys that travel as arrays: pairs of small groups, members of large ones, also of keys that stand out in one batch only."""
    import numpy as np
    import pyarrow as pa

    from wayfold.llm import jaccard

    rng, rows = np.random.default_rng(4), []
    for c in range(1, 61):
        keys = {int(k) for k in rng.integers(100, 160, 3)} | ({7} if c <= 20 or c == 50 else set()) | ({8} if c % 10 == 0 else set())
        rows.append((c, 200 + c % 3, len(keys), np.array(sorted(keys), np.uint64).tobytes()))
    dealt = []
    for part in (rows[:30], rows[30:45], rows[45:]):
        made = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], names=["c", "n", "rare", "prefix"])
        dealt += [r for b in jaccard._keys(iter([made]), 80, 5) for r in b.to_pylist()]
    dealt.sort(key=lambda r: r["bucket"])
    got = [r for i in (dealt[:9], dealt[9:]) if i for r in i]
    out = [r for b in jaccard._pairs(iter([pa.RecordBatch.from_pylist(got[:9]), pa.RecordBatch.from_pylist(got[9:])]), 80) for r in b.to_pylist()]
    groups = {}
    for c, _, _, raw in rows:
        for k in np.frombuffer(raw, np.uint64).tolist():
            groups.setdefault(k, []).append(c)
    small = {(a, b) for g in groups.values() if len(g) <= jaccard.SMALL for a in g for b in g if a < b}
    assert {(r["a"], r["b"]) for r in out if not r["large"]} == small
    assert sorted((r["key"], r["a"]) for r in out if r["large"]) == sorted((k, c) for k, g in groups.items() if len(g) > jaccard.SMALL for c in g)


def test_items_come_from_the_join(spark):
    """Sizes and sources come along with the join; texts are not read again to count them."""
    rows = [(1, "s", "a b c\td  e"), (2, None, ""), (None, "t", None), (3, "t", "a b c\td  e")]
    got = packing.near_items(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted((r.doc_id or 0, r.source, r["size"], r.cluster is None, r.copy is None) for r in got.collect()) == [(0, "t", 0, True, True), (1, "s", 4, False, False), (2, None, 0, True, True), (3, "t", 4, False, False)]
    assert "regexp_count" not in got._jdf.queryExecution().toString()
