"""Language ID, archives, search, mixing, packing and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import ann, hamming, langid, mixing, packing, warc


def test_language_id(spark, tiny, odd_docs, no_docs):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~out))
    told = langid.identify(docs.filter(out), model)
    assert told.filter("lang_pred = lang").count() >= 0.85 * told.count() and told.filter("score < 0 or score > 1").count() == 0
    hard = {(r.doc_id, r.text): r for r in langid.identify(odd_docs, model).collect()}
    for (_, text), r in hard.items():
        if not re.search(r"[^\W\d_]", text or ""):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
        else:
            assert r.lang_pred in model.languages
    assert langid.identify(no_docs, model).count() == 0 and {r.lang_pred for r in langid.identify(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
    a, b = np.frombuffer(b"abc " * 400_000, np.uint8), langid.counts(np.frombuffer(b"abc " * 400_000, np.uint8))
    old, langid._STEP = langid._STEP, 1 << 30
    assert (langid.counts(a) == b).all()
    langid._STEP = old


def test_archives(spark, tmp_path):
    long = "<p>é" + "x" * 5000
    rows = [(1, "http://a/ b\r\nc", long), (2, None, long), (3, "u", ""), (4, "u", None), (5, "u", "s"), (6, "u", "s"), (None, "u", long), (7, "u", long), (7, "u", long), (8, "u", "y" * 3000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    chunks = warc.archive_pages(pages, chunk_bytes=1000)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(chunks).collect())
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and h == long and i != 7
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 7 if again else None] += 1
    assert got == want and warc.records(chunks).filter("not digest_ok").count() == 0
    part = chunks.filter("record_type = 'response' and record_id = '<urn:page:8>'").orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in part] == [1000] * 3 and [r.payload_bytes for r in part] == [1000, 2000, 3000]
    assert part[0].digest == hashlib.sha1(b"y" * 1000).hexdigest() and part[-1].is_last
    assert warc.records(warc.archive_pages(pages.limit(0))).count() == 0


VECTORS = "vec_id long, embedding array<float>, ids string, q string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 16))
    rows = [(k, [float(v) for v in x], "i", "q") for k, x in enumerate(base)]
    rows += [(1000 + k, rows[0][1], "i", "q") for k in range(30)] + [(900, None, "i", "q"), (901, [0.0] * 16, "i", "q"), (902, [float("nan")] * 16, "i", "q"), (903, [1.0] * 3, "i", "q"), (904, [None] * 16, "i", "q"), (None, rows[1][1], "i", "q")]
    return spark.createDataFrame(rows, VECTORS).repartition(3), {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if r[0] is not None and r[0] not in range(900, 905)}


def test_nearest_neighbours(spark, vectors):
    df, x = vectors
    got = collections.defaultdict(list)
    for r in ann.search(df, lambda c: c % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = m @ m[list(ids).index(q)]
        want = [i for i in ids[np.lexsort((ids, -np.round(s, 12)))] if i != q][:5]
        assert len(got[q]) == 5 and all(abs(sc - s[list(ids).index(i)]) < 1e-12 for i, sc in got[q])
        hit += len(set(want) & {i for i, _ in got[q]})
    assert hit >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]
    few = ann.search(df.filter("vec_id in (0, 3, 7)"), lambda c: c == 0, k=5)
    assert [(r.rank, r.vec_id) for r in few.orderBy("rank").collect()][0][0] == 1 and few.count() == 2
    assert ann.search(df.limit(0), lambda c: c == 0).count() == 0


def test_exact_search(spark, vectors):
    df, _ = vectors
    codes, bits = hamming.sign_codes(df)
    got = collections.defaultdict(list)
    for r in hamming.search(codes, bits, lambda c: c % 20 == 0, k=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    all_codes = {r.id: r.code for r in codes.collect()}
    for q in [i for i in all_codes if i % 20 == 0]:
        want = sorted((bin((all_codes[q] ^ c) & (1 << 64) - 1).count("1"), i) for i, c in all_codes.items() if i != q)[:4]
        assert got[q] == want
    one, bits = hamming.sign_codes(df.filter("vec_id in (0, 3)"))
    assert hamming.search(one, bits, lambda c: c == 0, k=4).count() == 1
    none, bits = hamming.sign_codes(df.limit(0))
    assert hamming.search(none, bits, lambda c: c == 0).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 0, 1000], [5, 2, 1], 500) == pytest.approx([20, 0, 480])
    assert sorted(mixing.permute(np.arange(1000), 1000, 3).tolist()) == list(range(1000)) and mixing.permute(np.arange(1), 1, 3).tolist() == [0]
    total = [0, 0]
    for shard in range(7):
        counts, starts = mixing.draw_shard([40, 25], 10, shard, 1)
        assert starts == total and sum(counts) == (10 if shard < 6 else 5)
        total = [a + b for a, b in zip(total, counts, strict=True)]
    assert total == [40, 25]


def test_mixing(spark, tiny, odd_docs, no_docs):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    runs = [sorted(tuple(r) for r in mixing.taken(*mixing.mix_sources(d, block_tokens=16)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()) for d in (docs, docs.repartition(3))]
    assert runs[0] == runs[1]
    by = collections.defaultdict(lambda: [0, 0, 0, 0])
    for _, source, size, source_size, target, taken in runs[0]:
        assert taken <= 2 * size
        by[source][0] += size
        by[source][1] += taken
        by[source][2] = target
        by[source][3] = source_size
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([by[s][0] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(x[0] for x in by.values()))
    assert [by[s][2] for s in names] == pytest.approx(want) and all(x[0] == x[3] for x in by.values())
    assert all(abs(n - t) <= max(32, 0.02 * t) for _, n, t, _ in by.values())
    hard = mixing.taken(*mixing.mix_sources(odd_docs)).collect()
    assert len(hard) == odd_docs.count() and all(r.taken == 0 for r in hard if not r["size"])
    assert mixing.taken(*mixing.mix_sources(no_docs)).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    words = mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r.taken for r in hard)


def brute_fit(sizes, sources, clusters, capacity, most):
    bins, out = [], []
    for s, src, c in zip(sizes, sources, clusters, strict=True):
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= s and b["src"][src] < most and (c < 0 or c not in b["clu"])]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"room": capacity, "src": collections.Counter(), "clu": set()})
        bins[k]["room"] -= s
        bins[k]["src"][src] += 1
        bins[k]["clu"].add(c)
        out.append(k)
    return out


def test_packing(spark, odd_docs, no_docs):
    rng = random.Random(1)
    for _ in range(20):
        n = 150
        sizes = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True)
        src, clu = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)], [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
        assert packing.best_fit(sizes, src, clu, 64, 2) == brute_fit(sizes, src, clu, 64, 2)
    got = packing.pack_documents(odd_docs, capacity=100)
    text = {r.row_no: r for r in got.collect()}
    bins = collections.defaultdict(list)
    for r in got.collect():
        if r.bin_id is not None:
            bins[r.bin_id].append(r.n_tokens)
    assert max(map(sum, bins.values())) <= 100 and len(text) == odd_docs.count()
    whole = got.agg(F.sum("n_tokens")).first()[0]
    assert whole == packing.items(odd_docs).agg(F.sum("size")).first()[0] and packing.pack_documents(no_docs).count() == 0


def test_pipeline(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, tiny).persist()
        if name != "packing":
            assert kept.columns == docs.columns, name
        if name in ("language_id", "line_dedup", "near_duplicates"):
            assert 0 < kept.count() <= before.count()
    tokens = {r.doc_id for r in kept.collect()}
    assert tokens and tokens <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, tiny).count() == kept.count()
