"""Hard inputs: very long and periodic texts, words that polynomials confuse, rows without ids, tiny sources, wide codes."""

import collections
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import ann, hamming, langid, lines, mixing, prefixfree, substrings, warc

DOCS = "doc_id long, text string"


def thue_morse(length):
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def brute_bytes(rows, size):
    seen = collections.Counter(b[k : k + size] for _, t in rows for b in [t.encode()] for k in range(len(b) - size + 1))
    out = {}
    for i, t in rows:
        b = t.encode()
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                edge[k] += 1
                edge[k + size] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        out[i] = len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def found_bytes(spark, rows, size):
    got = prefixfree.dedup_bytes(spark.createDataFrame(rows, DOCS).repartition(2), size).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}


def test_bytes_of_hard_texts(spark, monkeypatch):
    monkeypatch.setattr(prefixfree, "PART_BYTES", 3000)
    monkeypatch.setattr(prefixfree, "HELD_ROWS", 2000)
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    word, other = thue_morse(4096)
    shared = prose(700)
    rows = [(1, "z" * 20_000), (2, "xyz" * 5000 + "q"), (3, word), (4, other), (5, prose(9000) + shared + prose(8000)), (6, shared[:450] + prose(40)), (7, "y" * 150), (8, prose(100) + "y" * 150), (9, thue_morse(128)[0] * 2), (10, thue_morse(128)[1] * 2)]
    assert found_bytes(spark, rows, 200) == brute_bytes(rows, 200)


def test_bytes_of_very_long_texts(spark):
    rng = random.Random(4)
    rows = [(1, "z" * 16_000_000), (2, "xyz" * 2_000_000), (3, "".join(rng.choice("abcdef ") for _ in range(3000)))]
    got = found_bytes(spark, rows, 200)
    assert got == {1: (16_000_000, 16_000_000, 1, hashlib.sha256(b"").hexdigest()), 2: (6_000_000, 6_000_000, 1, hashlib.sha256(b"").hexdigest()), 3: (3000, 0, 0, hashlib.sha256(rows[2][1].encode()).hexdigest())}


def test_words_that_polynomials_confuse(spark):
    for size in (1024, 4096):
        word, other = thue_morse(size)
        rest = [f"w{k}" for k in range(49)]
        rows = [(1, " ".join([*rest, word])), (2, " ".join([*rest, other])), (3, " ".join(word)), (4, " ".join("c" + x for x in other))]
        got = {r.doc_id: r.n_removed for r in substrings.dedup_words(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == {1: 0, 2: 0, 3: 0, 4: 0}


def test_words_of_rows_without_id(spark):
    rng = random.Random(6)
    prose = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = prose(60)
    rows = [(None, " ".join([*prose(20), *passage, *prose(k % 7)])) for k in range(300)] + [(5, " ".join(passage)), (9, " ".join([*passage, "x"]))]
    got = substrings.dedup_words(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert collections.Counter((r.doc_id, r.n_removed) for r in got) == {(None, 60): 300, (5, 0): 1, (9, 60): 1}


def test_lines_of_long_documents(spark):
    rng = random.Random(7)
    text = "\n".join(f"line {rng.random()}" for _ in range(20_000))
    own = "\n".join(f"own {k}" for k in range(20_000))
    rows = [(1, text), (2, text), (3, own + "\n" + text + "\n\nend")]
    start = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (20_000, 0, text), 2: (20_000, 20_000, ""), 3: (40_001, 20_000, own + "\n\nend")}
    assert time.time() - start < 60


def test_language_sample_without_ids(spark):
    rows = [(None, f"the {k} cat sat on the mat and the dog {k} lay down", "en") for k in range(3000)] + [(None, f"le chat {k} dort sur la table et le chien {k} mange", "fr") for k in range(3000)] + [(None, "sempre uguale il testo di questa lingua", "it")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, sample_rows=600)
    assert model.languages == ["en", "fr", "it"]
    told = langid.identify(docs, model)
    assert told.filter("lang_pred = lang").count() >= 0.99 * len(rows)


def test_mix_of_tiny_sources(spark):
    rows = [(k, " ".join(["w"] * 13), "abc"[k % 3]) for k in range(15)] + [(100, "one", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.taken(*mixing.mix_sources(docs)).collect()
    took, target = collections.Counter(), {}
    for r in got:
        took[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert target == dict(zip("abcd", mixing.targets([65, 65, 65, 1], [5, 2, 1, 5], 294), strict=True))
    assert all(abs(took[s] - t) <= 1 for s, t in target.items())


@pytest.mark.parametrize("bits", [100, 128, 130])
def test_wide_codes(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.normal(size=(20, bits))
    x = np.concatenate([b + 0.4 * rng.normal(size=(12, bits)) for b in base])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    codes, n = hamming.sign_codes(df)
    got = collections.defaultdict(list)
    for r in hamming.search(codes, n, lambda c: c % 40 == 0, k=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    on = x > 0
    assert n == bits and got == {q: sorted((int((on[q] != on[i]).sum()), i) for i in range(len(x)) if i != q)[:4] for q in range(0, len(x), 40)}


def test_recall_of_the_query(spark, tiny):
    from wayfold.llm.queries import QUERIES

    got = collections.defaultdict(set)
    for r in QUERIES["op8_ann"](spark, tiny).collect():
        got[r.query_id].add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").filter("vec_id is not null and embedding is not null").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ids, x = ids[ok], x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True)
    want = {q: {int(i) for i in ids[np.lexsort((ids, -(x @ x[ids == q][0])))] if i != q} for q in ids[ids % 50 == 0].tolist()}
    hits = near = 0
    for q in want:
        s = x @ x[ids == q][0]
        best = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        hits, near = hits + len(got[q] & set(best)), near + len(best)
    assert hits >= 0.9 * near


def test_probes_come_in_order():
    """Against all buckets, sorted: the same likelihoods in the same order."""
    family = ann.Family(8, 1, 5, 1.5, 1)
    for seed in range(5):
        spot = np.random.default_rng(seed).normal(size=5) * 2
        got = family.probes(spot, 0.8, 0.7)
        grid = np.stack(np.meshgrid(*[np.arange(int(np.floor(x / 1.5)) - 4, int(np.floor(x / 1.5)) + 5) for x in spot], indexing="ij"), axis=-1).reshape(-1, 5)

        def likely(cells, spot=spot):
            return np.prod(ann._normal_cdf(((cells + 1) * 1.5 - spot) / 0.8) - ann._normal_cdf((cells * 1.5 - spot) / 0.8), axis=1)

        want = np.sort(likely(grid))[::-1][: len(got)]
        assert np.allclose(likely(got), want, atol=1e-6) and likely(got).sum() >= 0.7 - 1e-3 and len(np.unique(got, axis=0)) == len(got)


def test_archive_chunks_are_written_apart(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 10_000), (2, "u", None), (3, "u", "x" * 10_000)], "page_id long, url string, html string")
    rows = warc.chunked(warc.plan_records(pages), 1000).collect()
    assert sorted((r.page_id, r.chunk_no, len(r.chunk)) for r in rows) == [(1, 0, 0), (2, 0, 0), *[(3, k, 1000) for k in range(10)]]
    got = warc.records(warc.archive_pages(pages, chunk_bytes=777))
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.digest_ok) for r in got.collect()) == [(1, 10_000, "revisit", 3, True), (2, 0, "response", None, True), (3, 10_000, "response", None, True)]
