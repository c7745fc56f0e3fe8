"""Deduplication operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import fmindex, jaccard, lines, prefixfree, substrings
from wayfold.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def multiset(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_bytes(odd, odd_docs, no_docs):
    size = 60
    texts = [(i, (t or "").encode()) for i, t, *_ in odd]
    seen = collections.Counter(b[k : k + size] for _, b in texts for k in range(len(b) - size + 1))
    want = collections.Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want[i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    got = multiset(prefixfree.dedup_bytes(odd_docs, size), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want and prefixfree.dedup_bytes(no_docs, size).count() == 0


def test_rows_that_occur_again():
    """Sorted rows in batches of any cut, against counts."""
    rng = random.Random(1)
    for _ in range(200):
        rows = sorted((rng.randint(0, 12), rng.randint(0, 1), i, rng.choice([0, 0, 0, 1])) for i in range(rng.randint(0, 60))) + [(100 + i, 5, i + 900, 2) for i in range(rng.randint(0, 3))]
        h, h2, row, mark = ([r[k] for r in rows] for k in range(4))
        whole = pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "h2": pa.array(h2, pa.int64()), "row": pa.array(row, pa.int64()), "k": pa.array(row, pa.int64()), "m": pa.array(row, pa.int64()), "mark": pa.array(mark, pa.int32())})
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(0, 9)
            batches.append(whole.slice(at, n))
            at += n
        many = collections.Counter()
        for a, b, _, m in rows:
            many[a, b] += 1 + m if m < 2 else 0
        got = sorted(x for b in prefixfree._again(iter(batches)) for x in b.column("row").to_pylist())
        assert got == sorted(r for a, b, r, m in rows if m == 2 or many[a, b] > 1)


def test_bytes_crowd(odd_docs, monkeypatch):
    want = multiset(prefixfree.dedup_bytes(odd_docs, 60), "doc_id", "kept_sha256")
    monkeypatch.setattr(prefixfree, "CROWD", 1)
    assert multiset(prefixfree.dedup_bytes(odd_docs, 60), "doc_id", "kept_sha256") == want


def brute_words(odd, window):
    first, want = {}, collections.Counter()
    key = lambda i: float("inf") if i is None else i
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in odd]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, float("inf")), key(i))
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("crowd", [4000, 1])
def test_words(odd, odd_docs, no_docs, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    got = multiset(substrings.dedup_words(odd_docs, 20, 6), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_words(odd, 20)
    if crowd > 1:
        assert substrings.dedup_words(no_docs).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(40):
        least = int(rng.integers(2, 7))
        texts = [rng.integers(1, 4, int(rng.integers(1, 30))) for _ in range(6)]
        texts += [np.r_[texts[0], texts[1][:7]], texts[2][1:]]
        seq, size = np.concatenate([np.r_[x, 0] for x in texts]), np.array([len(x) for x in texts])
        starts = np.cumsum(np.r_[0, size[:-1] + 1])
        lane, lo, hi = fmindex.earlier_matches(seq, starts, size, starts, least)
        for t, x in enumerate(texts):
            before = {tuple(y[k : k + least]) for y in texts[:t] for k in range(len(y) - least + 1)}
            found = {k for a, i, j in zip(lane, lo, hi, strict=True) if a == t for k in range(i, j - least + 1)}
            assert found == {k for k in range(len(x) - least + 1) if tuple(x[k : k + least]) in before}


def brute_lines(rows, run=3):
    first, solid = {}, []
    for d, t in rows:
        own = [(n, x.strip(" ")) for n, x in enumerate((t or "").split("\n")) if x.strip(" ")] if t is not None else []
        solid.append(own)
        for k in range(len(own) - run + 1):
            s = tuple(x for _, x in own[k : k + run])
            first[s] = min(first.get(s, (d, k)), (d, k))
    out = {}
    for (d, t), own in zip(rows, solid, strict=True):
        dead = {n for k in range(len(own) - run + 1) if first[tuple(x for _, x in own[k : k + run])] < (d, k) for n, _ in own[k : k + run]}
        out[d] = (len(own), len(dead), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dead))
    return out


def test_lines(spark, odd_docs, no_docs):
    a = ["p", "q", "r", "s", "t"]
    rows = [(1, "\n".join(a)), (2, "x\n" + "\n".join(a[1:]) + "\ny"), (3, "p\n\n q \nr"), (4, None), (5, ""), (6, "\n\n"), (7, "k\nk\nk\nk\nk"), (8, "r\ns\nt\nu"), (9, "q\nr")]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, runs string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)
    assert lines.dedup_lines(odd_docs).count() == odd_docs.count() and lines.dedup_lines(no_docs).count() == 0
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_components(rows, ngram, percent):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)} if len(w) >= ngram else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("ngram", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, odd, no_docs, ngram, percent):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(500)]
    base = list(rng.choice(words, 150))
    rows = [(i, t) for i, t, *_ in odd]
    for k in range(40):  # near copies: small and large distances, so that classes chain
        copy = list(base)
        for _ in range(int(rng.integers(0, 6))):
            copy[int(rng.integers(0, len(copy)))] = str(rng.choice(words))
        rows.append((100 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = multiset(jaccard.near_duplicates(docs, ngram, percent), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, ngram, percent)
    if ngram == 3:
        assert jaccard.near_duplicates(no_docs).count() == 0


def test_jaccard_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 50)
    rows = [(k, " ".join(f"t{j}" if j != k else "own" for j in range(60))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(jaccard.near_duplicates(docs, 1, 90), "doc_id", "n_shingles", "component_id") == brute_components(rows, 1, 90)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(50, 51), (52, 51)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 31)} == {1} and got[52] == 50
