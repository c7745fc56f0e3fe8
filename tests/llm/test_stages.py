"""The rows of each pipeline stage against brute force."""

import collections

import numpy as np
from test_dedup import WORD, brute_components, brute_lines

import corpus_pipeline
from wayfold.llm import langid, mixing


def test_rows_of_each_stage(spark, tiny):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").persist()
    pairs = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())

    model = langid.fit(docs.select("doc_id", "text", "lang"))
    lettered = lambda t: any(ch.isalpha() for ch in t or "")
    want = collections.Counter((r.doc_id, r.text) for r in docs.collect() if lettered(r.text) and not model.predict(np.frombuffer(r.text.encode(), np.uint8))[2])
    told = stages["language_id"](spark, docs, tiny).persist()
    assert pairs(told) == want and len(want) > 0.5 * docs.count()

    lines = stages["line_dedup"](spark, told, tiny).persist()
    brute = brute_lines([(r.doc_id, r.text) for r in told.collect()])
    assert pairs(lines) == collections.Counter((i, t) for i, (n, gone, t) in brute.items() if n == 0 or gone < n)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages["near_duplicates"](spark, lines, tiny).persist()
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    component = {i: c for i, _, c in brute_components(rows, 5, 80)}
    assert pairs(near) == collections.Counter((i, t) for i, t in rows if component[i] == i)

    mixed = stages["mixing"](spark, near, tiny).persist()
    size = {r.doc_id: len(WORD.findall(r.text)) for r in near.collect()}
    source = {r.doc_id: r.source for r in near.collect()}
    whole, took, by_doc = collections.Counter(), collections.Counter(), collections.Counter()
    for i, n in size.items():
        whole[source[i]] += n
    for r in mixed.collect():
        took[r.source] += len(WORD.findall(r.text))
        by_doc[r.doc_id] += len(WORD.findall(r.text))
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([whole[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(whole.values()))
    assert all(abs(took[s] - t) <= max(64, 0.02 * t) for s, t in zip(names, goal, strict=True))
    assert all(n <= 2 * size[i] for i, n in by_doc.items()) and mixed.columns == docs.columns

    bins = collections.defaultdict(list)
    packed = stages["packing"](spark, mixed, tiny).collect()
    assert sum(r.n_tokens for r in packed) == sum(took.values())
    for r in packed:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= 2048
        if len(held) > 1:  # rests: no two of one document, no more than two of a source
            assert len({r.doc_id for r in held}) == len(held) and max(collections.Counter(source[r.doc_id] for r in held).values()) <= 2


def test_hard_rows_and_no_rows(spark, tiny, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept, stage(spark, kept, tiny).persist()
            if name in ("language_id", "line_dedup", "near_duplicates"):
                assert kept.columns == docs.columns and kept.count() <= before.count()
                assert not kept.filter("text is null or trim(text) = ''").count()
        assert (kept.count() > 0) == (docs is odd_docs)
