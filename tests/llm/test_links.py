"""All links of the similarity join against brute force."""

import re

import numpy as np
import pytest

from wayfold.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_links(rows, ngram, percent):
    """Linked pairs of different sets (as pairs of their least ids), and each row's number of linked rows."""
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append(frozenset({tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)} if len(w) >= ngram else ({tuple(w)} if w else ())))
    least, counts, pairs = {}, [0] * len(rows), set()
    for (i, _), s in zip(rows, sets, strict=True):
        least[s] = min(least.get(s, i), i)
    for x in range(len(rows)):
        for y in range(x):
            k = len(sets[x] & sets[y])
            if k and 100 * k >= percent * len(sets[x] | sets[y]):
                counts[x] += 1
                counts[y] += 1
                if sets[x] != sets[y]:
                    pairs.add((*sorted((least[sets[x]], least[sets[y]])), k))
    return pairs, {i: n for (i, _), n in zip(rows, counts, strict=True)}


def found(spark, rows, ngram, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, classes, links = jaccard.join(docs, ngram, percent)
    least = {r.c: r.least for r in classes.collect()}
    pairs = [(*sorted((least[r.a], least[r.b])), r.shared) for r in links.collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs), {r.doc_id: r.n_links for r in jaccard.near_duplicates(docs, ngram, percent).collect()}


@pytest.mark.parametrize("rows_a_block", [1024, 9])
def test_all_links_of_large_groups(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(jaccard, "LINK_ROWS", rows_a_block)
    rows = [(k, " ".join(f"t{j}" if j != k else "own" for j in range(60))) for k in range(60)]
    got, want = found(spark, rows, 1, 90), brute_links(rows, 1, 90)
    assert got == want and len(want[0]) == 60 * 59 // 2


def test_all_links_of_chains(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LINK_TOKENS", 1500)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    base = list(rng.choice(words, 120))
    rows = [(1, "a b"), (2, "a b"), (3, ""), (4, None), (5, "solo")]
    for k in range(60):  # far ends of the class don't link; lengths differ; some rows are equal
        copy = list(base[: int(rng.integers(100, 121))])
        for _ in range(int(rng.integers(0, 4))):
            copy[int(rng.integers(0, len(copy)))] = str(rng.choice(words))
        rows.append((100 + k, " ".join(copy)))
    rows += [(300, rows[-1][1]), (301, rows[-2][1]), (400, " ".join(words[:100])), (401, " ".join([*words[:99], "end"]))]
    assert found(spark, rows, 3, 80) == brute_links(rows, 3, 80)


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements differ, however long: no links, alone or among other words."""
    word, rows = "a", []
    for k in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) in (1024, 4096):
            other = word.translate(str.maketrans("ab", "ba"))
            rest = [f"w{k}of{j}" for j in range(30)]
            rows += [(9 * k + 1, word), (9 * k + 2, other), (9 * k + 3, " ".join([*rest, word])), (9 * k + 4, " ".join([*rest[:15], other, *rest[15:]])), (9 * k + 5, " ".join([*rest, other]))]
    assert found(spark, rows, 3, 99) == brute_links(rows, 3, 99) == (set(), {i: 0 for i, _ in rows})


def test_components_of_many_near_copies(spark, monkeypatch):
    """3000 copies in 300 components that share their keys, in blocks: components as by brute force, few candidates."""
    monkeypatch.setattr(jaccard, "GROUP", 700)
    rng = np.random.default_rng(8)
    sets = np.tile(np.arange(80), (3000, 1))
    for k in range(300):
        own = rng.choice(np.arange(10, 80), 9, replace=False)  # any two components differ in more than links allow
        sets[k::300, own] = 1000 + 100 * k + np.arange(9)
    for r in range(300, 3000):
        at = rng.choice(np.arange(10, 80), int(rng.integers(1, 4)), replace=False)
        sets[r, at] = 100_000 + 10 * r + np.arange(len(at))
    bits = np.zeros((3000, 130_010), np.float32)
    bits[np.arange(3000)[:, None], sets] = 1
    shared = bits @ bits.T
    linked, want = 100 * shared >= 90 * (160 - shared), np.full(3000, -1)
    for r in range(3000):
        todo = [r] if want[r] < 0 else []
        while todo:
            x = todo.pop()
            if want[x] < 0:
                want[x] = r
                todo += np.flatnonzero(linked[x] & (want < 0)).tolist()
    docs = spark.createDataFrame([(r, " ".join(f"t{x}" for x in row)) for r, row in enumerate(sets.tolist())], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, 1, 90, every=False).collect()}
    assert got == dict(enumerate(want.tolist())) and len(set(want.tolist())) > 200


def test_many_rows_without_id(spark):
    """Rows that share the missing id are told apart by their texts."""
    rows = [(None, " ".join(f"t{j}" if j != k % 40 else f"own{k % 40}" for j in range(60))) for k in range(400)] + [(7, " ".join(f"t{j}" for j in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(docs, 1, 90).collect()
    assert {r.component_id for r in got} == {7} and sorted(r.n_links for r in got) == [400] * 401


def test_groups_that_are_done_stay_out(spark, monkeypatch):
    """20 texts that nearly link ask for more partners; 12 that share half their words are done after their first round."""
    rows = [(k, " ".join(f"n{k}x{j}" if j // 5 == k else f"t{j}" for j in range(360))) for k in range(20)]
    rows += [(100 + k, " ".join([*(f"s{j}" for j in range(200)), *(f"u{k}x{j}" for j in range(200))])) for k in range(12)]
    seen, cross = [], jaccard._cross

    def watched(groups, *rest):
        seen.append({r.key for r in groups.select("key").distinct().collect()})
        return cross(groups, *rest)

    monkeypatch.setattr(jaccard, "_cross", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, 1, 95, every=False).collect()}
    assert got == {i: i for i, _ in rows}
    assert len(seen) == 3 and seen[2] < seen[1]


def test_groups_of_equal_members_are_one(spark):
    rows = [(key, c) for key in (5, 2, 9) for c in (10, 11, 12)] + [(1, 10), (1, 11), (3, 10), (3, 11), (3, 13)]
    large, blocks = jaccard._large(spark.createDataFrame(rows, "key long, c long").repartition(3), "test-large")
    assert sorted(r.key for r in blocks.collect()) == [1, 2, 3]
    assert sorted((r.key, r.c) for r in large.collect()) == sorted(r for r in rows if r[0] in (1, 2, 3))
