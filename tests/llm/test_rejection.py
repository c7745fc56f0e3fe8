"""Rejection of lettered junk of lengths that few training rows or none show."""

import random

import pytest

from wayfold.llm import langid

SYMBOLS = "#$%^&*()_+-=[]{};:<>/?|~0123456789"


def junk(n, seed):
    rng = random.Random(seed)
    return "a" + "".join(rng.choice(SYMBOLS) for _ in range(n))


def rejected(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.rejected for r in langid.identify(docs, model).orderBy("doc_id").collect()]


def prose(n, seed):
    """``n`` characters of words, frequent ones short; each seed has a choice of words of its own."""
    words = random.Random(0)
    words = ["".join(words.choice("etaoinshrdlu") for _ in range(2 + k // 60)) for k in range(400)]
    rng = random.Random(seed)
    words = [w for w in words if rng.random() < 0.7]
    return " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(n // 2))[:n]


def fitted(spark, texts):
    return langid.fit(spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string"))


def test_very_long_texts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = langid.fit(docs)
    rows = docs.filter("lang = 'en' and length(text) between 400 and 3000").orderBy("doc_id").select("text").collect()
    known = [r.text for r in rows if sum(c.isalpha() or c == " " for c in r.text) > 0.9 * len(r.text)]
    for size in (300_000, 1_500_000):
        good = " ".join(known * (size // sum(map(len, known)) + 1))[:size]
        assert rejected(spark, model, [junk(size, 1), "a" + "# " * (size // 2), good]) == [True, True, False]


@pytest.mark.parametrize("n", [1, 2, 12])
def test_small_training_table(spark, n):
    model = fitted(spark, [prose(800 + 50 * k, k) for k in range(n)])
    bad, good = [junk(k, k) for k in (900, 3000, 200_000)], [prose(k, 100 + k) for k in (200, 900, 3000, 200_000)]
    assert rejected(spark, model, [*bad, *good]) == [True] * 3 + [False] * 4


def test_lengths_that_training_lacks(spark):
    model = fitted(spark, [prose(5000 + 10 * k, k) for k in range(40)] + [prose(400_000 + k, k) for k in range(40)])
    bad, good = [junk(k, k) for k in (900, 50_000, 3_000_000)], [prose(k, 100 + k) for k in (900, 50_000, 3_000_000)]
    assert rejected(spark, model, [*bad, *good]) == [True] * 3 + [False] * 3


def test_driver_learns_nothing(spark, monkeypatch):
    monkeypatch.setattr(langid, "_kmeans", None)  # in the driver's process
    assert fitted(spark, [prose(800, k) for k in range(40)]).languages == ["en"]
