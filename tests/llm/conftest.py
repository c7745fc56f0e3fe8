import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def odd(spark):
    """A small table of hard cases: nulls in any column, empty and blank texts, ties, repeated rows, copies, long texts."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(80), prose(200)
    near = base.split()
    near[50] = "changed"
    rows = [(1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (None, prose(60)), (None, base), (7, "a"), (8, "Été à"), (9, "12 34"), (10, "x " * 400)]
    rows += [(20 + k, f"{prose(40)} {passage} {prose(rng.randint(0, 40))}") for k in range(12)]
    rows += [(40, prose(9000)), (41, "z" * 5000), (42, "line one here\nline two here\nline three here\nown " + prose(5)), (43, "other\nline one here\nline two here\nline three here")]
    rows += [(60 + k, prose(rng.randint(1, 30))) for k in range(20)]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
