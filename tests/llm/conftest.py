"""Small documents with every odd case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, TOKENS string, root long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, blanks, copies, near copies, shared passages, a very long text, ties."""
    rng = random.Random(3)
    passage, other = sentence(rng, 80), sentence(rng, 50)
    base = sentence(rng, 300)
    words = base.split(" ")
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "The two words."), (None, "a null id " + passage),
        (6, base), (7, base), (8, " ".join([*words[:150], "changed", *words[151:]])), (9, base.upper()),
        (10, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 10)), (11, passage), (12, sentence(rng, 5) + " " + other),
        (13, other + " " + passage), (14, "x y z " * 400), (15, "z x y " * 300), (16, sentence(rng, 60_000)),
        (17, "café été <|endoftext|> naïve 12 it's I'll!! ΣΑΣ İ é 日本語 a.b... x,, y."), (18, "same"), (18, "same"), (19, "same"),
        (20, "H\u0331ello T\u0308x W\u030a J\u030cabc, A\u0306B H\u0331. É Ę\u0301 don't STOP."),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as documents with extra columns whose names operators use themselves."""
    rows = [(d, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), 1.0, "x", 0) for k, (d, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    """An empty documents table."""
    return spark.createDataFrame([], SCHEMA)
