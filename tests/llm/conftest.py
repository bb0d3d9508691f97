import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, size string, n string, root string, gid string"


def rows(docs):
    """(doc_id, text, source) with columns whose names the operators use themselves."""
    return [(i, t, "en", s, len(t or ""), "x", "y", "z", "r", "g") for i, t, s in docs]


@pytest.fixture(scope="session")
def table(spark):
    return lambda docs: spark.createDataFrame(rows(docs), SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, very long, repeated and tied rows; null ids and sources."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 60) for _ in range(400))
    same = "The same line comes again and again in many documents.\nshort"
    copies = [(100 + k, same, "big") for k in range(30)]
    near = prose(rng, 120)
    nears = [(200 + k, near + f"\nlast word {k}", "big") for k in range(8)]
    return [
        (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, long, "b"), (5, "one two three", "b"),
        (6, "One  TWO three", "c"), (None, "no id here at all, is there", "c"), (None, None, "d"),
        (7, "repeated row with the same id", "a"), (7, "repeated row with the same id", "a"),
        (8, "Ünïcödé 日本語 🙂 text\r\nwith odd ends", "é"), *copies, *nears,
        (300, "one two three four five", "b"), (301, "one two three four five", "b"),
    ]
