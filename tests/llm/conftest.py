import random

import pytest

# Extra columns whose names the operators use inside.
CLASHING = "sha string, key string, n long, kept boolean, uid long, doc_id_ string, bits binary, lost_id long, own int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def words(seed, number):
    draw = random.Random(seed)
    return [draw.choice("abcdefgh") + str(draw.randrange(10_000)) for _ in range(number)]


def odd_texts():
    """Ids and texts: nulls, empty, very long, ties, repeated rows, all kinds of space."""
    base, long = words(1, 60), words(2, 30_000)
    edited = [*base[:-1], "other"]
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (4, "one"),
        (5, "one two three four"),
        (6, "One TWO three four"),
        (7, " ".join(base)),
        (8, " ".join(edited)),
        (9, "  ".join(base).upper()),
        (10, " ".join(long)),
        (11, " ".join([*long[1:], "x"])),
        (12, "É é  ſ  İ token = abcdef0123456789abcdef0123456789 x"),
        (13, "x" * 5000),
        (None, "no id here at all"),
        (None, "no id here at all"),
        (None, " ".join(base)),
        (14, "a b c\x1cd e\nf  g \n h"),
    ]


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "src0", None if t is None else len(t), *[None] * 9) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_texts())


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [], 1)
