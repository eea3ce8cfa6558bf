"""Rows that every operator has to bear: nulls, empty and long texts, equal rows, columns of clashing names."""

import random

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards boil green tea near old stone walls and quiet rivers".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = "x" * 5000 + " " + prose(99, 30_000)
SHARED = prose(7, 60)
DOCS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),  # equal to 1
    (3, prose(1, 119) + " changed"),  # near 1
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, "One"),
    (8, LONG),
    (9, prose(3, 200) + " " + SHARED + " " + prose(4, 50)),
    (10, SHARED + " " + prose(5, 90)),
    (10, SHARED + " " + prose(5, 90)),  # an id twice
    (None, prose(6, 40)),
    (11, "Ünïcödé ’ ß 日本語 <|endoftext|> it's 2024!! " * 5),
    (12, "ha " * 400),
    (13, "ha " * 400),
]


def documents(spark, rows=None):
    """With columns whose names the operators use inside."""
    rows = DOCS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5, "k", 7, "c", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, key string, id int, component string, rank int")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: tuple((v is None, str(v)) for v in x))
