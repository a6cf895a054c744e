"""Small tables for the tests of the text operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_table(spark, rows, **extra):
    """documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash with internal ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 0, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA + ", size int, words string")


def words(n, seed, vocabulary=4000):
    pick = random.Random(seed)
    return [f"w{pick.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    long = " ".join(words(30_000, 5))
    same = "the same words stand here in this row and the next one as well for all to see"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b"), (6, same), (7, same), (6, same), (8, long),
        (None, same), (None, None), (9, "ñ é 漢字   x y"), (10, "\x00 null byte"), (11, "x" * 100_000),
    ]
