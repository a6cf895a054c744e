"""Window removal against brute force, with small and overfull sketches."""

import hashlib
import re

import pytest
from llm_data import docs_table, edge_rows, words

from wattloom.llm import substrings


def brute_force(rows, n=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < d:
                    gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_with_passages():
    passage, other = words(60, 900), words(13, 901)
    rows = []
    for k in range(120):
        text = words(40 + k, k)
        if k % 3 == 0:
            text[10:10] = passage
        if k % 5 == 0:
            text += other
        if k % 7 == 0:
            text = text[:30] * 3
        rows.append((k * 37 % 1000, "  ".join(text) if k % 2 else "\n".join(text)))
    return rows + [(2000 + k, rows[k][1]) for k in range(20)]


@pytest.mark.parametrize("bits", [None, 5])
def test_equal_to_brute_force(spark, bits):
    rows = rows_with_passages() + edge_rows()
    got = substrings.digests(docs_table(spark, rows).repartition(5), bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_empty_table(spark):
    assert substrings.digests(docs_table(spark, [])).count() == 0


def test_words_that_collide_in_a_polynomial(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(["w"] * 12 + [word])), (2, " ".join(["w"] * 12 + [other])), (3, " ".join(["w"] * 12 + [other]))]
    got = {r.doc_id: r.n_removed for r in substrings.digests(docs_table(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
