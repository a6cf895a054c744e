"""Benchmark passages against brute force over all alignments."""

import itertools
import random
import re

from llm_data import docs_table, edge_rows, words

from wattloom.llm import decontamination as D


def folded(text):
    return re.findall(r"[0-9a-z]+", (text or "").lower())


def brute_force(docs, items, n=13, changed=2):
    found = set()
    for (d, a), (i, b) in itertools.product([(d, folded(t)) for d, t in docs], [(i, folded(t)) for i, t in items]):
        need = min(n, len(b))
        if not need:
            continue
        for x in range(len(a) - need + 1):
            for y in range(len(b) - need + 1):
                if sum(p == q for p, q in zip(a[x : x + need], b[y : y + need])) >= need - changed * need // n:
                    found.add((d, i))
    return found


def planted():
    rng = random.Random(11)
    items = [(k, " ".join(words(rng.randrange(15, 50), 500 + k))) for k in range(12)]
    docs = []
    for k in range(80):
        text = words(60, k)
        if k % 2:
            part = items[k % 12][1].split()
            start = rng.randrange(0, max(1, len(part) - 13))
            part = part[start : start + rng.choice([9, 13, 14, 20, 60])]
            for _ in range(k % 4):
                part[rng.randrange(len(part))] = "changed"
            text[30:30] = [w.upper() + "," if rng.random() < 0.3 else w for w in part]
        docs.append((k, " ".join(text)))
    return docs, items


def test_items_found_equal_brute_force(spark):
    docs, items = planted()
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (D.BLOCK_WORDS, 100):
        got = D.matches(docs_table(spark, docs), table, block_words=block_words).select("doc_id", "item_id").distinct()
        assert {tuple(r) for r in got.collect()} == brute_force(docs, items)


def test_masks_hold_in_any_thirteen_words_with_two_changes():
    for changes in itertools.combinations(range(13), 2):
        assert any(
            all(mask[j] == "0" or (s + j) not in changes for j in range(len(mask)))
            for mask in D.MASKS
            for s in range(13 - len(mask) + 1)
        )


def test_report_stretches_and_clean_documents(spark):
    item = " ".join(words(30, 1))
    docs = [(1, "before it " + item + " after"), (2, "nothing of it here"), (3, None), (1, "before it " + item + " after")]
    table = spark.createDataFrame([(5, item), (5, item), (6, None), (7, "")], "item_id long, text string")
    got = sorted(D.decontamination(docs_table(spark, docs), table).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.contaminated, r.item_ids) for r in got] == [(1, True, [5]), (1, True, [5]), (2, False, []), (3, False, [])]
    assert [tuple(s) for s in got[0].stretches] == [(5, 2, 32)]
    assert sorted(r.doc_id for r in D.clean(docs_table(spark, docs), table).collect()) == [2, 3]


def test_edge_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, " ".join(words(40, 5)))], "item_id long, text string")
    rows = edge_rows()
    got = D.decontamination(docs_table(spark, rows), items).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.contaminated} == {8}
    assert D.decontamination(docs_table(spark, []), items).count() == 0
    none = D.decontamination(docs_table(spark, rows), items.where("false")).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_rows_without_ids_and_short_items(spark):
    long, seven, three = (" ".join(words(n, 40 + n)) for n in (30, 7, 3))
    docs = [
        (None, "x " + long), (1, "clean text"), (1, "and " + long + " end"), (2, "a b " + seven + " c"), (3, "a b " + three + " c"), (4, three),
        (None, "nothing here"), (5, " ".join(seven.split()[:6] + ["other"])),
    ]
    table = spark.createDataFrame([(None, long), (8, seven), (9, three)], "item_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in D.clean(docs_table(spark, docs), table).collect()), key=repr)
    assert kept == sorted([(1, "clean text"), (3, "a b " + three + " c"), (None, "nothing here"), docs[-1]], key=repr)
    got = D.decontamination(docs_table(spark, docs), table).collect()
    found = sorted(((r.doc_id, r.item_ids, [tuple(s) for s in r.stretches]) for r in got if r.contaminated), key=repr)
    assert found == sorted([(None, [], [(None, 1, 31)]), (1, [], [(None, 1, 31)]), (2, [8], [(8, 2, 9)]), (4, [9], [(9, 0, 3)])], key=repr)


def test_a_prompt_that_all_items_share(spark, monkeypatch):
    monkeypatch.setattr(D, "_HITS", 50)
    prompt = " ".join(words(14, 77))
    items = [(k, prompt + " " + " ".join(words(20, 800 + k))) for k in range(30)]
    docs = [(1, prompt), (2, " ".join(words(40, 78))), (3, items[4][1])]
    got = D.matches(docs_table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in got.collect()} == brute_force(docs, items)
