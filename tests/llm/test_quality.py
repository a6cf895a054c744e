"""Counts against a plain computation."""

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st
from llm_data import docs_table, edge_rows, words

from wattloom.llm import quality

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute_force(doc_id, text):
    text = text or ""
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(parts[i : i + 3]) for i in range(len(parts) - 2))
    repeated = {i + k for i in range(len(parts) - 2) if windows[tuple(parts[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(parts) < 50 or 100 * len(repeated) > 50 * len(parts)
    return doc_id, len(parts), sum(map(len, parts)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def check(spark, rows):
    got = quality.quality(docs_table(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_force(*r) for r in rows), key=repr)


def test_counts_equal_brute_force(spark):
    rows = edge_rows()
    for k in range(60):
        text = words(30 + k, k, 30 if k % 3 else 4000)
        rows.append((100 + k, ("\n" if k % 2 else " ").join(text) + "\n#*|\r\n x \n x \n" * (k % 4)))
    check(spark, rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n\t#é\x0b<", max_size=120), min_size=1, max_size=20))
def test_counts_of_odd_texts(spark, texts):
    check(spark, list(enumerate(texts)))


def test_rules_decide(spark):
    clean = "the quick fox is on the way to a river and it has seen that there were "
    rows = [(1, " ".join(f"{w}{i}" if i % 3 else w for i, w in enumerate(clean.split() * 6)))]
    rows += [(2, rows[0][1].upper() + "!!"), (3, rows[0][1].replace(" ", "### ")), (4, "too short"), (5, None)]
    got = {r.doc_id: r.kept for r in quality.quality(docs_table(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert quality.quality(docs_table(spark, [])).count() == 0


def test_no_user_functions_in_the_plan(spark, capsys):
    quality.quality(docs_table(spark, [(1, "a")])).explain()
    assert "Python" not in capsys.readouterr().out
