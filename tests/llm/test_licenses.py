"""Licence notices against a plain computation over all units and templates."""

import re

from llm_data import docs_table, edge_rows, words

from wattloom.llm import licenses


def pairs(text):
    parts = re.findall(r"[^\W_]+", text.lower())
    return set(zip(parts, parts[1:]))


def brute_force(text):
    units = {text, *text.split("\n"), *re.split(r"\n\s*\n", text)}
    found = {}
    for unit in units:
        best = min(
            ((-2 * len(pairs(unit) & pairs(t)) / (len(pairs(unit)) + len(pairs(t))), name) for name, t in licenses.NOTICES.items()),
            default=(0, ""),
        )
        if -best[0] >= licenses.SIMILARITY:
            found[best[1]] = max(found.get(best[1], 0), -best[0])
    return ",".join(sorted(found)), max(found.values(), default=None)


def texts():
    out = []
    for k, (name, text) in enumerate(sorted(licenses.NOTICES.items())):
        flat = " ".join(text.split())
        changed = flat.split()
        changed[len(changed) // 2 :: 9] = ["x"] * len(changed[len(changed) // 2 :: 9])
        prose = " ".join(words(60, k))
        out += [prose + "\n" + flat + "\n" + prose, prose + "\n\n" + text.upper() + "\n\n" + prose, flat, " ".join(changed), prose, flat + " " + prose]
    return list(enumerate(out))


def test_equal_to_brute_force(spark):
    rows = texts() + [(d if d is None else d + 1000, t) for d, t in edge_rows()]
    got = {r.doc_id: (r.licenses, r.best_dice) for r in licenses.licenses(docs_table(spark, rows)).collect()}
    for doc_id, text in rows:
        if doc_id is not None:
            want = brute_force(text or "")
            assert got[doc_id][0] == want[0], (doc_id, text)
            assert (got[doc_id][1] is None) == (want[1] is None) and abs((got[doc_id][1] or 0) - (want[1] or 0)) < 1e-12


def test_edges_and_native_plan(spark, capsys):
    assert licenses.licenses(docs_table(spark, [])).count() == 0
    assert licenses.licenses(docs_table(spark, edge_rows())).count() == len(edge_rows())
    assert licenses.licenses(docs_table(spark, [(1, "Released under the MIT License.")]), {}).head().n_licenses == 0
    licenses.licenses(docs_table(spark, [(1, "a")])).explain()
    assert "Python" not in capsys.readouterr().out
