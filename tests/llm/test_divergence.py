"""Divergence audit against plain counting over all rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm_data import edge_rows

from wattloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item int, value string, v int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, 0, 1, "x", 2) for k, (lang, s, t) in enumerate(rows)], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(counter):
            n = sum(counter[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 5) // n for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", x, -f, r + 1) for r, (f, x) in enumerate(sorted(pairs, key=lambda a: (a[0], a[1].encode())))]
            out += [(lang, s, "term", t.decode(), -f, r + 1) for r, (f, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(n, seed):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        source = pick.choice(["a", "b", "c", "d", "é"]) if pick.random() < 0.6 else "a"
        words = [f"{'wW'[pick.random() < 0.2]}{'abcdefghij'[int(pick.random() ** 2 * 10)]}{'xyzüñ漢'[pick.randrange(6)]}" for _ in range(pick.randrange(40))]
        out.append((pick.choice(["en", "fr"]), source, pick.choice([" ", "-", "1", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("limits", [{}, {"block": 20, "segment": 3, "fan_in": 3, "shards": 3, "pair_limit": 7}])
def test_equals_plain_counting(spark, limits):
    rows = some_rows(400, 1)
    assert got(divergence.divergence(table(spark, rows).repartition(4), min_documents=30, **limits)) == brute(rows, 30)


def test_defined_cases(spark):
    rows = [("en" if k % 3 else None, None if k % 2 else "s", t) for k, (_, t) in enumerate(edge_rows())]
    rows += [("zz", "one", "no term twice"), ("zz", "two", ""), ("zz", None, None), ("", "", "the the THE"), ("en", "s", "\x00\x80a ÀB")]
    for least in (1, 2, 30):
        assert got(divergence.divergence(table(spark, rows), min_documents=least, shards=2)) == brute(rows, least)
    assert got(divergence.divergence(table(spark, []))) == []


def test_hot_source_and_long_texts(spark, monkeypatch):
    rows = [("en", "hot", "alpha Beta gamma " * (k % 5 + 1)) for k in range(300)]
    rows += [("en", f"s{k}", f"alpha beta t{chr(97 + k)}") for k in range(20)] + [("en", "hot", "alpha delta " * 3000)]
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert got(divergence.divergence(table(spark, rows), min_documents=5)) == brute(rows, 5)
    assert [w for part in divergence.terms_of(b"ab cd efg h", 3) for w in part] == [b"ab", b"cd", b"efg", b"h"]
