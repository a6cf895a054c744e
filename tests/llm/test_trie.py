"""Prefix trie against plain walking of all rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wattloom.llm import ordered, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, id string, next int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def remainder(c):
    return c - 5 * int(c / 5) if abs(c) < 2**50 else (abs(c) % 5) * (1 if c > 0 else -1)


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    members, ended, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - remainder(c), [])[:h] + turns[c][h:])
        ended[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
            if d:
                children[whole[: d - 1]].add(whole[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(held) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children.get(node, ())),
            leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ended.get(node, [])))).encode()).hexdigest(),
        )
        for node, held in members.items()
    )


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.select(*names).collect())


def some_rows(n, seed, longest=7):
    pick = random.Random(seed)
    return [
        (c, t, pick.choice(["user", "bot"]), pick.choice(["a", "b", "ü"]) * pick.randrange(3))
        for c in range(n) for t in range(pick.randrange(1, longest))
    ]


@pytest.mark.parametrize("limits", [{}, {"rows": 40, "round_rows": 60, "last": 8}])
def test_equals_plain_walking(spark, limits):
    rows = some_rows(90, 1)
    random.Random(2).shuffle(rows)
    assert got(trie.prefix_trie(table(spark, rows), **limits)) == brute(rows)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(400)]
    rows += [(100 + c, t, "bot", f"same {t}") for c in range(60) for t in range(9)]
    assert got(trie.prefix_trie(table(spark, rows), rows=50, round_rows=40, last=10)) == brute(rows)


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 4)
    rows = [
        (None, 0, "user", "nobody"), (3, None, "user", "null turn"), (3, 0, "user", None), (3, 0, None, "tie"), (3, 0, None, "tie"),
        (-3, 1, "a", "x"), (-4, 0, "a", "x"), (0, 0, "a", "zero"), (0, 1, "a", ""), (2**63 - 1, 0, "a", "largest"), (-(2**63), 0, "a", "least"),
        (8, 0, "only", "one"), (9, 0, None, None), (11, 5, "ab", "c"), (12, 5, "a", "bc"), (14, 0, "u", "ß" * 100_000),
    ]
    rows += [(1000 + c, 0, "same", "same") for c in range(40)]
    assert got(trie.prefix_trie(table(spark, rows))) == brute(rows)
    assert got(trie.prefix_trie(table(spark, []))) == []
    assert got(trie.prefix_trie(table(spark, [(None, 0, "a", "b")]))) == []


def test_ranks_of_a_list_in_any_order(spark):
    n = 500
    order = np.random.default_rng(1).permutation(n).tolist()
    rows = [(a, b, a % 7, a, 1, a % 2, 2 * a) for a, b in zip(order, [*order[1:], -1])]
    arcs = spark.createDataFrame(rows, "arc long, next long, conv_id long, depth long, one long, leaf long, saved long")
    found = {r.arc: (r.one, r.leaf, r.saved) for r in trie.ranks(arcs, round_rows=50, last=20).collect()}
    assert found == {a: (k, sum(x % 2 for x in order[:k]), sum(2 * x for x in order[:k])) for k, a in enumerate(order)}


def test_running_sums_over_ranges(spark):
    rows = [(k // 150, k, (k * 2654435761) % 2**62, 1) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, at long, x long, one long").repartition(3)
    sums, want = defaultdict(int), {}
    for key, at, x, _ in rows:
        sums[key] = (sums[key] + x) & ordered.MASK
        want[at] = sums[key]
    for parts in (1, 7):
        found = ordered.running(df, "key", ["at"], ["x", "one"], parts).collect()
        assert {r["at"]: r["run_x"] for r in found} == want
        assert {r["at"]: r["run_one"] for r in found} == {at: at % 150 + 1 for at in want}
