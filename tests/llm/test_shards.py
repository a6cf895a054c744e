"""Shards: laws, atomic groups, and the smallest capacity against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm_data import docs_table, edge_rows, words

from wattloom.llm import shards


def need(sizes, capacity):
    n, room = 1, capacity
    for s in sizes:
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


def brute_capacity(rows, n):
    sizes = Counter()
    for _, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    order = [s for _, s in sorted((hashlib.md5(t.encode()).hexdigest(), s) for t, s in sizes.items())]
    return next(c for c in range(max(order), sum(order) + 1) if need(order, c) <= n)


def verify(got, rows, n):
    assert len(got) == len(rows)
    slots, shard_of = defaultdict(list), defaultdict(set)
    by_id = defaultdict(list)
    for d, t in rows:
        by_id[d].append(t)
    for r in got:
        slots[r.shard].append(r.slot)
        texts = [t or "" for t in by_id[r.doc_id]]
        assert r.size in {len(t.encode()) + 1 for t in texts} and r.text_crc32 in {zlib.crc32(t.encode()) for t in texts}
        shard_of[r.text_crc32].add(r.shard)
    assert all(0 <= s < n for s in slots)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in shard_of.values())


@pytest.mark.parametrize("digits", [1, 4])
def test_capacity_is_the_smallest(spark, digits, monkeypatch):
    monkeypatch.setattr(shards, "_PREFIX", digits)
    monkeypatch.setattr(shards, "_STEP", 1)
    rng = random.Random(4)
    rows = [(k, " ".join(words(rng.randrange(1, 40), k % 350))) for k in range(500)]
    got = shards.sharded(docs_table(spark, rows), 16).collect()
    verify(got, rows, 16)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) == brute_capacity(rows, 16)


def test_large_groups_stand_alone_and_the_rest_is_even(spark):
    rows = [(k, "the same text for a third of all rows") for k in range(700)]
    rows += [(1000 + k, " ".join(words(6, k))) for k in range(1500)]
    got = shards.sharded(docs_table(spark, rows), 16).collect()
    verify(got, rows, 16)
    load = sorted(Counter({s: sum(r.size for r in got if r.shard == s) for s in range(16)}).values())
    assert load[0] > 0.9 * load[-2]


def test_edges(spark):
    rows = edge_rows()
    verify(shards.sharded(docs_table(spark, rows)).collect(), rows, 16)
    assert shards.sharded(docs_table(spark, [])).count() == 0
    one = shards.sharded(docs_table(spark, [(1, None)])).collect()
    assert [(r.shard, r.slot, r.size, r.text_crc32) for r in one] == [(0, 0, 1, 0)]
    same = shards.sharded(docs_table(spark, [(k, "x") for k in range(50)])).collect()
    assert len({r.shard for r in same}) == 1 and sorted(r.slot for r in same) == list(range(50))


def test_greedy_and_search():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))]
        n = rng.randrange(1, 8)
        want = next(c for c in range(max(sizes), sum(sizes) + 1) if need(sizes, c) <= n)
        assert shards.smallest_capacity(sizes, n) == want
