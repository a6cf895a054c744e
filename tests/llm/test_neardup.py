"""Near-duplicate classes against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from llm_data import docs_table, edge_rows, words

from wattloom.llm import neardup
from wattloom.llm.graph import components


def shingles(text):
    parts = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not parts:
        return None
    return Counter(tuple(parts[i : i + 5]) for i in range(len(parts) - 4)) if len(parts) >= 5 else Counter([("short", *parts)])


def brute_force(rows, similarity=0.8):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and sum((x & y).values()) >= similarity * sum((x | y).values()):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d, _ in rows}


def variants(rng, base, n, changes):
    for _ in range(n):
        out = list(base)
        for _ in range(changes):
            out[rng.randrange(len(out))] = f"v{rng.randrange(10**6)}"
        yield " ".join(out)


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for k in range(25):
        base = words(60 + 25 * k, k)
        texts += [" ".join(base)] * (1 + k % 3)
        texts += list(variants(rng, base, 3, 1 + k % 4))
        texts += list(variants(rng, base, 2, 20 + k))
    texts += list(variants(rng, words(200, 77), 60, 2))
    texts += [" ".join(words(80, 200 + k)) for k in range(40)]
    shared = " ".join(words(60, 999))
    texts += [" ".join(words(20, 300 + k)) + " " + shared for k in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_table(spark, rows)).collect()}
    assert got == brute_force(rows)


def templated_group(seed=4242):
    """A template with six fields: any two forms are at 0.798, but the last two also share the last word (0.806)."""
    base = words(200, seed, 10**6)

    def form(fields):
        out = list(base)
        out[0::199] = fields[:2]
        out[20:180:40] = fields[2:]
        return " ".join(out)

    # Forms with an own part, which no other document can be similar to.
    texts = [" ".join(words(70, 5000 + k)) + " " + " ".join(base) for k in range(40)]
    texts += [form([f"f{k}x{i}" for i in range(6)]) for k in range(200)]
    texts += [form([f"g{k}", "same", *[f"g{k}x{i}" for i in range(4)]]) for k in range(2)]
    return list(enumerate(texts))


def test_templated_group_equals_brute_force(spark):
    rows = templated_group()
    want = brute_force(rows)
    assert [d for d, c in want.items() if c != d] == [241]
    for block in (16, 128):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_table(spark, rows), block=block).collect()}
        assert got == want


def test_shared_occurrences_of_blocks():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.integers(0, 40, n)).astype(np.uint32) for n in (1, 30, 60, 200)]
    shared = neardup._shared(sets[:2], sets[1:], width=7)
    for i, x in enumerate(sets[:2]):
        for j, y in enumerate(sets[1:]):
            assert shared[i, j] == sum((Counter(x.tolist()) & Counter(y.tolist())).values())


def test_edge_rows(spark):
    rows = edge_rows()
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs_table(spark, rows)).collect()), key=repr)
    same = rows[5][1]
    assert got == sorted(((d, 6 if t == same else d) for d, t in rows), key=repr)
    assert neardup.near_duplicates(docs_table(spark, [])).count() == 0
    kept = neardup.one_of_each(docs_table(spark, rows))
    assert kept.columns == docs_table(spark, []).columns
    want = [r for r in rows if r[1] != same] + [(6, same)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert neardup.one_of_each(docs_table(spark, [])).count() == 0


def test_rows_with_one_id_or_none_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(words(40, k)) for k in (71, 72, 73))
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, c + " x")]
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs_table(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, 3), (None, 3), (3, 3)], key=repr)
    kept = [(r.doc_id, r.text) for r in neardup.one_of_each(docs_table(spark, rows)).collect()]
    assert sorted(kept) == sorted([(1, a), (1, b), (3, c + " x")])


def test_words_that_collide_in_a_polynomial(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(f"x{k} {word}" for k in range(20))), (2, " ".join(f"x{k} {other}" for k in range(20)))]
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_table(spark, rows)).collect()} == {1: 1, 2: 2}


def test_edited_family_is_left_out_by_counts(spark):
    """A large family of edited copies: the rows that meet in the last step are bounded by the members, not their square."""
    rng = random.Random(11)
    base = words(300, 90, 10**6)
    rows = list(enumerate(variants(rng, base, 240, 12)))
    docs = docs_table(spark, rows)
    met = []
    plain = neardup.block_pairs

    def counting(members, block):
        out = neardup.stored(plain(members, block), "counted")
        met.append((members.count(), out.count()))
        return out

    neardup.block_pairs = counting
    try:
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, block=16).collect()}
    finally:
        neardup.block_pairs = plain
    assert got == brute_force(rows)
    assert all(out <= 3 * n for n, out in met)


def test_members_of_a_large_class_meet_only_those_outside_it(spark):
    """The rows of the block pairs grow with a class and not with its square."""

    def met(n):
        members = [(0, rep, 5, 300, 320.0) for rep in range(n)] + [(0, n + k, 1000 + k, 300, 320.0) for k in range(10)]
        columns = "band long, rep long, class long, size long, reach double"
        out = neardup.block_pairs(spark.createDataFrame(members, columns), 16).select("rep").collect()
        assert {r.rep for r in out} == set(range(n + 10))
        return len(out)

    assert met(300) <= 600 and met(600) <= 1200


def test_blocks_bring_every_pair_of_classes_together(spark):
    """Pairs of different classes that may be similar meet in just one pair of blocks, strong members being one side."""
    rng = random.Random(13)
    members = []
    for rep in range(300):
        kind = rng.choice([1000, 1000, 1000, 1001, 1001, 1002 + rep])
        size = rng.randrange(200, 320)
        members.append((rng.randrange(2), rep, kind, size, size * rng.choice([0.97, 1.02, 1.1])))
    met = defaultdict(set)
    columns = "band long, rep long, class long, size long, reach double"
    for r in neardup.block_pairs(spark.createDataFrame(members, columns), 16).collect():
        met[r.band, r.low, r.high].add((r.side, r.rep))
    together = Counter()
    for (band, low, high), side in met.items():
        for x, a in side:
            for y, b in side:
                if a < b and (low == high or x != y):
                    together[band, a, b] += 1
    assert set(together.values()) == {1}
    for i, (band, a, kind, size, reach) in enumerate(members):
        for other, b, of_b, size_b, reach_b in members[i + 1 :]:
            fit = size_b <= reach and size <= reach_b and (size <= reach or size_b <= reach_b)
            if band == other and kind != of_b and fit:
                assert together[band, a, b] == 1


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 600).astype(np.uint64)
    weights = rng.integers(1, 6, 600)
    other = weights.copy()
    other[:150] = rng.integers(1, 6, 150)
    k = 2000
    document = np.repeat([0, 1], 600)
    signed = neardup.signatures(document, np.concatenate([pool, pool]), np.concatenate([weights, other]), 2, k)
    true = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    assert abs((signed[0] == signed[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5
    alone = neardup.signatures(document[:600], pool, weights, 1, k)
    assert (alone[0] == signed[0]).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    graph = defaultdict(set)
    for a, b in links:
        if a != b:
            graph[a].add(b), graph[b].add(a)
    want = {}
    for node in graph:
        seen, todo = {node}, [node]
        while todo:
            for other in graph[todo.pop()] - seen:
                seen.add(other), todo.append(other)
        want[node] = min(seen)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r["class"] for r in got.collect()} == want
