"""The mix against a plain computation."""

import hashlib
import math
import re

from llm_data import docs_table, edge_rows, words

from wattloom.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > cap * sizes[s]}
        if not over:
            return target | {s: cap * sizes[s] for s in full}
        full |= over


def brute_force(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = {}
    for n, (_, _, s) in zip(size, rows):
        sizes[s] = sizes.get(s, 0) + n
    targets = brute_targets(sizes)
    out = [0] * len(rows)
    for source, total in sizes.items():
        epochs = int(targets[source] // total) if total else 0
        rest, so_far = targets[source] - epochs * total, 0

        def key(i):
            text = rows[i][1]
            symbols = sum(c in mixing.SYMBOLS for c in text or "")
            weight = max(1 - 10 * (symbols / len(text) if text else 0), 0.1)
            u = (int(hashlib.md5(f"mix:{rows[i][0]}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            return -math.log(u) / weight, rows[i][0], size[i]

        for i in sorted((i for i, r in enumerate(rows) if r[2] == source), key=key):
            out[i] = size[i] * (epochs + (so_far + size[i] / 2 <= rest and so_far < rest))
            so_far += size[i]
    return [(r[0], n, sizes[r[2]], float(targets[r[2]]), t) for r, n, t in zip(rows, size, out)]


def sources():
    rows = []
    for k in range(600):
        source = "big" if k % 3 == 0 else f"s{k % 11}" if k % 17 else None
        text = " ".join(words(1 + k * 13 % 90, k)) + ("###" * (k % 5))
        rows.append((k, text, source))
    return rows


def test_equal_to_brute_force(spark):
    rows = sources()
    got = mixing.mix(docs_table(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = sorted(brute_force(rows))
    got = sorted(tuple(r) for r in got)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert all(math.isclose(g[3], w[3]) for g, w in zip(got, want))
    assert all(t <= 2 * n for _, n, _, _, t in got)


def test_copies_follow_the_mix(spark):
    docs = docs_table(spark, sources())
    plan = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in plan.items() if n}


def test_edge_rows(spark):
    docs = docs_table(spark, [(d, t, None if (d or 0) % 2 else "a") for d, t in edge_rows()])
    got = mixing.mix(docs).collect()
    assert len(got) == len(edge_rows()) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(docs_table(spark, [])).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs_table(spark, [(1, None, "a"), (2, "", "b")])).select("taken").distinct().collect()[0].taken == 0
