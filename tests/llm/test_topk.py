"""Exact top-k search against brute force over all rows."""

import math
import random

import numpy as np
import pytest

from wattloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score int, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "x") for i, v in rows], SCHEMA)


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def brute(rows, k=5, every=50):
    held = [(i, whole(v)) for i, v in rows]
    held = [(n, i, v) for n, (i, v) in enumerate(held) if v is not None]
    out = []
    for n, i, v in held:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, j, w in held if m != n]
        out += [(i, r + 1, None if gone else j, -s) for r, (s, gone, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def gaussian(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(k, rng.normal(0, 0.2, dims).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("block, blocks", [(4096, 32), (16, 2)])
def test_equals_brute_force(spark, block, blocks):
    rows = gaussian(400, 12, 1)
    random.Random(2).shuffle(rows)
    assert got(topk.top_inner_products(table(spark, rows), block=block, blocks=blocks)) == brute(rows)


def test_clusters_are_eliminated_and_right(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (8, 6))
    rows = [(k, (centres[k % 8] + rng.normal(0, 0.01, 6)).astype(np.float32).tolist()) for k in range(600)]
    assert got(topk.top_inner_products(table(spark, rows), block=32, blocks=1)) == brute(rows)


def test_one_common_vector(spark):
    rows = gaussian(150, 5, 4) + [(1000 + k, [0.5, -0.25, 0.125, 0.0, 1.0]) for k in range(300)]
    assert got(topk.top_inner_products(table(spark, rows), block=16, blocks=2)) == brute(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (100, None), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf, 1.0]),
        (300, []), (350, [1.0]), (None, [9.0, 9.0]), (None, [1.0, 2.0]), (1, [-1.0, -2.0, 5.0]), (2, [0.0, 0.0]), (-50, [0.1, -0.1]),
    ]
    assert got(topk.top_inner_products(table(spark, rows))) == brute(rows)


def test_few_rows_and_none(spark):
    assert got(topk.top_inner_products(table(spark, []))) == []
    assert got(topk.top_inner_products(table(spark, [(0, [1.0])]))) == []
    assert got(topk.top_inner_products(table(spark, [(0, [1.0]), (1, [2.0])]))) == [(0, 1, 1, 256 * 512)]
    assert got(topk.top_inner_products(table(spark, [(0, None)]))) == []


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**20 + k), -float(2**19 - 3 * k), 0.5]) for k in range(120)]
    assert got(topk.top_inner_products(table(spark, rows))) == brute(rows)
    with pytest.raises(OverflowError):
        topk.top_inner_products(table(spark, [(0, [1e30]), (1, [1.0])]))


def test_bounds_stop_early(spark, monkeypatch):
    """In clusters, only a small share of the rows is evaluated."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (10, 8))
    rows = np.floor(256 * (centres[np.arange(2000) % 10] + rng.normal(0, 0.02, (2000, 8))))
    norms = (rows**2).sum(axis=1)
    square = norms.max()
    chosen = rows[topk.farthest_first(rows[:500], square, 16)]
    space = topk.Space(8, square, "<i4", chosen, topk.lift(square, (chosen**2).sum(axis=1)))
    away = topk.distances(rows, norms, topk.lift(square, norms), space)
    held = topk._Rows(np.arange(2000), np.arange(2000), np.ones(2000, bool), rows, away)
    counted = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            counted.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    held = held._replace(vectors=rows.view(Counting))
    query = int(norms.argmax())
    asked = topk.distances(rows[[query]], norms[[query]], np.zeros(1), space)
    asker = topk._Asker(query, query, rows[query], norms[query], -np.inf, 5)
    asker.meet(held, topk._bounds(asked, norms[[query]], away, space)[0])
    scores = rows @ rows[query]
    scores[query] = -np.inf
    assert sorted(asker.scores.tolist()) == sorted(np.sort(scores)[-5:].tolist())
    assert sum(counted) < 600
