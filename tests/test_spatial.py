"""Clustering, components and nearest sites against brute force."""

import math
import random

import pytest

from wattloom.model import ROW_ID
from wattloom.operators import places, quality, spatial
from wattloom.plans import extraction


def brute_components(points, eps):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(points):
        for j, b in enumerate(points[:i]):
            if math.dist(a, b) <= eps:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(points)):
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def cloud(seed, n=220):
    rng = random.Random(seed)
    dense = [(10 + rng.gauss(0, 0.02), 5 + rng.gauss(0, 0.02)) for _ in range(n // 3)]
    loose = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(n // 3)]
    chain = [(3 + 0.0449 * i, -2.0) for i in range(n // 3)]
    return dense + loose + chain + dense[:10]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    points = cloud(seed)
    data = [(i, x, y) for i, (x, y) in enumerate(points)]
    eps = 5000 / 111000
    for order in (data, random.Random(0).sample(data, len(data))):
        out = spatial.cluster_points(spark.createDataFrame(order, "row_id int, x double, y double"), 5000).collect()
        groups = {}
        for r in out:
            groups.setdefault(r["component"], set()).add(r["row_id"])
        assert sorted(map(sorted, groups.values())) == brute_components(points, eps)


def test_points_just_apart(spark):
    # Two dense cells whose nearest points differ by a hair from the limit, one way and the other.
    eps = 1.0
    left = [(0.1 + 0.001 * i, 0.1 * j) for i in range(8) for j in range(5)]
    edge = max(x for x, _ in left)
    for gap, linked in ((eps * (1 + 1e-9), False), (eps * (1 - 1e-9), True)):
        right = [(edge + gap + 0.001 * i, 0.1 * j) for i in range(8) for j in range(5)]
        df = spark.createDataFrame(left + right, "x double, y double")
        placed = spatial.with_cell(df, eps)
        edges = spatial.eps_neighbours(df, eps).selectExpr("cell_a a", "cell_b b")
        nodes = placed.selectExpr("cell node").distinct()
        n = spatial.components(nodes, edges).select("component").distinct().count()
        assert n == (1 if linked else 2)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 500 + i) for i in range(50)]
    nodes = sorted({n for e in edges for n in e} | {9999})
    out = spatial.components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r["node"]: r["component"] for r in out.collect()}
    assert got == {n: (100 if 100 <= n <= 160 else 9999 if n == 9999 else 5) for n in nodes}


@pytest.mark.parametrize("n", [1, 40, 700])
def test_nearest_equals_brute_force(spark, n):
    rng = random.Random(n)
    sites = [(i, rng.gauss(0, 1) if i % 2 else 50 + rng.gauss(0, 1e-3), rng.gauss(0, 1)) for i in range(n)]
    spots = [(rng.uniform(-60, 60), rng.uniform(-5, 5)) for _ in range(60)] + [(x, y) for _, x, y in sites[:20]]
    out = spatial.nearest(
        spark.createDataFrame(spots, "x double, y double"), spark.createDataFrame(sites, "bus_id int, x double, y double")
    ).collect()
    assert len(out) == len(set(spots))
    for r in out:
        d = {i: math.dist((r["x"], r["y"]), (x, y)) for i, x, y in sites}
        assert d[r["bus_id"]] == pytest.approx(min(d.values()), abs=1e-12)


def test_build_network_joins_ends_to_clusters(spark):
    features = spark.createDataFrame(
        [
            (0, "[[127.0,37.0],[128.0,37.0]]", "345000", 2),
            (1, "[[128.01,37.0],[129.0,36.0],[129.0,35.0]]", "345000", None),
            (2, "[[127.0,37.0],[127.0,37.0]]", "345000", 1),
            (3, "[[127.0,37.0],[130.0,37.0]]", "22900", 1),
            (4, "nonsense", "765000", 1),
        ],
        "line_id int, lonlat string, voltage string, circuits int",
    )
    stations = spark.createDataFrame([(0, 127.001, 37.0, "765 kV", "North")], "substation_id int, lon double, lat double, voltage string, name string")
    buses, lines = extraction.build_network([features], stations, 220.0)
    by_id = {r["bus_id"]: r for r in buses.collect()}
    assert sorted(r["name"] for r in by_id.values()) == ["North", "bus_1", "bus_2"]
    ends = {r["line_id"]: (by_id[r["bus0"]]["name"], by_id[r["bus1"]]["name"]) for r in lines.collect()}
    assert ends == {0: ("North", "bus_1"), 1: ("bus_1", "bus_2")}
    out = extraction.export_network(buses, lines, "kr")
    row = out["lines"].where("name = '0'").first()
    assert row["r"] == pytest.approx(0.1 * 111.0 / 2) and row["x"] == pytest.approx(0.3 * 111.0 / 2)
    assert tuple(out["network"].first()) == ("KR_network", 1, 3, 2)


def test_jitter_stays_in_its_circle_and_repeats(spark, as_rows):
    df = spark.createDataFrame([(i, 127.0, 37.0) for i in range(200)] + [(900, None, 1.0)], f"{ROW_ID} bigint, x double, y double")
    moved = quality.jitter(df, 2.0, seed=3)
    radius = [math.dist((127.0, 37.0), (r["x"], r["y"])) for r in moved.dropna().collect()]
    assert max(radius) <= 2 * 0.009 and min(radius) < 0.009 and len(set(radius)) == 200
    assert as_rows(moved) == as_rows(quality.jitter(df.repartition(3), 2.0, seed=3))
    assert as_rows(quality.jitter_if_same(df, 2.0, seed=3)) == as_rows(moved)


def test_gazetteer_keeps_known_and_prefers_the_full_text(spark):
    df = spark.createDataFrame(
        [(1, "가 나군 다 1 (x)", None, None), (2, "가 나군 라", 9.0, 9.0), (3, "가", None, None), (4, None, None, None), (5, "가 나군 다 2", None, None)],
        "id int, address string, x double, y double",
    )
    gazetteer = spark.createDataFrame([("가 나시", 1.0, 1.0), ("가 나군 다", 2.0, 2.0), ("가 나군 다 1 (x)", 3.0, 3.0)], "address string, x double, y double")
    got = {r["id"]: r["x"] for r in places.gazetteer_match(df, gazetteer).collect()}
    assert got == {1: 3.0, 2: 9.0, 3: None, 4: None, 5: 2.0}
