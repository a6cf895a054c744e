"""Ordered scans and quantiles give the same result whether or not groups count as hot."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from wattloom.model import ROW_ID
from wattloom.operators import impute, quality, quantiles, scans, series


def skewed(spark, n=600, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.4 else round(rng.choice([rng.gauss(0, 1), rng.uniform(-1e6, 1e6), 5.0]), 3)
        data.append((i * 7, key, value, 2000 + rng.randrange(8)))
    return data, spark.createDataFrame(data, f"{ROW_ID} bigint, k string, v double, year int")


@pytest.mark.parametrize("hot_rows", [20, 10_000])
@pytest.mark.parametrize("backward", [False, True])
def test_fill_against_plain_loop(spark, as_rows, hot_rows, backward):
    data, df = skewed(spark)
    expected, last = [], {}
    for row_id, key, value, _ in sorted(data, reverse=backward):
        if key is None:
            expected.append((row_id, value))
            continue
        last[key] = value if value is not None else last.get(key)
        expected.append((row_id, last[key]))
    out = scans.filled(df, ["k"], ROW_ID, "v", backward, hot_rows=hot_rows)
    assert as_rows(out, ROW_ID, "v") == sorted(expected, key=repr)


@pytest.mark.parametrize("hot_rows", [15, 10_000])
def test_unique_names_against_plain_loop(spark, as_rows, hot_rows):
    rng = random.Random(5)
    names = [rng.choice(["x", "x", "x", "y", "z", "", " x "]) for _ in range(300)] + ["alone"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"{ROW_ID} bigint, name string")
    seen, expected = {}, []
    stripped = [n.strip() for n in names]
    for i, n in enumerate(stripped):
        if n and stripped.count(n) > 1:
            seen[n] = seen.get(n, 0) + 1
            expected.append((i, f"{n}_{seen[n]}"))
        else:
            expected.append((i, names[i]))
    out = quality.unique_names(df, hot_rows=hot_rows)
    assert as_rows(out, ROW_ID, "name") == sorted(expected, key=repr)
    assert out.select("name").where("trim(name) <> ''").distinct().count() == sum(1 for n in stripped if n)


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_medians_against_statistics(spark, hot_rows):
    data, df = skewed(spark)
    out = {r["k"]: r["m"] for r in quantiles.medians(df.dropna(subset=["k"]), ["k"], "v", "m", hot_rows).collect()}
    for key in ("hot", "a", "b"):
        values = [v for _, k, v, _ in data if k == key and v is not None]
        assert out[key] == pytest.approx(statistics.median(values), rel=1e-15)


def test_order_statistics_of_hard_values(spark):
    values = [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, 3.0] * 3
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    ordered = sorted(values)
    ranks = {f"r{i}": F.lit(i) for i in range(len(values))}
    row = quantiles.order_statistics(df, ["k"], "v", ranks).first()
    assert [row[f"r{i}"] for i in range(len(values))] == ordered


@pytest.mark.parametrize("list_rows", [5, 10_000])
@pytest.mark.parametrize("how, trim", [("median", 0), ("mean", 0), ("mean", 2), ("median", 1)])
def test_recent_fill_against_plain_loop(spark, list_rows, how, trim):
    data, df = skewed(spark, 300, 9)
    out = impute.fill_recent(df, "v", ["k", "year"], how, True, 4, "year", trim, list_rows=list_rows)
    got = {r[ROW_ID]: r["v"] for r in out.collect()}
    for row_id, key, value, year in data:
        if value is not None:
            assert got[row_id] == value
            continue
        near = sorted(v for _, k, v, y in data if key is not None and k == key and v is not None and abs(y - year) <= 2)
        if not near:
            assert got[row_id] is None
            continue
        if trim and len(near) > 2 * trim:
            near = near[trim:-trim]
        want = max(statistics.median(near) if how == "median" else statistics.fmean(near), 0.0)
        assert got[row_id] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_recent_fill_without_groups(spark):
    data, df = skewed(spark, 120, 4)
    out = impute.fill_recent(df, "v", ["year"], "median", False, 2)
    got = {r[ROW_ID]: r["v"] for r in out.collect()}
    for row_id, _, value, year in data:
        near = [v for _, _, v, y in data if v is not None and abs(y - year) <= 1]
        assert got[row_id] == pytest.approx(value if value is not None else statistics.median(near))


def test_trimmed_window_bounds(spark):
    schema = f"{ROW_ID} bigint, g string, year int, v double"
    five = [(i, "g", 2000, float(v)) for i, v in enumerate([100, 1, 2, 3, -50])] + [(9, "g", 2000, None)]
    two = [(20, "h", 2000, 1.0), (21, "h", 2000, 5.0), (22, "h", 2000, None)]
    out = impute.fill_recent(spark.createDataFrame(five + two, schema), "v", ["g"], "mean", exclude_outliers=1)
    got = {r[ROW_ID]: r["v"] for r in out.collect()}
    assert got[9] == pytest.approx(2.0) and got[22] == pytest.approx(3.0)


def test_salted_join_equals_plain_join(spark, as_rows):
    left = spark.range(500).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11)).alias("k"), "id")
    right = spark.range(11).select(F.col("id").alias("k"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("w"))
    plain = as_rows(left.join(right, "k"), "k", "id", "w")
    assert as_rows(scans.salted_join(left, right, ["k"], hot_rows=20), "k", "id", "w") == plain
    assert as_rows(scans.salted_join(left, right, ["k"]), "k", "id", "w") == plain


def test_positions_count_through_chunks(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    out = scans.positions(df, ["x"], F.floor(F.col("x") / 9), "pos")
    assert all(r["x"] == r["pos"] for r in out.collect())


def test_regression_falls_back_to_group_mean(spark):
    schema = f"{ROW_ID} bigint, g string, p double, v double"
    one = spark.createDataFrame([(1, "a", 1.0, 4.0), (2, "a", 2.0, None)], schema)
    assert {r[ROW_ID]: r["v"] for r in impute.fill_regression(one, "v", ["g"], ["p"]).collect()} == {1: 4.0, 2: 4.0}
    gap = spark.createDataFrame([(1, "a", 1.0, 4.0), (2, "a", 2.0, 6.0), (3, "a", None, None)], schema)
    assert impute.fill_regression(gap, "v", ["g"], ["p"]).where(f"{ROW_ID} = 3").first()["v"] == 5.0


def test_singular_regression_still_predicts(spark):
    schema = f"{ROW_ID} bigint, g string, p double, q double, v double"
    data = [(i, "a", float(i), 2.0 * i, 3.0 * i + 1) for i in range(6)] + [(9, "a", 10.0, 20.0, None)]
    out = impute.fill_regression(spark.createDataFrame(data, schema), "v", ["g"], ["p", "q"])
    assert out.where(f"{ROW_ID} = 9").first()["v"] == pytest.approx(31.0)


def test_forward_fill_of_series_is_the_same_when_hot(spark, as_rows):
    from wattloom.bindings.q_series import _gappy
    from wattloom.bindings.views import Tables

    gappy = _gappy(Tables(spark, "/root/testdata/sf0.001"))
    assert as_rows(series.forward_fill(gappy, hot_rows=5)) == as_rows(series.forward_fill(gappy))


def test_salted_left_join_keeps_unmatched_and_keyless_rows(spark, as_rows):
    left = spark.createDataFrame([("a" if i % 10 else None if i % 20 else "z", i) for i in range(300)], "k string, id int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, w int")
    plain = as_rows(left.join(right, "k", "left"), "k", "id", "w")
    for hot_rows in (20, 1000):
        assert as_rows(scans.salted_join(left, right, ["k"], hot_rows, "left"), "k", "id", "w") == plain


@pytest.mark.parametrize("backward", [False, True])
def test_no_fill_walks_the_rest_of_its_group_for_every_row(spark, backward):
    """A window frame that ends with the group is evaluated anew for each row: quadratic in the rows of a group."""
    _, df = skewed(spark, 50)
    plan = scans.filled(df, ["k"], ROW_ID, "v", backward)._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_trimmed_window_of_large_groups_sends_no_row_per_window(spark):
    """Extremes of any size leave the mean of the rest as it is, and rows are not copied to the years around them."""
    values = [float("inf"), 1e300, -1e300, float("-inf"), *[float(i % 10) for i in range(200)]]
    data = [(i, "g", 2000 + i % 5, v) for i, v in enumerate(values)] + [(900, "g", 2002, None), (901, "g", 2009, None), (902, None, 2002, None)]
    df = spark.createDataFrame(data, f"{ROW_ID} bigint, g string, year int, v double").repartition(3)
    out = impute.fill_recent(df, "v", ["g"], "mean", False, 4, "year", 2, list_rows=10)
    got = {r[ROW_ID]: r["v"] for r in out.where(f"{ROW_ID} >= 900").collect()}
    assert got[900] == pytest.approx(4.5) and got[901] is None and got[902] is None
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().replace("explode(sequence(0, coalesce", "")
