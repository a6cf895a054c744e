"""Years, buckets, facts and loads: the cases that the tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.functions import temporal
from wattloom.model import SERIES_SCHEMA
from wattloom.operators import columns, facts, loads, quality, series, topology

H = dt.timedelta(hours=1)


def hours(start, n):
    return [start + i * H for i in range(n)]


def as_series(spark, stamps, values=None, component="loads", attribute="p_set", name="a"):
    values = values or [float(i) for i in range(len(stamps))]
    return spark.createDataFrame([(component, attribute, name, s, v) for s, v in zip(stamps, values)], SERIES_SCHEMA)


def dimension(spark, stamps):
    return series.snapshot_dimension(spark.createDataFrame([(s,) for s in stamps], "snapshot timestamp_ntz"))


def test_shift_to_a_leap_year_adds_24_hours(spark):
    df = as_series(spark, hours(dt.datetime(2023, 2, 28), 48))
    out = series.shift_year(df, 2023, 2024).collect()
    assert len(out) == 72
    assert sorted(r["value"] for r in out if (r["snapshot"].month, r["snapshot"].day) == (2, 29)) == [float(i) for i in range(24)]


def test_shift_to_a_common_year_drops_the_leap_day(spark):
    df = as_series(spark, hours(dt.datetime(2024, 2, 28), 72))
    out = [r["snapshot"] for r in series.shift_year(df, 2024, 2023).collect()]
    assert len(out) == 48 and dt.datetime(2023, 3, 1, 5) in out and all(s.year == 2023 for s in out)


def test_monthly_shift_sets_the_leap_day_aside(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29), 1.0), (dt.datetime(2024, 3, 1), 2.0), (dt.datetime(2023, 3, 1), 3.0)], "snapshot timestamp_ntz, value double")
    good, bad = series.monthly_to_target(df, 2024, 2025)
    assert [tuple(r) for r in good.collect()] == [(dt.datetime(2025, 3, 1), 2.0)]
    assert [r["value"] for r in bad.collect()] == [1.0]


def test_buckets_start_at_midnight(spark):
    stamps = hours(dt.datetime(2024, 1, 1, 3), 8)
    out = series.resample(as_series(spark, stamps), dimension(spark, stamps), 5)
    got = {r["snapshot"].hour: r["value"] for r in out.collect()}
    assert got == {0: 0.5, 5: 4.0, 10: 7.0}


def test_empty_buckets_are_there(spark):
    stamps = [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 12)]
    out = series.resample(as_series(spark, stamps, [1.0, 2.0]), dimension(spark, stamps), 4)
    assert sorted(((r["snapshot"].hour, r["value"]) for r in out.collect())) == [(0, 1.0), (4, None), (8, None), (12, 2.0)]
    zero = series.resample(as_series(spark, stamps, [1.0, 2.0]), dimension(spark, stamps), 4, {("loads", "p_set"): "sum"})
    assert sorted(r["value"] for r in zero.collect()) == [0.0, 0.0, 1.0, 2.0]


def test_limits_are_positions_from_the_start(spark):
    kept = series.limited_snapshots(dimension(spark, hours(dt.datetime(2024, 1, 1), 100)), "01/01/2024 10:30", 5)
    assert [(r["pos"], r["snapshot"].hour) for r in kept.orderBy("pos").collect()] == [(0, 11), (1, 12), (2, 13), (3, 14), (4, 15)]


def test_total_hours_without_weightings(spark):
    snapshots = dimension(spark, [dt.datetime(2024, 1, 1, h) for h in (0, 3, 6)]).withColumn("weighting", F.lit(None).cast("double"))
    assert series.total_hours(snapshots).first()[0] == 9.0
    assert series.total_hours(snapshots.where("pos = 0")).first()[0] == 1.0


@pytest.mark.parametrize("text, expected", [("13/02/2024 5:30", (2024, 2, 13, 5)), ("2024-02-13", (2024, 2, 13, 0)), ("2024-02-13T05:00:00", (2024, 2, 13, 5)), ("x", None)])
def test_dayfirst(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(temporal.parse_dayfirst(F.col("t"))).first()[0]
    assert (got and (got.year, got.month, got.day, got.hour)) == expected


FACT = "snapshot timestamp_ntz, components string, attribute string, carrier string, region string, aggregation string, status boolean, value double"


def test_later_level_replaces_the_whole_attribute(spark):
    month = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(month, "generators", "cost", "c", "KR", "national", True, 1.0), (month, "generators", "cost", "c", "A", "province", True, 2.0), (month, "generators", "cost", "c", "B", "province", False, 9.0)],
        FACT,
    )
    items = spark.createDataFrame([("generators", "g1", "c", "A"), ("generators", "g2", "c", "B"), ("generators", "g3", "c", None)], "component string, name string, carrier string, province string")
    shots = spark.createDataFrame([(s,) for s in hours(month, 2)], "snapshot timestamp_ntz")
    out, _ = facts.apply_facts(None, rows, items, shots, "KR", monthly=True)
    assert {(r["name"], r["value"]) for r in out.collect()} == {("g1", 2.0)}
    merged, _ = facts.apply_facts(None, rows, items, shots, "KR", monthly=True, mode="merge")
    assert {(r["name"], r["value"]) for r in merged.collect()} == {("g1", 2.0), ("g2", 1.0), ("g3", 1.0)}


def test_leading_gap_stays_open_and_repeats_are_set_aside(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 2, 1), "generators", "cost", "c", "KR", "national", True, 5.0)]
        + [(dt.datetime(2024, 2, 3), "generators", "cost", "d", "KR", "national", True, v) for v in (1.0, 2.0)],
        FACT,
    )
    items = spark.createDataFrame([("generators", "g", "c", "A"), ("generators", "h", "d", "A")], "component string, name string, carrier string, province string")
    shots = spark.createDataFrame([(dt.datetime(2024, m, 1),) for m in (1, 2, 3)], "snapshot timestamp_ntz")
    out, rejects = facts.apply_facts(None, rows, items, shots, "KR", monthly=True)
    assert sorted((r["name"], r["snapshot"].month, r["value"]) for r in out.collect() if r["name"] == "g") == [("g", 1, None), ("g", 2, 5.0), ("g", 3, 5.0)]
    assert [(r["carrier"], r["n"]) for r in rejects.collect()] == [("d", 2)]


def test_facts_without_a_name_column_never_match_by_name(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), "generators", "cost", "c", "A", "generator", 1.0)], "snapshot timestamp_ntz, component string, attribute string, carrier string, region string, aggregation string, value double")
    items = spark.createDataFrame([("generators", "g1", "c", "A")], "component string, name string, carrier string, province string")
    assert facts.matched(rows, items, "KR").count() == 0


def test_lines_without_weights_use_plain_means(spark):
    lines = spark.createDataFrame(
        [("l1", "a", "b", 154.0, 0.0, 10.0, 1.0, 2.0, 0.0, 5.0, None, 0), ("l2", "a", "b", 154.0, 0.0, 20.0, 3.0, 4.0, 0.0, 7.0, "t", 1), ("l3", "a", "a", 154.0, 1.0, 20.0, 3.0, 4.0, 0.0, 7.0, "t", 2)],
        "name string, bus0 string, bus1 string, v_nom double, num_parallel double, s_nom double, r double, x double, b double, length double, type string, _row_id bigint",
    )
    regions = spark.createDataFrame([("a", "A"), ("b", "B")], "bus string, region string")
    row = topology.aggregate_lines(lines, regions).collect()
    assert len(row) == 1
    assert (row[0]["name"], row[0]["r"], row[0]["x"], row[0]["s_nom"], row[0]["type"]) == ("line_A_B_0", 2.0, 3.0, 10.0, None)
    links = lines.withColumnRenamed("num_parallel", "p_nom")
    link = topology.aggregate_links(links.drop("s_nom", "r", "x", "b"), regions, {"grouping": "by_voltage"}).first()
    assert link["p_nom"] == 1e6


def test_loads_keep_the_total_up_to_what_has_no_bus(spark):
    stamps = hours(dt.datetime(2024, 1, 1), 4)
    pattern = as_series(spark, stamps, [10.0, 20.0, 30.0, 40.0], name="old")
    buses = spark.createDataFrame([("A",), ("B",)], "name string")
    demand = spark.createDataFrame([("A", 50.0), ("B", 30.0), ("C", 20.0), ("합계", 100.0)], "province string, demand double")
    old = spark.createDataFrame([("old", "gone", 1.0)], "name string, bus string, p_set double")
    out, ts = loads.regional_loads(old, pattern, buses, demand, "province")
    lost = loads.unallocated_share(demand, buses, "province").first()[0]
    total = ts.agg(F.sum("value")).first()[0]
    assert lost == pytest.approx(0.2) and total == pytest.approx(100.0 * (1 - lost))
    assert {r["name"] for r in out.collect()} == {"load_A", "load_B"}
    flat, _ = loads.regional_loads(old, None, buses, None, "province")
    assert {r["p_set"] for r in flat.collect()} == {1000.0}


def test_group_series_is_missing_when_a_member_is(spark):
    stamps = hours(dt.datetime(2024, 1, 1), 2)
    rows = as_series(spark, stamps, [1.0, 2.0], name="a").union(as_series(spark, stamps[:1], [5.0], name="b"))
    units = spark.createDataFrame([("a", "r1", 1.0), ("b", "r2", None), ("c", "far", 9.0)], "name string, bus string, p_set double")
    groups = spark.createDataFrame([("G",), ("E",)], "name string")
    pairs = spark.createDataFrame([("r1", "G"), ("r2", "G")], "bus string, region string")
    out, ts = loads.group_loads(units, rows, groups, pairs)
    assert {(r["name"], r["p_set"]) for r in out.collect()} == {("load_G", 1.0), ("load_E", 0.0)}
    assert sorted((r["snapshot"].hour, r["value"]) for r in ts.collect()) == [(0, 6.0), (1, None)]


def test_lifecycle_edges(spark, as_rows):
    df = spark.createDataFrame([("old", 2000, None), ("open", None, None), ("closing", 2000, 2030), ("late", 2031, None), ("kept", 2030, 2031)], "name string, build_year int, close_year int")
    assert as_rows(columns.lifecycle(df, 2030), "name") == [("kept",), ("old",)]


def test_cc_tags(spark):
    data = [("서인천 #5~8 GT_1", "CC"), ("서인천 #5-8 GT 1", "복합"), ("광양#1 ST", "CC"), ("광양#1 ST", "ST"), ("plain", "CC"), (None, "CC")]
    out = columns.tag_cc_group(spark.createDataFrame(data, "name string, type string")).collect()
    assert [r["cc_group"] for r in out] == ["서인천 #5~8", "서인천 #5-8", "광양#1", None, None, None]


def test_mainland_rows_become_sixteen(spark):
    df = spark.createDataFrame([(" 육지 ", 1), ("제주", 2)], "region string, v int")
    out = quality.expand_mainland(df, quality.parse_mainland_labels())
    assert out.count() == 17 and out.where("region = '제주'").count() == 1


def test_filters_need_an_equals_sign():
    with pytest.raises(ValueError):
        columns.parse_filters(["carrier"])


def placed_facts(spark):
    """Facts by name and by place that several items share, some of them twice, without a name or an attribute."""
    facts_of = [
        (dt.datetime(2024, m, 1), "generators", a, "c", place, "generator", name, float(m * 10 + i))
        for m in (1, 2) for i, (a, place, name) in enumerate([("cost", "A", "g0"), ("cost", "A", None), ("cost", "A", "x"), ("cost", "B", "g9"), (None, "A", "g1"), ("cost", "A", "x")])
    ]
    facts_of += facts_of[:3]
    columns = "snapshot timestamp_ntz, component string, attribute string, carrier string, region string, aggregation string, name string, value double"
    items = [("generators", f"g{i}", "c", "AB"[i % 3 // 2] if i % 4 else None) for i in range(12)] + [("generators", "g0", "c", "A")]
    return spark.createDataFrame(facts_of, columns), spark.createDataFrame(items, "component string, name string, carrier string, province string")


def fold():
    return {"n": F.count(F.lit(1)), "low": F.min("value"), "high": F.max("value")}


def combined():
    return [F.sum("n"), F.min("low"), F.max("high")]


@pytest.mark.parametrize("mode", ["merge", "replace"])
def test_folded_matches_are_the_aggregates_of_all_matches(spark, as_rows, mode):
    rows, items = placed_facts(spark)
    keys = ["component", "attribute", "name", "snapshot", "aggregation"]
    plain = facts.matched(rows, items, "KR", mode)
    folded = facts.matched(rows, items, "KR", mode, fold=fold())
    assert as_rows(folded.groupBy(*keys).agg(*combined())) == as_rows(plain.groupBy(*keys).agg(*fold().values()))
    assert folded.count() == folded.select(*keys).distinct().count() < plain.count()


def test_folded_generator_facts_are_the_aggregates_of_all_matches(spark, as_rows):
    rows, items = placed_facts(spark)
    plain, folded = facts.match_generator(rows, items), facts.match_generator(rows, items, fold())
    named = {r["name"] for r in rows.where("attribute IS NOT NULL").collect()}
    by_name = plain.where("attribute IS NOT NULL").select("name", "value").distinct().collect()
    assert {r.value % 10 for r in by_name if r["name"] in named} == {0.0, 3.0}  # g0 and g9 have facts of their own
    keys = ["component", "attribute", "carrier", "name", "snapshot"]
    assert as_rows(folded.groupBy(*keys).agg(*combined())) == as_rows(plain.groupBy(*keys).agg(*fold().values()))
    # An item (g0 is there twice) has a row per attribute and snapshot, however many facts its place has.
    assert folded.groupBy(*keys).count().agg(F.max("count")).head()[0] == 2 < plain.groupBy(*keys).count().agg(F.max("count")).head()[0]


def test_duplicates_of_folded_facts(spark, as_rows):
    rows, items = placed_facts(spark)
    plain, folded = facts.match_generator(rows, items), facts.match_generator(rows, items, {"n": F.count(F.lit(1))})
    for period in (temporal.month_start, lambda c: F.date_trunc("year", c)):
        want = as_rows(facts.duplicate_facts(plain, ["name"], period))
        assert as_rows(facts.duplicate_facts(folded, ["name"], period, counts="n")) == want != []
