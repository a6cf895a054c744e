"""Merging units by rule: ties, missing values, names."""

import pytest

from wattloom.model import ROW_ID
from wattloom.operators import rollup

UNIT = f"name string, cc_group string, bus string, p_nom double, cost double, min_up_time double, {ROW_ID} bigint"


def units(spark, *data):
    return spark.createDataFrame(data, UNIT)


RULES = {"cc_group": "cc_group", "p_nom": "sum", "cost": "mean", "min_up_time": "largest", "others": "p_nom"}


def test_leader_is_first_on_ties(spark, as_rows):
    df = units(spark, ("b", "G", "y", 3.0, None, 2.9, 2), ("a", "G", "x", 3.0, None, 1.0, 1))
    assert as_rows(rollup.merge_cc(df, RULES), "name", "bus", "p_nom", "cost", "min_up_time") == [("G_CC", "x", 6.0, None, 2.0)]


def test_component_default_for_missing_result(spark, as_rows):
    df = units(spark, ("b", "G", "y", 3.0, None, 2.9, 2), ("a", "G", "x", 3.0, None, 1.0, 1))
    out = rollup.merge_cc(df, RULES, defaults={"cost": 7.0})
    assert as_rows(out, "cost") == [(7.0,)]


def test_singleton_group_stays(spark, as_rows):
    df = units(spark, ("a", "G", "x", 3.0, 1.0, 1.0, 1), ("b", None, "y", 2.0, 1.0, 1.0, 2))
    assert as_rows(rollup.merge_cc(df, RULES), "name") == [("a",), ("b",)]


@pytest.mark.parametrize(
    "taken, expected",
    [((), "G_CC"), (("G_CC",), "G_CC_1"), (("G_CC", "G_CC_1", "G_CC_3"), "G_CC_2"), (("G_CC_1",), "G_CC")],
)
def test_name_clash(spark, as_rows, taken, expected):
    data = [("a", "G", "x", 1.0, 1.0, 1.0, 1), ("b", "G", "x", 1.0, 1.0, 1.0, 2)]
    data += [(n, None, "x", 1.0, 1.0, 1.0, 10 + i) for i, n in enumerate(taken)]
    merged = rollup.merge_cc(units(spark, *data), RULES).where("cc_group = 'G'")
    assert as_rows(merged, "name") == [(expected,)]


def test_all_missing_sum_is_zero_and_mean_is_null(spark, as_rows):
    df = spark.createDataFrame([("a", "c", None, None, 1), ("b", "c", None, None, 2)], f"name string, carrier string, p_nom double, cost double, {ROW_ID} bigint")
    out = rollup.aggregate_by_carrier(df, {"carrier": "carrier", "p_nom": "sum", "cost": "mean"})
    assert as_rows(out, "name", "p_nom", "cost") == [("c_aggregated", 0.0, None)]


def test_null_keys_drop_out_and_constants(spark, as_rows):
    df = spark.createDataFrame(
        [("a", "c", "r", 1.0, 1), ("b", None, "r", 2.0, 2), ("d", "c", None, 4.0, 3)],
        f"name string, carrier string, province string, p_nom double, {ROW_ID} bigint",
    )
    rules = {"carrier": "carrier", "province": "X", "p_nom": "sum"}
    out = rollup.aggregate_by_carrier(df, rules, "province")
    assert as_rows(out, "name", "province", "p_nom") == [("c_r", "X", 1.0)]


def test_numeric_rule_on_text_is_an_error(spark):
    df = spark.createDataFrame([("a", "c", "t", 1.0, 1)], f"name string, carrier string, note string, p_nom double, {ROW_ID} bigint")
    with pytest.raises(TypeError):
        rollup.aggregate_by_carrier(df, {"carrier": "carrier"})


def test_name_clashes_are_found(spark, as_rows):
    df = spark.createDataFrame(
        [("1", "a", "b_c", 1.0, 1), ("2", "a_b", "c", 1.0, 2)], f"name string, carrier string, province string, p_nom double, {ROW_ID} bigint"
    )
    out = rollup.aggregate_by_carrier(df, {"carrier": "carrier", "province": "region", "p_nom": "sum"}, "province")
    assert as_rows(rollup.name_clashes(out)) == [("a_b_c", 2)]


def test_facility_rollup_validates(spark):
    df = spark.createDataFrame([("x", 1.0)], "a string, p_nom double")
    with pytest.raises(ValueError):
        rollup.facility_rollup(df, ["b"])
    with pytest.raises(ValueError):
        rollup.facility_rollup(df, ["a"], name_order=["p_nom"])
    with pytest.raises(ValueError):
        rollup.facility_rollup(df, ["a"], "q")


def test_capacity_is_preserved(spark):
    from wattloom.bindings.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    df = t["f_generators"]
    out = rollup.aggregate_by_carrier(df, {"carrier": "carrier", "p_nom": "sum", "others": "remove"}, "province")
    total = lambda d: round(d.agg({"p_nom": "sum"}).first()[0], 6)
    assert total(out) == total(df)
