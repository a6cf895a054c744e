"""Files, settings and the three whole runs on a small network."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.model import Network
from wattloom.operators import results
from wattloom.plans import runs
from wattloom.sources import settings as st
from wattloom.sources import tables

BUSES = """name,x,y,v_nom,carrier,country,province,country
b1,127.0,37.0,345,AC,KR,가도,KR
b2,127.2,37.2,154,AC,KR,가도,KR
b3,128.0,36.0,345,AC,KR,나,KR
b4,129.0,35.0,765,AC,KR,다도,KR
"""
GENERATORS = """name,bus,carrier,province,p_nom,efficiency,build_year,close_year,cc_group,ramp_limit_up
g1,b1,lng,가도,100,0.5,2000,,G,0.1
g2,b2,lng,가도,50,0.7,2001,,G,0.2
g3,b3,sun,나,10,,2010,, ,0.3
g4,b4,sun,다도,20,0.9,2010,2022,,0.4
g5,b4,coal,다도,70,0.4,1990,,,0.5
"""
LINES = """name,bus0,bus1,v_nom,num_parallel,s_nom,r,x,b,length
l1,b1,b3,345,2,100,0.1,0.2,0,10
l2,b2,b3,345,1,50,0.4,0.8,0,20
l3,b1,b2,154,1,50,0.4,0.8,0,20
l4,b4,b3,345,1,70,0.1,0.1,0,30
"""
LINKS = "name,bus0,bus1,p_nom,efficiency,p_min_pu,length\nk1,b1,b4,0,0.9,0,5\n"
LOADS = "name,bus,p_set\nall,b1,1\n"
CARRIERS = "name\nlng\nsun\ncoal\nAC\n"


@pytest.fixture()
def folder(tmp_path):
    for name, text in {"buses": BUSES, "generators": GENERATORS, "lines": LINES, "links": LINKS, "loads": LOADS, "carriers": CARRIERS}.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8-sig")
    start = dt.datetime(2023, 2, 27)
    stamps = [start + dt.timedelta(hours=i) for i in range(72)]
    lines = [f"{s:%d/%m/%Y %H:%M},{i + 1}" for i, s in enumerate(stamps)]
    (tmp_path / "loads-p_set.csv").write_text("snapshot,all\n" + "\n".join(lines) + "\n", encoding="utf-8")
    facts = ["snapshot,carrier,components,components_t,attribute,value,status,region,aggregation"]
    facts += [f"01/{m:02d}/2023,{c},generators,generators_t,fuel_cost,{10 * m},TRUE,KR,national" for m in (2, 3) for c in ("lng", "sun", "coal")]
    facts += ["01/02/2023,lng,generators,generators_t,fuel_cost,999,FALSE,KR,national", "soon,lng,generators,generators_t,fuel_cost,1,TRUE,KR,national"]
    (tmp_path / "monthly").mkdir()
    (tmp_path / "monthly" / "facts.csv").write_text("\n".join(facts) + "\n", encoding="utf-8")
    hourly = ["snapshot,carrier,components,components_t,attribute,value,status,region,aggregation"]
    hourly += [f"{s:%d/%m/%Y %H:%M},sun,generators,generators_t,p_max_pu,0.5,TRUE,KR,national" for s in stamps]
    (tmp_path / "monthly" / "hourly.csv").write_text("\n".join(hourly) + "\n", encoding="utf-8")
    return tmp_path


def configured(spark):
    regions = spark.createDataFrame([("가", "가도", "west", "main"), ("나", "나도", "west", "main"), ("다", "다도", "east", None)], "short string, official string, group1 string, group2 string")
    return {
        "base_year": 2023,
        "target_year": 2024,
        "national_region": "KR",
        "cc_merge_rules": {"cc_group": "cc_group", "p_nom": "sum", "efficiency": "mean", "build_year": "oldest", "others": "p_nom"},
        "regional_aggregation": {"region_column": "province", "aggregate_by_carrier": True, "load_carrier": "load"},
        "generator_region_aggregator_rules": {
            "carrier": "carrier", "bus": "region", "province": "region", "group": "region", "p_nom": "sum", "ramp_limit_up": "mean", "others": "remove",
        },
        "generator_t_aggregator_rules": {"others": "mean"},
        "region_map": regions,
        "region_demand": spark.createDataFrame([("가도", 60.0), ("나", 30.0), ("다", 10.0)], "province string, demand double"),
        "carrier_mapping": spark.createDataFrame([("sun", "solar"), ("lng", "gas")], "original_carrier string, mapped_carrier string"),
        "dispatch_carriers": ["solar"],
        "generator_attributes": st.attributes_frame(spark, {"default": {"p_min_pu": 0.1, "max_cf": 0.8}, "gas": {"p_min_pu": 0.3}}),
        "resample_rules": [{"component": "generators", "attribute": "ramp_limit_up", "rule": "scale", "value": None}],
        "weights": 4,
        "snapshot_start": "28/02/2024 00:00",
        "snapshot_end": 48,
    }


def loaded(spark, folder):
    return runs.from_files(spark, str(folder), 2023, 2024, str(folder / "monthly" / "facts.csv"), str(folder / "monthly" / "hourly.csv"))


def test_group_run(spark, folder):
    network, monthly, hourly = loaded(spark, folder)
    assert "country.1" in network["buses"].columns
    assert network.rejects["monthly_file"].count() == 1
    out = runs.group(network, configured(spark), monthly, hourly)
    assert {r["name"] for r in out["buses"].collect()} == {"가", "나", "다"}
    units = {r["name"]: r for r in out["generators"].collect()}
    # The closed unit is gone, the combined-cycle pair is one, carriers carry new names (loads have one too).
    assert {(n, u["carrier"], u["bus"], u["p_nom"]) for n, u in units.items()} == {
        ("lng_가도", "gas", "가", 150.0), ("sun_나", "solar", "나", 10.0), ("coal_다도", "coal", "다", 70.0),
    }
    assert units["lng_가도"]["p_min_pu"] == 0.3 and units["coal_다도"]["p_min_pu"] == 0.1
    assert units["coal_다도"]["ramp_limit_up"] == pytest.approx(2.0)
    assert units["coal_다도"]["e_sum_max"] == pytest.approx(70 * 0.8 * 48)
    assert {r["name"] for r in out["carriers"].collect()} == {"gas", "solar", "coal", "AC", "load"}
    lines = {(r["bus0"], r["bus1"]): r for r in out["lines"].collect()}
    assert set(lines) == {("가", "나"), ("다", "나")} and lines[("가", "나")]["r"] == pytest.approx((0.1 * 2 + 0.4) / 3)
    assert [r["p_nom"] for r in out["links"].collect()] == [1e6]
    assert out.snapshots.count() == 12
    load = out.series_of("loads", "p_set").groupBy("snapshot").agg(F.sum("value").alias("v"))
    first = load.orderBy("snapshot").first()
    # 28 February 2024 starts at hour 24 of the pattern; the four hours average 26.5.
    assert (first["snapshot"], first["v"]) == (dt.datetime(2024, 2, 28), pytest.approx(26.5))
    dispatch = out.series_of("generators", "p_set").collect()
    assert {(r["name"], r["value"]) for r in dispatch} == {("sun_나", 5.0)}
    assert out.series_of("generators", "p_max_pu").count() == 0
    cost = out.series_of("generators", "marginal_cost").where("name = 'coal_다도'")
    assert {r["value"] for r in cost.collect()} == {20.0}


def test_two_level_run(spark, folder):
    network, monthly, hourly = loaded(spark, folder)
    settings = configured(spark)
    settings["regional_aggregation"] |= {"aggregate_regions_by_group": True, "region_groups": "group1"}
    out = runs.province(network, settings, monthly, hourly)
    assert {r["name"] for r in out["buses"].collect()} == {"west", "east"}
    assert {(r["name"], r["bus"]) for r in out["generators"].collect()} == {("lng_west", "west"), ("sun_west", "west"), ("coal_east", "east")}
    assert {(r["bus0"], r["bus1"]) for r in out["lines"].collect()} == {("east", "west")}
    assert {r["name"]: r["carrier"] for r in out["loads"].collect()} == {"load_west": "load", "load_east": "load"}
    total = out.series_of("loads", "p_set").groupBy("name").agg(F.sum("value").alias("v"))
    shares = {r["name"]: r["v"] for r in total.collect()}
    assert shares["load_east"] / (shares["load_east"] + shares["load_west"]) == pytest.approx(0.1)
    assert out.snapshots.count() == 48


def test_single_node_run_and_summaries(spark, folder):
    network, monthly, hourly = loaded(spark, folder)
    out = runs.single_node(network, configured(spark), monthly, hourly)
    assert "KR" in {r["name"] for r in out["buses"].collect()}
    flows = out.series.where("attribute = 'p_set' AND component = 'loads'").select(
        F.lit("lines").alias("component"), F.lit("p0").alias("attribute"), F.lit("l1").alias("name"), "snapshot", "value"
    )
    solved = out.series.unionByName(flows).withColumn("attribute", F.when(F.col("attribute") == "fuel_cost", "p").otherwise(F.col("attribute")))
    made = runs.summaries(out.with_series(solved), ["coal", "solar"])
    assert made["generation"].select("carrier").distinct().count() == 3
    assert made["lines_stats"].first()["max_flow"] == 48.0
    assert made["carrier_order"].where("carrier = 'solar'").first()["position"] == 0
    assert results.flow_totals(solved.withColumn("value", F.lit(0.0)), "lines").count() == 0


def test_network_round_trip(spark, folder, tmp_path):
    network, _, _ = loaded(spark, folder)
    tables.write_network(network, str(tmp_path / "out"))
    back = tables.read_series(spark, str(tmp_path / "out" / "series"))
    assert back.where("component = 'loads' AND attribute = 'p_set'").count() == 72
    assert spark.read.parquet(str(tmp_path / "out" / "buses")).count() == 4


def test_transcoding_falls_back_and_reports(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name\n부산\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe\xfa\xff\n")
    out = {r["path"].rsplit("/", 1)[-1]: r for r in tables.transcode_files(spark, str(tmp_path)).collect()}
    assert out["a.csv"]["ok"] and out["a.csv"]["content"] == "name\n부산\n" and out["a.csv"]["n_chars"] == 8
    assert not out["b.csv"]["ok"] and out["b.csv"]["content"] is None


def test_settings(spark, tmp_path):
    assert [st.coerce(v) for v in ("TRUE", "false", "3", "3.5", "x", None, 2)] == [True, False, 3, 3.5, "x", None, 2]
    (tmp_path / "s.yaml").write_text("modelling_setting:\n  weights: 4\n")
    assert st.read_settings(str(tmp_path / "s.yaml")) == {"modelling_setting": {"weights": 4}}
    frame = spark.createDataFrame([("a", "TRUE"), ("b", "7")], "setting string, value string")
    assert st.settings_dict(frame, ["a", "b", "c"]) == {"a": True, "b": 7}
    with pytest.raises(ValueError):
        st.directed_region_map(spark.createDataFrame([("a", "b")], "short string, official string"), "up")
    assert st.read_region_map(spark).count() == 0


def test_removed_units_take_their_series_along(spark, folder):
    network, _, _ = loaded(spark, folder)
    units = network["generators"].select(
        F.lit("generators").alias("component"), F.lit("p").alias("attribute"), "name", F.lit(dt.datetime(2023, 3, 1)).cast("timestamp_ntz").alias("snapshot"), F.lit(1.0).alias("value")
    )
    out = runs.load(Network(dict(network.components), units), {"base_year": 2023, "target_year": 2023})
    assert {r["name"] for r in out.series.collect()} == {"g1", "g2", "g3", "g5"}


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_resampling_rules_reach_the_runs(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(c, a, n, start + dt.timedelta(hours=h), float(h)) for c, a, n in (("generators", "p_max_pu", "g1"), ("generators", "p_max_pu", "g2"), ("loads", "p_set", "l1"), ("links", "p0", "k1")) for h in range(8)]
    table = spark.createDataFrame(rows, "component string, attribute string, name string, snapshot timestamp_ntz, value double")
    units = spark.createDataFrame([("g1", "sun", 0.1), ("g2", "lng", 0.1)], "name string, carrier string, ramp_limit_up double")
    network = Network({"generators": units}, table, runs.series.snapshot_dimension(table))
    rules = [
        {"component": "generators_t", "attribute": "p_max_pu", "rule": "mean"},
        {"component": "generators_t", "attribute": "p_max_pu", "rule": "max", "carrier": "sun"},
        {"component": "loads_t", "attribute": "p_set", "rule": "sum"},
        {"component": "generators", "attribute": "ramp_limit_up", "rule": "scale", "carrier": "lng"},
    ]
    out = runs.resampled(network, {"weights": 4, "resample_rules": rules})
    got = {(r.name, r.snapshot.hour): r.value for r in out.series.collect()}
    assert got == {("g1", 0): 3, ("g1", 4): 7, ("g2", 0): 1.5, ("g2", 4): 5.5, ("l1", 0): 6, ("l1", 4): 22, ("k1", 0): 1.5, ("k1", 4): 5.5}
    assert {r.name: r.ramp_limit_up for r in out["generators"].collect()} == {"g1": 0.1, "g2": 0.4}
