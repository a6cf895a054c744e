"""Named queries: filters, mappings, overlays and column updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, temporal, text
from ..model import ROW_ID, Network
from ..operators import columns, overlays, series, topology
from ..plans import extraction
from ..sources import settings
from .registry import query


@query(
    "lifecycle_filter",
    """
    SELECT name, CAST(build_year AS BIGINT) AS build_year, CAST(close_year AS BIGINT) AS close_year FROM f_generators
    WHERE build_year <= 1998 AND (close_year > 1998 OR close_year IS NULL)
    """,
    "f_generators",
)
def _lifecycle_filter(t):
    return columns.lifecycle(t["f_generators"].select("name", "build_year", "close_year"), 1998)


@query(
    "lifecycle_series",
    """
    , dated AS (SELECT *, 1995 + row_id % 10 AS build_year FROM f_items)
    SELECT attribute, count(*) AS n, round(sum(value), 2) AS total FROM f_network_series
    WHERE component <> 'generators' OR name IN (SELECT name FROM dated WHERE build_year <= 1999)
    GROUP BY attribute
    """,
    "f_items f_network_series",
    digits=2,
)
def _lifecycle_series(t):
    units = t["f_items"].withColumn("build_year", 1995 + F.col(ROW_ID) % 10)
    net = columns.lifecycle_network(Network({"generators": units}, t["f_network_series"]), 2024, 1999)
    return net.series.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "blank_to_null",
    """
    SELECT row_id, CASE WHEN g NOT IN ('', ' ') THEN g END AS cc_group
    FROM (SELECT row_id, CASE row_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN '  ' ELSE name END AS g FROM f_names)
    """,
    "f_names",
)
def _blank_to_null(t):
    n = F.col(ROW_ID) % 4
    raw = F.when(n == 0, "").when(n == 1, " ").when(n == 2, "  ").otherwise(F.col("name"))
    return columns.blank_cc_group(t["f_names"].select(ROW_ID, raw.alias("cc_group")))


@query("active_only", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def _active_only(t):
    status = F.when(F.col("o_orderstatus") == "F", "TRUE").when(
        F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("False")
    )
    return columns.active_only(t["orders"].select("o_orderkey", status.alias("status"))).drop("status")


@query(
    "in_list_filters",
    "SELECT name FROM f_generators WHERE market IN ('A', 'N') AND carrier IN ('SMALL', 'PROMO')",
    "f_generators",
)
def _in_list_filters(t):
    filters = columns.parse_filters(["market=A,N", "carrier=SMALL, PROMO", "no_such=1"])
    return columns.in_lists(t["f_generators"].select("name", "market", "carrier"), filters).select("name")


@query("drop_dup_columns", "SELECT name, country, province FROM f_buses", "f_buses")
def _drop_dup_columns(t):
    doubled = t["f_buses"].select("name", "country", "province", F.col("country").alias("country.1"))
    return columns.drop_repeated_columns(doubled)


@query(
    "map_carriers",
    "SELECT name, coalesce(mapped_carrier, carrier) AS carrier FROM f_generators LEFT JOIN f_carrier_map ON carrier = original_carrier",
    "f_generators f_carrier_map",
)
def _map_carriers(t):
    return columns.map_carriers(t["f_generators"].select("name", "carrier"), t["f_carrier_map"])


@query(
    "carrier_changes",
    """
    SELECT original_carrier, mapped_carrier, count(*) AS n FROM f_generators JOIN f_carrier_map ON carrier = original_carrier
    WHERE original_carrier <> mapped_carrier GROUP BY 1, 2
    """,
    "f_generators f_carrier_map",
)
def _carrier_changes(t):
    return columns.carrier_changes(t["f_generators"], t["f_carrier_map"])


def _carriers(t):
    return t["part"].select(F.col("p_type").alias("name")).distinct().unionByName(
        t["region"].select(F.col("r_name").alias("name"))
    )


_CARRIERS = "carriers AS (SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT r_name FROM region)"
_USED = """used AS (SELECT DISTINCT coalesce(mapped_carrier, carrier) AS name
                    FROM f_generators LEFT JOIN f_carrier_map ON carrier = original_carrier)"""


@query(
    "sync_carriers",
    f"""
    , {_CARRIERS}, {_USED}
    SELECT name FROM carriers WHERE name IN (SELECT name FROM used) OR name NOT IN (SELECT original_carrier FROM f_carrier_map)
    UNION ALL SELECT name FROM used WHERE name NOT IN (SELECT name FROM carriers)
    """,
    "f_generators f_carrier_map",
)
def _sync_carriers(t):
    net = Network({"generators": t["f_generators"].select("name", "carrier"), "carriers": _carriers(t)})
    return columns.standardize_carriers(net, t["f_carrier_map"])["carriers"]


@query(
    "carrier_set_diff",
    f"""
    , {_CARRIERS}, {_USED}
    SELECT name, 'add' AS change FROM used WHERE name NOT IN (SELECT name FROM carriers)
    UNION ALL SELECT name, 'remove' FROM carriers
    WHERE name NOT IN (SELECT name FROM used) AND name IN (SELECT original_carrier FROM f_carrier_map)
    """,
    "f_generators f_carrier_map",
)
def _carrier_set_diff(t):
    used = columns.carriers_in_use([columns.map_carriers(t["f_generators"], t["f_carrier_map"])])
    return columns.carrier_differences(_carriers(t), used, t["f_carrier_map"])


_OVERLAY = """
    , own AS (SELECT * FROM f_carrier_attrs WHERE carrier <> 'default'),
    d AS (SELECT * FROM f_carrier_attrs WHERE carrier = 'default')
    SELECT g.name, g.carrier, g.{column}, round(coalesce(o.p_min_pu, (SELECT p_min_pu FROM d)), 4) AS p_min_pu,
           round(coalesce(o.ramp_limit_up, (SELECT ramp_limit_up FROM d)), 4) AS ramp_limit_up,
           {whole} AS min_up_time,
           round(coalesce(o.max_cf, (SELECT max_cf FROM d)), 4) AS max_cf,
           round(coalesce(o.min_cf, (SELECT min_cf FROM d)), 4) AS min_cf
    FROM f_generators g LEFT JOIN own o ON g.carrier = o.carrier
"""


@query(
    "overlay_generator_attrs",
    _OVERLAY.format(column="bus", whole="CAST(trunc(coalesce(o.min_up_time, (SELECT min_up_time FROM d))) AS BIGINT)"),
    "f_generators f_carrier_attrs",
)
def _overlay_generator_attrs(t):
    net = Network({"generators": t["f_generators"].select("name", "carrier", "bus")})
    return overlays.overlay_generator_attrs(net, t["f_carrier_attrs"])["generators"]


@query(
    "overlay_storage_attrs",
    _OVERLAY.format(column="control", whole="round(coalesce(o.min_up_time, (SELECT min_up_time FROM d)), 4)"),
    "f_generators f_carrier_attrs",
)
def _overlay_storage_attrs(t):
    net = Network({"storage_units": t["f_generators"].select("name", "carrier", "control")})
    return overlays.overlay_storage_attrs(net, t["f_carrier_attrs"])["storage_units"]


@query(
    "alias_series",
    """
    SELECT component, attribute, name, snapshot, round(value, 9) AS value FROM f_network_series
    UNION ALL
    SELECT component, 'marginal_cost', name, snapshot, round(value, 9) FROM f_network_series
    WHERE component = 'generators' AND attribute = 'fuel_cost'
    """,
    "f_network_series",
    digits=9,
)
def _alias_series(t):
    return series.alias_series(t["f_network_series"])


@query(
    "standardize_region",
    """
    SELECT name, coalesce(short, province) AS province FROM f_generators LEFT JOIN f_region_map ON province = official
    """,
    "f_generators f_region_map",
)
def _standardize_region(t):
    padded = t["f_generators"].select("name", F.concat(F.lit("  "), "province", F.lit("\t")).alias("province"))
    return columns.standardize_region(padded, "province", settings.region_map(t["f_region_map"]))


def _mappable(t) -> Network:
    return Network(
        {
            "buses": t["f_buses"].select("name", "x", "y"),
            "generators": t["f_generators"].select("name", "bus", "province"),
            "lines": t["f_lines"].select("name", "bus0", "bus1"),
        }
    )


@query(
    "map_buses_single",
    """
    SELECT 'generators' AS component, name, 'b1' AS bus, NULL AS bus0, NULL AS bus1 FROM f_generators
    UNION ALL SELECT 'lines', name, NULL, 'b1', 'b1' FROM f_lines
    UNION ALL SELECT 'buses', name, NULL, NULL, NULL FROM f_buses WHERE name = 'b1'
    """,
    "f_generators f_lines f_buses",
)
def _map_buses_single(t):
    return _flattened(topology.map_buses_single(_mappable(t), "b1"))


def _flattened(net: Network):
    out = None
    for name in ("generators", "lines", "buses"):
        df = net[name]
        row = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("bus", "bus0", "bus1")]
        part = df.select(F.lit(name).alias("component"), "name", *row)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "map_buses_region",
    """
    SELECT 'generators' AS component, name, province AS bus, NULL AS bus0, NULL AS bus1 FROM f_generators
    UNION ALL SELECT 'lines', name, NULL, bus0, bus1 FROM f_lines
    UNION ALL SELECT DISTINCT 'buses', province, NULL, NULL, NULL FROM f_generators
    """,
    "f_generators f_lines",
)
def _map_buses_region(t):
    return _flattened(topology.map_buses_region(_mappable(t), "province"))


@query(
    "distinct_union",
    "SELECT province AS name FROM f_generators UNION SELECT province FROM f_buses",
    "f_generators f_buses",
)
def _distinct_union(t):
    return topology.distinct_regions([t["f_generators"], t["f_lines"], t["f_buses"]], "province")


@query("ensure_bus", "SELECT name, carrier FROM f_buses UNION ALL SELECT 'KR', 'AC'", "f_buses")
def _ensure_bus(t):
    once = topology.ensure_bus(t["f_buses"].select("name", "carrier"))
    return topology.ensure_bus(once)


@query(
    "map_generators_to_region",
    """
    SELECT g.name, coalesce(b.name, g.bus) AS bus FROM f_generators g
    LEFT JOIN f_region_map m ON g.province = m.official
    LEFT JOIN (SELECT short AS name FROM f_region_map WHERE group2 IS NOT NULL) b ON coalesce(m.short, g.province) = b.name
    """,
    "f_generators f_region_map",
)
def _map_generators_to_region(t):
    buses = t["f_region_map"].where("group2 IS NOT NULL").select(F.col("short").alias("name"))
    units = t["f_generators"].select("name", "bus", "province")
    return topology.map_units_to_region(units, buses, "province", settings.region_map(t["f_region_map"])).drop("province")


@query(
    "unit_mapping_counts",
    """
    , placed AS (SELECT m.short FROM f_generators g LEFT JOIN f_region_map m ON g.province = m.official AND group2 IS NOT NULL)
    SELECT count(short) AS mapped, count(*) - count(short) AS unmapped FROM placed
    """,
    "f_generators f_region_map",
)
def _unit_mapping_counts(t):
    buses = t["f_region_map"].where("group2 IS NOT NULL").select(F.col("short").alias("name"))
    return topology.unit_mapping_counts(t["f_generators"], buses, "province", settings.region_map(t["f_region_map"]))


@query(
    "cf_energy_limits",
    """
    , own AS (SELECT * FROM f_carrier_attrs WHERE carrier <> 'default'),
    d AS (SELECT * FROM f_carrier_attrs WHERE carrier = 'default'),
    h AS (SELECT CAST(count(*) AS DOUBLE) AS hours FROM f_snapshots)
    SELECT g.name, round(p_nom * coalesce(max_cf, (SELECT max_cf FROM d)) * (SELECT hours FROM h), 2) AS e_sum_max,
           round(p_nom * coalesce(min_cf, (SELECT min_cf FROM d)) * (SELECT hours FROM h), 2) AS e_sum_min
    FROM f_generators g LEFT JOIN own o ON g.carrier = o.carrier
    """,
    "f_generators f_carrier_attrs f_snapshots",
    digits=2,
)
def _cf_energy_limits(t):
    hours = series.total_hours(series.snapshot_dimension(t["f_snapshots"])).scalar()
    units = t["f_generators"].select("name", "carrier", "p_nom")
    return columns.cf_energy_limits(units, t["f_carrier_attrs"], hours).select("name", "e_sum_max", "e_sum_min")


@query(
    "resolve_cf",
    """
    SELECT carrier, coalesce(max_cf, 0.5) AS max_cf, CASE WHEN max_cf IS NULL THEN 'default' ELSE 'carrier' END AS source
    FROM f_carrier_attrs WHERE carrier <> 'default'
    """,
    "f_carrier_attrs",
)
def _resolve_cf(t):
    attrs = t["f_carrier_attrs"]
    fallback = attrs.where("carrier = 'default'").agg(F.max("max_cf")).scalar()
    return attrs.where("carrier <> 'default'").select(
        "carrier", F.coalesce("max_cf", fallback).alias("max_cf"),
        F.when(F.col("max_cf").isNull(), "default").otherwise("carrier").alias("source"),
    )


_CHOSEN = "(SELECT name, carrier, p_nom FROM f_items WHERE carrier IN ('c1', 'c3'))"


@query(
    "fixed_dispatch",
    f"""
    SELECT component, attribute, name, snapshot, round(value, 6) AS value FROM f_network_series
    WHERE NOT (component = 'generators' AND attribute = 'p_max_pu' AND name IN (SELECT name FROM {_CHOSEN}))
    UNION ALL
    SELECT component, 'p_set', name, snapshot, round(p_nom * value, 6) FROM f_network_series JOIN {_CHOSEN} USING (name)
    WHERE component = 'generators' AND attribute = 'p_max_pu'
    """,
    "f_network_series f_items",
    digits=6,
)
def _fixed_dispatch(t):
    return series.fixed_dispatch(t["f_network_series"], t["f_items"], ["c1", "c3"])


@query(
    "dispatch_summary",
    f"""
    , d AS (SELECT name, p_nom * value AS v FROM f_network_series JOIN {_CHOSEN} USING (name)
            WHERE component = 'generators' AND attribute = 'p_max_pu')
    SELECT round(avg(m), 6) AS mean_dispatch, round(max(x), 6) AS max_dispatch, round(min(n), 6) AS min_dispatch
    FROM (SELECT name, avg(v) AS m, max(v) AS x, min(v) AS n FROM d GROUP BY name)
    """,
    "f_network_series f_items",
    digits=6,
)
def _dispatch_summary(t):
    return series.dispatch_summary(t["f_network_series"], t["f_items"], ["c1", "c3"])


@query(
    "dispatch_by_carrier",
    f"SELECT carrier, count(*) AS generators, round(sum(p_nom), 4) AS capacity FROM {_CHOSEN} GROUP BY carrier",
    "f_items",
)
def _dispatch_by_carrier(t):
    return series.dispatch_by_carrier(t["f_network_series"], t["f_items"], ["c1", "c3"])


@query(
    "clear_dispatch",
    """
    SELECT component, attribute, name, snapshot, round(value, 9) AS value FROM f_network_series
    WHERE NOT (component = 'generators' AND attribute = 'p')
    """,
    "f_network_series",
    digits=9,
)
def _clear_dispatch(t):
    mine = (F.col("component") == "generators") & (F.col("attribute") == "p")
    renamed = t["f_network_series"].withColumn("attribute", F.when(mine, "p_set").otherwise(F.col("attribute")))
    return series.clear_dispatch(renamed)


@query(
    "scale_load",
    """
    , l AS (SELECT * FROM f_network_series WHERE component = 'loads' AND attribute = 'p_set')
    SELECT component, attribute, name, snapshot, round(value * (1000000.0 / (SELECT sum(value) FROM l)), 4) AS value FROM l
    """,
    "f_network_series",
)
def _scale_load(t):
    scaled = columns.scale_load(t["f_network_series"], 1_000_000.0)
    return scaled.where("component = 'loads' AND attribute = 'p_set'")


_RULES = [
    {"component": "generators", "attribute": "p_nom", "rule": "scale", "value": None},
    {"component": "generators", "attribute": "efficiency", "rule": "fixed", "value": 0.77},
    {"component": "generators", "attribute": "marginal_cost", "rule": "default", "value": None},
    {"component": "generators", "attribute": "capital_cost", "rule": "skip", "value": None},
    {"component": "generators", "attribute": "build_year", "rule": "fixed", "value": None},
    {"component": "generators_t", "attribute": "p_nom", "rule": "mean", "value": None},
    {"component": "generators", "attribute": "no_such", "rule": "scale", "value": None},
    {"component": "links", "attribute": "p_nom", "rule": "scale", "value": None},
]


@query(
    "static_rescale",
    """
    SELECT name, round(p_nom * 4, 4) AS p_nom, CAST(0.77 AS DOUBLE) AS efficiency, CAST(1.5 AS DOUBLE) AS marginal_cost, round(capital_cost, 2) AS capital_cost,
           CAST(build_year AS BIGINT) AS build_year
    FROM f_generators
    """,
    "f_generators",
)
def _static_rescale(t):
    units = t["f_generators"].select("name", "p_nom", "efficiency", "marginal_cost", "capital_cost", "build_year")
    return overlays.static_rescale(units, "generators", _RULES, 4, {("generators", "marginal_cost"): 1.5})


@query(
    "static_rescale_by_carrier",
    """
    SELECT name, carrier, CASE carrier WHEN 'SMALL' THEN (SELECT max(p_nom) FROM f_generators WHERE carrier = 'SMALL')
             WHEN 'LARGE' THEN 5.0 ELSE round(p_nom * 4, 4) END AS p_nom,
           round((SELECT min(efficiency) FROM f_generators), 4) AS efficiency
    FROM f_generators
    """,
    "f_generators",
)
def _static_rescale_by_carrier(t):
    rules = [
        {"component": "generators", "attribute": "p_nom", "carrier": "SMALL", "rule": "max", "value": None},
        {"component": "generators", "attribute": "p_nom", "carrier": "LARGE", "rule": "fixed", "value": 5.0},
        {"component": "generators", "attribute": "p_nom", "carrier": None, "rule": "scale", "value": None},
        {"component": "generators", "attribute": "efficiency", "carrier": None, "rule": "min", "value": None},
    ]
    units = t["f_generators"].select("name", "carrier", "p_nom", "efficiency")
    return overlays.static_rescale_by_carrier(units, "generators", rules, 4)


@query(
    "map_region_column",
    "SELECT c_custkey, coalesce(short, n_name) AS province FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f_region_map ON n_name = official",
    "f_region_map",
)
def _map_region_column(t):
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    mapping = settings.directed_region_map(t["f_region_map"], "to_short")
    return columns.map_region_column(rows.select("c_custkey", F.col("n_name").alias("province")), "province", mapping, "k", "v")


@query(
    "map_region_report",
    """
    SELECT count(short) AS changed, (SELECT count(*) FROM nation WHERE n_name NOT IN (SELECT official FROM f_region_map)) AS unmapped
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f_region_map ON n_name = official
    """,
    "f_region_map",
)
def _map_region_report(t):
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    mapping = settings.directed_region_map(t["f_region_map"], "to_short")
    return columns.map_region_report(rows, "n_name", mapping, "k", "v")


@query(
    "region_map_keys",
    "SELECT official AS k, short FROM f_region_map UNION SELECT short, short FROM f_region_map",
    "f_region_map",
)
def _region_map_keys(t):
    return settings.region_map(t["f_region_map"])


@query(
    "region_map_official",
    "SELECT official AS k, official AS v FROM f_region_map UNION SELECT short, official FROM f_region_map",
    "f_region_map",
)
def _region_map_official(t):
    return settings.directed_region_map(t["f_region_map"], "to_official")


@query(
    "derive_bus_region",
    "SELECT name AS bus, coalesce(short, province) AS region FROM f_buses LEFT JOIN f_region_map ON province = official",
    "f_buses f_region_map",
)
def _derive_bus_region(t):
    return topology.bus_regions(t["f_buses"], "province", settings.region_map(t["f_region_map"]))


@query(
    "bus_group",
    """
    SELECT g.name, m.group2 AS "group" FROM f_generators g
    LEFT JOIN f_region_map m ON g.province = m.official AND m.group2 IS NOT NULL
    """,
    "f_generators f_region_map",
)
def _bus_group(t):
    regional = t["f_region_map"].select(F.col("short").alias("name"))
    groups = topology.bus_groups(regional, t["f_region_map"], "group2")
    units = t["f_generators"].select("name", "province")
    named = columns.standardize_region(units, "province", settings.region_map(t["f_region_map"]))
    return topology.tag_group(named, groups, "province").drop("province")


@query("demand_table", """
    SELECT coalesce(short, province) AS province, round(demand, 2) AS demand FROM f_demand LEFT JOIN f_region_map ON province = official
    """, "f_demand f_region_map", digits=2)
def _demand_table(t):
    total = t["f_demand"].agg(F.lit("합계").alias("province"), F.sum("demand").alias("demand"))
    return settings.demand_table(t["f_demand"].unionByName(total), "province", settings.region_map(t["f_region_map"]))


# --- scalar functions ---------------------------------------------------------------------------


@query(
    "normalize_ws",
    r"""
    SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents
    """,
)
def _normalize_ws(t):
    return t["documents"].select("doc_id", text.normalize_ws(F.col("text")).alias("text"))


@query("strip_text", r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations")
def _strip_text(t):
    return t["conversations"].select("conv_id", "turn", text.strip(F.col("text")).alias("text"))


@query("join_key_columns", "SELECT concat_ws('___', p_type, p_brand, CAST(p_size AS VARCHAR)) AS k, count(*) AS n FROM part GROUP BY p_type, p_brand, p_size")
def _join_key_columns(t):
    counts = t["part"].groupBy("p_type", "p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(text.joined_name(["p_type", "p_brand", "p_size"], "___").alias("k"), "n")


@query("contains_gt", "SELECT page_id, contains(html, 'GT') AS found FROM pages")
def _contains_gt(t):
    return t["pages"].select("page_id", F.contains("html", F.lit("GT")).alias("found"))


@query(
    "clean_address",
    r"""
    , cut AS (SELECT row_id, trim(regexp_replace(split_part(address, '(', 1), '\s+', ' ', 'g')) AS a FROM f_addresses)
    SELECT row_id, a AS address, CAST(len(string_split(a, ' ')) AS BIGINT) AS words, replace(a, '군', '시') AS city_form FROM cut
    """,
    "f_addresses",
)
def _clean_address(t):
    parts = text.address_parts(F.col("address"))
    joined = F.array_join(parts, " ")
    return t["f_addresses"].select(
        ROW_ID, joined.alias("address"), F.when(F.col("address").isNotNull(), F.size(parts)).alias("words"),
        F.replace(joined, F.lit("군"), F.lit("시")).alias("city_form"),
    )


@query(
    "edge_label",
    "SELECT name, 'Line: ' || bus0 || ' → ' || bus1 AS label FROM f_lines",
    "f_lines",
)
def _edge_label(t):
    return t["f_lines"].select("name", text.edge_label(F.col("bus0"), F.col("bus1"), "Line: ").alias("label"))


@query(
    "voltage_number",
    r"SELECT line_id, TRY_CAST(regexp_extract(voltage, '(\d+)', 1) AS DOUBLE) AS kv FROM f_features WHERE TRY_CAST(regexp_extract(voltage, '(\d+)', 1) AS DOUBLE) >= 200",
    "f_features",
)
def _voltage_number(t):
    return t["f_features"].select("line_id", text.voltage_number(F.col("voltage")).alias("kv")).where("kv >= 200")


@query(
    "voltage_text",
    "SELECT substation_id, coalesce(TRY_CAST(trim(replace(voltage, 'kV', '')) AS DOUBLE), 220.0) AS kv FROM f_substations",
    "f_substations",
)
def _voltage_text(t):
    return t["f_substations"].select("substation_id", text.voltage_text(F.col("voltage")).alias("kv"))


_POINTS = "pts AS (SELECT line_id, CASE WHEN lonlat LIKE '[%' THEN CAST(lonlat AS DOUBLE[][]) END AS p FROM f_features)"


@query(
    "parse_polyline",
    f", {_POINTS} SELECT line_id, p[1][1] AS x0, p[1][2] AS y0, p[-1][1] AS x1, p[-1][2] AS y1, CAST(len(p) AS BIGINT) AS n FROM pts",
    "f_features",
)
def _parse_polyline(t):
    points = t["f_features"].select("line_id", geo.parse_polyline(F.col("lonlat")).alias("p"))
    start, end = geo.end_points(F.col("p"))
    return points.select(
        "line_id", start["x"].alias("x0"), start["y"].alias("y0"), end["x"].alias("x1"), end["y"].alias("y1"),
        F.when(F.col("p").isNotNull(), F.size("p")).alias("n"),
    )


@query(
    "polyline_length",
    f""", {_POINTS}
    SELECT line_id, round(coalesce(sqrt((p[2][1] - p[1][1]) ** 2 + (p[2][2] - p[1][2]) ** 2) * 111.0, 0.0), 4) AS km FROM pts
    """,
    "f_features",
)
def _polyline_length(t):
    return t["f_features"].select("line_id", geo.polyline_length_km(geo.parse_polyline(F.col("lonlat"))).alias("km"))


@query(
    "impedance_per_km",
    """
    SELECT name, CAST(CASE WHEN v_nom >= 380 THEN 0.05 WHEN v_nom >= 220 THEN 0.1 ELSE 0.2 END AS DOUBLE) AS r,
           CAST(CASE WHEN v_nom >= 380 THEN 0.25 WHEN v_nom >= 220 THEN 0.3 ELSE 0.35 END AS DOUBLE) AS x FROM f_lines
    """,
    "f_lines",
)
def _impedance_per_km(t):
    return t["f_lines"].select(
        "name", geo.resistance_per_km(F.col("v_nom")).alias("r"), geo.reactance_per_km(F.col("v_nom")).alias("x")
    )


@query(
    "line_impedance",
    """
    SELECT name, round(CASE WHEN v_nom >= 380 THEN 0.05 WHEN v_nom >= 220 THEN 0.1 ELSE 0.2 END * (length / num_parallel), 6) AS r,
           round(CASE WHEN v_nom >= 380 THEN 0.25 WHEN v_nom >= 220 THEN 0.3 ELSE 0.35 END * (length / num_parallel), 6) AS x,
           CAST(0 AS DOUBLE) AS b FROM f_lines
    """,
    "f_lines",
    digits=6,
)
def _line_impedance(t):
    lines = t["f_lines"].select("name", F.col("v_nom").alias("voltage"), "length", F.col("num_parallel").alias("circuits"))
    return extraction.line_impedance(lines).select("name", "r", "x", "b")


@query("clip_negative", "SELECT name, snapshot, round(greatest(value - 50, 0), 4) AS up, round(least(value - 50, 0), 4) AS down FROM f_series", "f_series")
def _clip_negative(t):
    v = F.col("value") - 50
    return t["f_series"].select("name", "snapshot", F.greatest(v, F.lit(0.0)).alias("up"), F.least(v, F.lit(0.0)).alias("down"))


@query(
    "date_parts",
    """
    SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d,
           CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start FROM events
    """,
)
def _date_parts(t):
    ts = F.col("ts").cast("timestamp_ntz")
    return t["events"].select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("d"),
        temporal.month_start(ts).alias("month_start"),
    )


@query("whole_hours", "SELECT name, CAST(trunc(efficiency * 10) AS BIGINT) AS min_up_time FROM f_generators", "f_generators")
def _whole_hours(t):
    return t["f_generators"].select("name", (F.col("efficiency") * 10).cast("bigint").alias("min_up_time"))
