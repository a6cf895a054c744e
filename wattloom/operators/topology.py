"""Buses, lines and links: remapping to one bus or to regions, and roll-up by region pair."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text
from ..model import ROW_ID, Network, scalar, total
from .columns import standardize_region

END_COLUMNS = ("bus", "bus0", "bus1")

# Fallbacks for buses and links.
DEFAULT_BUS_VOLTAGE = 345000.0
DEFAULT_COUNTRY = "KR"
DEFAULT_BUS_CARRIER = "AC"
UNLIMITED_CAPACITY = 1e6

# Documented spellings of line settings, and the ones read first.
LINE_SETTING_ALIASES = {
    "num_parallel": ("num_parallel", "circuits_rule"),
    "s_nom": ("s_nom", "s_nom_rule"),
    "impedance": ("impedance", "impedance_rule"),
    "length": ("length", "length_rule"),
}
RULE_ALIASES = {"scale_by_circuits": "scale_by_num_parallel", "weighted_by_circuits": "weighted_by_num_parallel"}


# --- remapping ----------------------------------------------------------------------------------


def point_at(df: DataFrame, target: Column) -> DataFrame:
    return df.withColumns({c: target for c in END_COLUMNS if c in df.columns})


def map_buses_single(network: Network, target: str) -> Network:
    """All components on one bus, which is the only bus left."""
    out = network.map_components(lambda n, df: df if n == "buses" else point_at(df, F.lit(target)))
    buses = network["buses"]
    kept = buses.where(F.col("name") == target)
    return out.with_components(buses=_with_buses(kept, literal_names(buses, [target])))


def literal_names(like: DataFrame, names: Sequence[str]) -> DataFrame:
    return like.sparkSession.createDataFrame([(n,) for n in names], "name string")


def _with_buses(kept: DataFrame, wanted: DataFrame) -> DataFrame:
    new = wanted.join(kept.select("name"), "name", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def distinct_regions(tables: Iterable[DataFrame], column: str) -> DataFrame:
    """Distinct region values over all tables that have the column; distinct per table before the union."""
    parts = [
        df.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
        for df in tables
        if column in df.columns
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def map_buses_region(network: Network, column: str) -> Network:
    """Each component on the bus of its region; the buses are exactly those regions."""
    others = {n: df for n, df in network.components.items() if n != "buses"}
    regions = distinct_regions(others.values(), column)
    moved = {n: point_at(df, F.col(column)) for n, df in others.items() if column in df.columns}
    kept = network["buses"].join(regions, "name", "left_semi")
    return network.with_components(**moved, buses=_with_buses(kept, regions))


def ensure_bus(buses: DataFrame, name: str = "KR", carrier: str = DEFAULT_BUS_CARRIER) -> DataFrame:
    wanted = literal_names(buses, [name]).withColumn("carrier", F.lit(carrier))
    return buses.unionByName(wanted.join(buses.select("name"), "name", "left_anti"), allowMissingColumns=True)


def bus_regions(buses: DataFrame, column: str, region_map: DataFrame | None = None) -> DataFrame:
    """(bus, region) for buses with a known region."""
    named = buses.select(F.col("name").alias("bus"), F.col(column).alias("region")).where(F.col("region").isNotNull())
    return standardize_region(named, "region", region_map)


def bus_groups(buses: DataFrame, region_map: DataFrame, group_column: str) -> DataFrame:
    """(bus, region) where the region is the group of the region the bus stands for."""
    if group_column not in region_map.columns:
        return buses.select(F.col("name").alias("bus"), F.lit(None).cast("string").alias("region")).limit(0)
    pairs = region_map.select(
        text.strip(F.col("short")).alias("bus"), text.strip(F.col(group_column)).alias("region")
    ).where(F.col("bus").isNotNull() & F.col("region").isNotNull())
    return buses.select(F.col("name").alias("bus")).join(pairs.distinct(), "bus")


def tag_group(df: DataFrame, groups: DataFrame, bus_column: str = "bus") -> DataFrame:
    """Add `group` from the bus."""
    pairs = groups.select(F.col("bus").alias("_bus"), F.col("region").alias("group"))
    return df.drop("group").join(pairs, F.col(bus_column) == F.col("_bus"), "left").drop("_bus")


def map_units_to_region(
    units: DataFrame, buses: DataFrame, column: str, region_map: DataFrame | None = None
) -> DataFrame:
    """Put a unit on the bus of its region if there is one, else leave it."""
    if column not in units.columns:
        return units
    named = standardize_region(units.withColumn("_region", F.col(column)), "_region", region_map)
    known = buses.select(F.col("name").alias("_bus"))
    return (
        named.join(known, F.col("_region") == F.col("_bus"), "left")
        .withColumn("bus", F.coalesce("_bus", "bus"))
        .select(*units.columns)
    )


def unit_mapping_counts(units: DataFrame, buses: DataFrame, column: str, region_map: DataFrame | None = None) -> DataFrame:
    """One row: units that found a regional bus and units that did not. Counts per region before joining."""
    counts = units.groupBy(F.col(column).alias("_region")).agg(F.count(F.lit(1)).alias("_n"))
    named = standardize_region(counts, "_region", region_map)
    known = buses.select(F.col("name").alias("_bus"))
    joined = named.join(known, F.col("_region") == F.col("_bus"), "left")
    hit = F.col("_bus").isNotNull()
    return joined.agg(
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).cast("bigint").alias("mapped"),
        F.coalesce(F.sum(F.when(~hit, F.col("_n"))), F.lit(0)).cast("bigint").alias("unmapped"),
    )


# --- roll-up ------------------------------------------------------------------------------------


def aggregate_buses(buses: DataFrame, regions: DataFrame) -> DataFrame:
    """One bus per region: mean position, highest voltage; carrier and country of the first bus of the table."""
    voltage = F.max("v_nom") if "v_nom" in buses.columns else F.lit(DEFAULT_BUS_VOLTAGE)

    def of_first(column: str, fallback: str) -> Column:
        if column not in buses.columns:
            return F.lit(fallback)
        # Struct order starts with the row id, so this is the first row's value, null or not.
        return scalar(buses, F.min(F.struct(F.col(ROW_ID), F.col(column).alias("v")))["v"])

    return (
        buses.join(regions, F.col("name") == F.col("bus"))
        .groupBy("region")
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), voltage.alias("v_nom"), F.min(ROW_ID).alias(ROW_ID))
        .select(
            F.col("region").alias("name"),
            "x",
            "y",
            "v_nom",
            of_first("carrier", DEFAULT_BUS_CARRIER).alias("carrier"),
            of_first("country", DEFAULT_COUNTRY).alias("country"),
            F.col("region").alias("province"),
            ROW_ID,
        )
    )


def edge_regions(edges: DataFrame, regions: DataFrame, remove_self_loops: bool = True) -> DataFrame:
    """Add `region0` and `region1`; edges with an unmapped end drop out, inner ones too unless kept."""
    ends = edges
    for i in ("0", "1"):
        side = regions.select(F.col("bus").alias(f"_bus{i}"), F.col("region").alias(f"region{i}"))
        ends = ends.join(side, F.col(f"bus{i}") == F.col(f"_bus{i}")).drop(f"_bus{i}")
    return ends.where(F.col("region0") != F.col("region1")) if remove_self_loops else ends


def line_setting(config: Mapping, key: str, default: str) -> str:
    for spelling in LINE_SETTING_ALIASES[key]:
        if config.get(spelling) is not None:
            return RULE_ALIASES.get(config[spelling], config[spelling])
    return default


def first_value(column: str) -> Column:
    """The first row's value in file order, null included. With numbers on both sides this hash-aggregates."""
    return F.min_by(column, ROW_ID)


def _simple(rule: str, column: str) -> Column:
    return {"sum": total, "max": F.max, "mean": F.avg, "min": F.min}[rule](column)


def _impedances(rule: str) -> list[Column]:
    out = []
    for c in ("r", "x", "b"):
        if rule == "weighted_by_num_parallel":
            weight = total("num_parallel")
            # A missing impedance counts as nothing above the line but keeps its weight below it.
            weighted = total(F.col(c) * F.col("num_parallel")) / F.nullif(weight, F.lit(0.0))
            expr = F.when(weight > 0, weighted).otherwise(F.avg(c))
        else:
            expr = _simple(rule, c)
        out.append(expr.alias(c))
    return out


def aggregate_lines(lines: DataFrame, regions: DataFrame, config: Mapping | None = None) -> DataFrame:
    """Lines between two regions, in one direction and (by default) one voltage, become one line."""
    config = config or {}
    placed = edge_regions(lines, regions, config.get("remove_self_loops", True))
    by_voltage = config.get("grouping", "by_voltage") == "by_voltage" and "v_nom" in lines.columns
    keys = ["region0", "region1"] + (["v_nom"] if by_voltage else [])
    if by_voltage:
        placed = placed.where(F.col("v_nom").isNotNull())
    parallel_rule = line_setting(config, "num_parallel", "sum")
    parallel = _simple(parallel_rule if parallel_rule in ("sum", "max", "mean") else "sum", "num_parallel")
    capacity_rule = line_setting(config, "s_nom", "keep_original")
    if capacity_rule in ("sum", "max"):
        capacity = _simple(capacity_rule, "s_nom")
    elif capacity_rule == "scale_by_num_parallel":
        capacity = first_value("s_nom") * parallel
    else:
        capacity = first_value("s_nom")
    aggregates = [parallel.alias("num_parallel"), capacity.alias("s_nom")]
    aggregates += _impedances(line_setting(config, "impedance", "weighted_by_num_parallel"))
    if "length" in lines.columns:
        aggregates.append(_simple(line_setting(config, "length", "mean"), "length").alias("length"))
    if "type" in lines.columns:
        aggregates.append(F.nullif(first_value("type"), F.lit("")).alias("type"))
    if "terrain_factor" in lines.columns:
        aggregates.append(first_value("terrain_factor").alias("terrain_factor"))
    return _named_edges(placed.groupBy(*keys).agg(*aggregates), "line", keys, "region0", "region1")


def unplaced_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines the grouping cannot place because their voltage is unknown."""
    return edge_regions(lines, regions).where(F.col("v_nom").isNull())


def aggregate_links(links: DataFrame, regions: DataFrame, config: Mapping | None = None) -> DataFrame:
    """Links between two regions become one link; undirected ones may flow both ways."""
    config = config or {}
    placed = edge_regions(links, regions, config.get("remove_self_loops", True))
    directional = config.get("directional", True)
    if not directional:
        pair = F.least("region0", "region1"), F.greatest("region0", "region1")
        placed = placed.withColumns({"region0": pair[0], "region1": pair[1]})
    by_voltage = config.get("grouping", "ignore_voltage") == "by_voltage" and "v_nom" in links.columns
    keys = ["region0", "region1"] + (["v_nom"] if by_voltage else [])
    if by_voltage:
        placed = placed.where(F.col("v_nom").isNotNull())
    unlimited = F.lit(float(config.get("unlimited_capacity", UNLIMITED_CAPACITY)))
    rule = config.get("p_nom_rule", "sum")
    if rule == "unlimited":
        capacity = F.max(unlimited)
    else:
        raw = _simple(rule, "p_nom") if rule in ("sum", "max") else first_value("p_nom")
        capacity = F.when(raw == 0, unlimited).otherwise(raw)
    aggregates = [capacity.alias("p_nom")]
    if "length" in links.columns:
        aggregates.append(_simple(config.get("length", "mean"), "length").alias("length"))
    if "type" in links.columns:
        aggregates.append(F.nullif(first_value("type"), F.lit("")).alias("type"))
    grouped = placed.groupBy(*keys).agg(*aggregates)
    grouped = grouped.withColumn("efficiency", F.lit(float(config.get("default_efficiency", 1.0))))
    if float(config.get("marginal_cost", 0) or 0) > 0:
        grouped = grouped.withColumn("marginal_cost", F.lit(float(config["marginal_cost"])))
    if not directional:
        grouped = grouped.withColumn("p_min_pu", F.lit(-1.0))
    named = _named_edges(grouped, "link", keys, "region0", "region1")
    return named.drop("v_nom") if by_voltage else named


def _named_edges(grouped: DataFrame, prefix: str, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Name edges `<prefix>_<a>_<b>_<i>` with a running number over the sorted groups.

    The number is a rank inside the first region plus the count of all earlier regions, so no task sorts
    more than one region's edges and the one-task window has one row per region.
    """
    inside = F.row_number().over(W.partitionBy(a).orderBy(*[k for k in keys if k != a]))
    sizes = grouped.groupBy(a).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(a).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(a).alias("_a"), before.alias("_start"))
    number = F.col("_start") + F.col("_i") - 1
    return (
        grouped.withColumn("_i", inside)
        .join(starts, F.col(a) == F.col("_a"))
        .withColumn(ROW_ID, number.cast("bigint"))
        .select(
            F.concat_ws("_", F.lit(prefix), F.col(a), F.col(b), F.col(ROW_ID).cast("string")).alias("name"),
            F.col(a).alias("bus0"),
            F.col(b).alias("bus1"),
            *[c for c in grouped.columns if c not in (a, b)],
            ROW_ID,
        )
    )


def network_summary(buses: DataFrame, lines: DataFrame) -> DataFrame:
    """(section, key, n): number of buses, of lines, and of buses per voltage."""
    parts = [
        buses.agg(F.count(F.lit(1)).alias("n")).select(F.lit("buses").alias("section"), F.lit("all").alias("key"), "n"),
        lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lines").alias("section"), F.lit("all").alias("key"), "n"),
        buses.groupBy("v_nom").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("v_nom").alias("section"), F.col("v_nom").cast("bigint").cast("string").alias("key"), "n"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
