"""The three runs: one national bus, regions, and regions rolled up to groups.

Each returns a lazy `Network` ready for an optimiser; `summaries` turns its solved series into tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import SERIES_COLUMNS, Network
from ..operators import columns, facts, loads, overlays, results, rollup, series, topology
from ..session import checkpointed
from ..sources import settings as st
from ..sources import tables


def load(network: Network, settings: Mapping) -> Network:
    """Clean, filter by life time, move to the target year, scale the load."""
    base = settings.get("base_year")
    target = settings.get("target_year")
    tidy = {"generators": columns.blank_cc_group, "buses": columns.drop_repeated_columns}
    out = network.map_components(lambda n, df: tidy.get(n, lambda d: d)(df))
    out = columns.lifecycle_network(out, base, target)
    out = series.shift_network(out, base, target)
    if settings.get("target_load") and out.series is not None:
        out = out.with_series(columns.scale_load(out.series, float(settings["target_load"])))
    return out


def items_of(network: Network) -> DataFrame:
    """(component, name, carrier, province) of everything a fact may match."""
    parts = []
    for name, df in network.components.items():
        if "carrier" in df.columns and name not in ("buses", "carriers"):
            province = F.col("province") if "province" in df.columns else F.lit(None).cast("string")
            parts.append(df.select(F.lit(name).alias("component"), "name", "carrier", province.alias("province")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_facts(network: Network, rows: DataFrame | None, national_region: str, monthly: bool) -> Network:
    if rows is None:
        return network
    new, rejects = facts.apply_facts(
        network.series, rows, items_of(network), network.snapshots, national_region, monthly
    )
    return network.with_series(new).with_rejects(**{"monthly" if monthly else "hourly": rejects})


def common(network: Network, settings: Mapping, monthly: DataFrame | None, hourly: DataFrame | None) -> Network:
    """Everything before the roll-up: load, merge combined-cycle units, facts, cost alias."""
    out = load(network, settings)
    rules = settings.get("cc_merge_rules")
    if rules:
        out = out.with_components(generators=rollup.merge_cc(out["generators"], rules, settings.get("defaults")))
    national = settings.get("national_region", topology.DEFAULT_COUNTRY)
    out = with_facts(out, monthly, national, monthly=True)
    out = with_facts(out, hourly, national, monthly=False)
    return out if out.series is None else out.with_series(series.alias_series(out.series))


def aggregate_by_region(network: Network, settings: Mapping) -> Network:
    """Buses, units, lines, links and loads to regions; optionally units by carrier, and a second level."""
    config = settings.get("regional_aggregation", {})
    if not config.get("aggregate_by_region", True):
        return network
    column = config.get("region_column", "province")
    mapping = settings.get("region_map")
    region_map = None if mapping is None else st.region_map(mapping)
    regions = topology.bus_regions(network["buses"], column, region_map)
    out = _roll_up(network, regions, column, region_map, config, settings)
    if "loads" in out:
        new_loads, new_series = loads.regional_loads(
            out["loads"], out.series, out["buses"], settings.get("region_demand"), column, region_map,
            config.get("load_carrier") or None, config.get("replace_existing", False),
        )
        out = out.with_components(loads=new_loads).with_series(new_series)
    if config.get("aggregate_regions_by_group", False):
        out = aggregate_by_group(_written(out, config), settings)
    return out


def _written(network: Network, config: Mapping) -> Network:
    """The rolled-up network written out: costly to derive, and read several times by the next level."""
    done = ["buses", "lines", "links", "loads"] + (["generators"] if config.get("aggregate_by_carrier") else [])
    out = network.with_components(**{n: checkpointed(network[n]) for n in done if n in network})
    return out if out.series is None else out.with_series(checkpointed(out.series))


def _roll_up(
    network: Network, regions: DataFrame, column: str, region_map: DataFrame | None, config: Mapping, settings: Mapping
) -> Network:
    new_buses = topology.aggregate_buses(network["buses"], regions)
    changed = {"buses": new_buses}
    for name in ("generators", *config.get("also_map", ())):
        if name in network:
            changed[name] = topology.map_units_to_region(network[name], new_buses, column, region_map)
    rejects = {}
    if "lines" in network:
        changed["lines"] = topology.aggregate_lines(network["lines"], regions, config.get("lines"))
        if "v_nom" in network["lines"].columns:
            rejects["lines"] = topology.unplaced_lines(network["lines"], regions)
    if "links" in network:
        changed["links"] = topology.aggregate_links(network["links"], regions, config.get("links"))
    out = network.with_components(**changed).with_rejects(**rejects)
    rules = settings.get("generator_region_aggregator_rules")
    if config.get("aggregate_by_carrier", False) and rules:
        units = out["generators"]
        members = rollup.membership(units, column)
        merged = rollup.aggregate_by_carrier(units, rules, column, region_map, settings.get("defaults"))
        clashes = rollup.name_clashes(merged)
        if not clashes.isEmpty():
            raise ValueError(f"different keys lead to the name {clashes.first()['name']!r}")
        out = out.with_components(generators=merged)
        if out.series is not None:
            by_attribute = settings.get("generator_t_aggregator_rules")
            out = out.with_series(rollup.aggregate_generator_series(out.series, members, by_attribute))
    return out


def aggregate_by_group(network: Network, settings: Mapping) -> Network:
    """Second level: the same steps with groups of regions, and loads added up per group."""
    config = settings.get("regional_aggregation", {})
    group_column = config.get("region_groups", "group1")
    mapping = settings.get("region_map")
    if mapping is None or group_column not in mapping.columns:
        return network
    groups = topology.bus_groups(network["buses"], mapping, group_column)
    tagged = network.with_components(
        **{n: topology.tag_group(network[n], groups) for n in ("generators", "loads") if n in network}
    )
    out = _roll_up(tagged, groups, "group", None, config, settings)
    if "loads" in out:
        new_loads, new_series = loads.group_loads(
            out["loads"], out.series, out["buses"], groups, config.get("load_carrier") or None
        )
        out = out.with_components(loads=new_loads).with_series(new_series)
    return out


def standardized(network: Network, settings: Mapping) -> Network:
    """Carrier names, fixed dispatch and attribute overlays, in this order."""
    out = columns.standardize_carriers(network, settings.get("carrier_mapping"))
    dispatch = settings.get("dispatch_carriers")
    if dispatch is not None and out.series is not None:
        out = out.with_series(series.fixed_dispatch(out.series, out["generators"], dispatch))
    out = overlays.overlay_generator_attrs(out, settings.get("generator_attributes"))
    return overlays.overlay_storage_attrs(out, settings.get("storage_unit_attributes"))


def with_energy_limits(network: Network, settings: Mapping) -> Network:
    attributes = settings.get("generator_attributes")
    if attributes is None:
        return network
    hours = series.total_hours(network.snapshots).scalar()
    limited = columns.cf_energy_limits(network["generators"], attributes, hours)
    return network.with_components(generators=limited)


def resampled(network: Network, settings: Mapping) -> Network:
    """Series to coarser snapshots, then static attributes, both by rule.

    `resample_rules` has rows (component, attribute, rule, value, carrier); components of series end in `_t`. Series
    without a rule take their mean. Rules with a carrier switch to the carrier-aware forms.
    """
    weights = int(settings.get("weights", 1) or 1)
    if weights <= 1:
        return network
    rules = settings.get("resample_rules") or ()
    out = network
    if network.series is not None:
        out = out.with_series(_resampled_series(network, rules, weights))
    out = out.with_snapshots(series.resampled_snapshots(network.snapshots, weights))
    by_carrier = any(rule.get("carrier") for rule in rules if not rule["component"].endswith("_t"))
    rescale = overlays.static_rescale_by_carrier if by_carrier else overlays.static_rescale
    return out.map_components(lambda n, df: rescale(df, n, rules, weights, settings.get("component_defaults")))


def _resampled_series(network: Network, rules: Sequence[Mapping], weights: int) -> DataFrame:
    """Units of a carrier with rules of its own are resampled apart from the others; every row is in one part."""
    of_series = [(r["component"].removesuffix("_t"), r) for r in rules if r["component"].endswith("_t")]
    common_rules = {(c, r["attribute"]): r["rule"] for c, r in of_series if not r.get("carrier")}
    special: dict[tuple[str, str], dict] = {}
    for c, r in of_series:
        if r.get("carrier") and c in network and "carrier" in network[c].columns:
            special.setdefault((c, r["carrier"]), {})[(c, r["attribute"])] = r["rule"]
    if not special:
        return series.resample(network.series, network.snapshots, weights, common_rules)
    units = reduce(
        DataFrame.unionByName,
        [
            network[c].where(F.col("carrier").isin(*[k for x, k in special if x == c])).select(
                F.lit(c).alias("component"), "name", "carrier"
            )
            for c in dict.fromkeys(c for c, _ in special)
        ],
    )
    marked = network.series.join(units, ["component", "name"], "left")
    rest = marked.where(F.col("carrier").isNull()).drop("carrier")
    parts = [series.resample(rest.select(*SERIES_COLUMNS), network.snapshots, weights, common_rules)]
    for (c, carrier), own in special.items():
        mine = marked.where((F.col("component") == c) & (F.col("carrier") == carrier)).select(*SERIES_COLUMNS)
        parts.append(series.resample(mine, network.snapshots, weights, {**common_rules, **own}))
    return reduce(DataFrame.unionByName, parts)


def single_node(network: Network, settings: Mapping, monthly: DataFrame | None = None, hourly: DataFrame | None = None) -> Network:
    """Everything on one bus; the first snapshots only."""
    out = _written(common(network, settings, monthly, hourly), {})
    out = out.with_components(buses=topology.ensure_bus(out["buses"]))
    out = standardized(out, settings)
    return with_energy_limits(_first(out, settings), settings)


def province(network: Network, settings: Mapping, monthly: DataFrame | None = None, hourly: DataFrame | None = None) -> Network:
    """Regions, no resampling; the first snapshots only."""
    rolled = aggregate_by_region(common(network, settings, monthly, hourly), settings)
    out = standardized(_written(rolled, settings.get("regional_aggregation", {})), settings)
    return with_energy_limits(_first(out, settings), settings)


def _first(network: Network, settings: Mapping) -> Network:
    kept = series.first_snapshots(network.snapshots, int(settings.get("first_snapshots", 48)))
    out = network.with_snapshots(kept)
    return out if network.series is None else out.with_series(series.within(network.series, kept))


def group(network: Network, settings: Mapping, monthly: DataFrame | None = None, hourly: DataFrame | None = None) -> Network:
    """Regions and groups, a range of snapshots, resampling."""
    rolled = aggregate_by_region(common(network, settings, monthly, hourly), settings)
    out = standardized(_written(rolled, settings.get("regional_aggregation", {})), settings)
    out = series.limit_network(out, settings.get("snapshot_start"), settings.get("snapshot_end"))
    return resampled(with_energy_limits(out, settings), settings)


def summaries(network: Network, carriers_order=None) -> dict[str, DataFrame]:
    """Result tables of a solved network."""
    out = {"generation": results.generation_and_storage(network), "balance": results.load_vs_generation(network.series)}
    if carriers_order is not None:
        out["carrier_order"] = results.carrier_order(out["generation"], carriers_order)
    if "storage_units" in network:
        out["state_of_charge"] = results.state_of_charge(network.series, network["storage_units"])
    links = network["links"] if "links" in network else None
    lines = network["lines"] if "lines" in network else None
    for kind, edges in (("links", links), ("lines", lines)):
        if edges is not None:
            out[f"{kind}_stats"] = results.flow_stats(network.series, edges, kind)
    if links is not None or lines is not None:
        out["flows"] = results.flow_series_signed(network.series, links, lines)
        out["edges"] = results.edge_config(links, lines)
    return out


def from_files(
    spark: SparkSession, folder: str, base: int | None, target: int | None, monthly: str | None = None, hourly: str | None = None
) -> tuple[Network, DataFrame | None, DataFrame | None]:
    """(network, monthly facts, hourly facts) from disk; rows set aside are kept with the network."""
    network = tables.read_network(spark, folder)
    rejects, months, hours = {}, None, None
    if monthly:
        months, rejects["monthly_file"] = tables.read_monthly(spark, monthly, base, target)
    if hourly:
        hours, rejects["hourly_file"] = tables.read_hourly(spark, hourly, base, target)
    return network.with_rejects(**rejects), months, hours
