"""Result tables from solved series: generation, storage, flows and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import temporal
from ..functions.text import edge_label
from ..model import ROW_ID, Network, scalar, total


def _of(series: DataFrame, component: str, attribute: str) -> DataFrame:
    return series.where((F.col("component") == component) & (F.col("attribute") == attribute))


# --- generation and storage ---------------------------------------------------------------------


def _by_carrier(rows: DataFrame, units: DataFrame, value: Column) -> DataFrame:
    return (
        rows.join(units.select("name", "carrier"), "name")
        .where(F.col("carrier").isNotNull())
        .groupBy("snapshot", "carrier")
        .agg(total(value).alias("value"))
    )


def generation_by_carrier(series: DataFrame, generators: DataFrame) -> DataFrame:
    """(snapshot, carrier, value): dispatch added up."""
    return _by_carrier(_of(series, "generators", "p"), generators, F.col("value"))


def storage_split(series: DataFrame, storage_units: DataFrame) -> DataFrame:
    """(snapshot, carrier, value, kind): discharge under the carrier, charge under `<carrier>_charge`.

    Both sums come from one aggregation; the two rows are unfolded afterwards.
    """
    rows = _of(series, "storage_units", "p").join(storage_units.select("name", "carrier"), "name")
    sums = rows.where(F.col("carrier").isNotNull()).groupBy("snapshot", "carrier").agg(
        total(F.greatest("value", F.lit(0.0))).alias("up"), total(F.least("value", F.lit(0.0))).alias("down")
    )
    parts = F.array(
        F.struct(F.col("carrier").alias("c"), F.col("up").alias("v"), F.lit("discharge").alias("k")),
        F.struct(F.concat("carrier", F.lit("_charge")).alias("c"), F.col("down").alias("v"), F.lit("charge").alias("k")),
    )
    return sums.select("snapshot", F.explode(parts).alias("p")).select(
        "snapshot", F.col("p.c").alias("carrier"), F.col("p.v").alias("value"), F.col("p.k").alias("kind")
    )


def generation_and_storage(network: Network, include_storage: bool = True) -> DataFrame:
    """The long table behind the stacked chart."""
    out = generation_by_carrier(network.series, network["generators"]).withColumn("kind", F.lit("generation"))
    if include_storage and "storage_units" in network:
        out = out.unionByName(storage_split(network.series, network["storage_units"]))
    return out


def state_of_charge(series: DataFrame, storage_units: DataFrame) -> DataFrame:
    return _by_carrier(_of(series, "storage_units", "state_of_charge"), storage_units, F.col("value"))


def load_vs_generation(series: DataFrame) -> DataFrame:
    """(snapshot, kind, value): total generation and total load, in one pass over the series."""
    generation = (F.col("component") == "generators") & (F.col("attribute") == "p")
    load = (F.col("component") == "loads") & (F.col("attribute") == "p_set")
    kind = F.when(generation, F.lit("Generation")).otherwise(F.lit("Load"))
    return series.where(generation | load).groupBy("snapshot", kind.alias("kind")).agg(total("value").alias("value"))


def carrier_order(carriers: DataFrame, order: Sequence[str]) -> DataFrame:
    """(carrier, position): the configured order reversed, each carrier before its charge variant, the rest after."""
    ranked: dict[str, int] = {}
    for carrier in reversed(order):
        for name in (carrier, f"{carrier}_charge"):
            ranked.setdefault(name, len(ranked))
    known = F.create_map(*[F.lit(x) for pair in ranked.items() for x in pair]) if ranked else None
    spot = F.lit(None).cast("int") if known is None else F.try_element_at(known, F.col("carrier"))
    return carriers.select("carrier").distinct().withColumn("position", F.coalesce(spot, F.lit(len(ranked))).cast("bigint"))


# --- flows --------------------------------------------------------------------------------------


def flow_totals(series: DataFrame, component: str) -> DataFrame:
    """(name, energy): sum of absolute flow; nothing at all if nothing flows."""
    sums = _of(series, component, "p0").groupBy("name").agg(total(F.abs("value")).alias("energy"))
    return sums.where(scalar(sums, F.sum("energy")) != 0)


def top_flows(series: DataFrame, edges: DataFrame, component: str, top_n: int | None = 10) -> DataFrame:
    """The edges with the most energy, first in file order on ties."""
    sums = flow_totals(series, component).join(edges.select("name", "bus0", "bus1", ROW_ID), "name")
    return sums if top_n is None else sums.orderBy(F.desc("energy"), ROW_ID).limit(top_n)


def flow_series_abs(series: DataFrame, edges: DataFrame, component: str, top_n: int | None = 10) -> DataFrame:
    """(snapshot, name, route, value): absolute flow of the selected edges."""
    chosen = top_flows(series, edges, component, top_n)
    return _of(series, component, "p0").join(chosen.select("name", "bus0", "bus1"), "name").select(
        "snapshot", "name", edge_label(F.col("bus0"), F.col("bus1")).alias("route"), F.abs("value").alias("value")
    )


def flow_map_edges(series: DataFrame, edges: DataFrame, buses: DataFrame, component: str, top_n: int | None = 20) -> DataFrame:
    """Edges with both end coordinates, energy and drawing width; edges with an unknown bus drop out."""
    chosen = top_flows(series, edges, component, top_n)
    widest = scalar(chosen, F.max("energy"))
    out = chosen
    for i in ("0", "1"):
        at = buses.select(F.col("name").alias(f"bus{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
        out = out.join(at, f"bus{i}")
    width = F.lit(1.0) + F.try_divide(F.col("energy"), widest) * 10
    return out.select("name", "bus0", "bus1", "x0", "y0", "x1", "y1", "energy", width.alias("width"))


def flow_buses(series: DataFrame, edges: DataFrame, buses: DataFrame, component: str, top_n: int | None = 20) -> DataFrame:
    """The distinct buses the selected flows touch."""
    chosen = top_flows(series, edges, component, top_n)
    ends = chosen.select(F.explode(F.array("bus0", "bus1")).alias("name")).distinct()
    return buses.select("name", "x", "y").join(ends, "name", "left_semi")


def flow_series_signed(series: DataFrame, links: DataFrame | None, lines: DataFrame | None) -> DataFrame:
    """(snapshot, name, label, value) of every link and line with a flow."""
    parts = []
    for component, prefix, edges in (("links", "Link: ", links), ("lines", "Line: ", lines)):
        if edges is not None:
            label = edge_label(F.col("bus0"), F.col("bus1"), prefix)
            rows = _of(series, component, "p0").join(edges.select("name", "bus0", "bus1"), "name")
            parts.append(rows.select("snapshot", "name", label.alias("label"), "value"))
    return reduce(DataFrame.unionByName, parts)


def flow_stats(series: DataFrame, edges: DataFrame, component: str) -> DataFrame:
    """Per edge: mean, extremes, use of capacity in percent and whether it ever flows backwards."""
    capacity = "p_nom" if component == "links" else "s_nom"
    stats = _of(series, component, "p0").groupBy("name").agg(
        F.avg("value").alias("mean_flow"),
        F.max("value").alias("max_flow"),
        F.min("value").alias("min_flow"),
        F.max(F.abs("value")).alias("peak"),
    )
    return edges.select("name", "bus0", "bus1", F.col(capacity).alias("capacity")).join(stats, "name").select(
        "name",
        "bus0",
        "bus1",
        "capacity",
        "mean_flow",
        "max_flow",
        "min_flow",
        (F.try_divide("peak", "capacity") * 100).alias("utilization"),
        F.coalesce(F.col("min_flow") < 0, F.lit(False)).alias("reverse"),
    )


def edge_config(links: DataFrame | None, lines: DataFrame | None) -> DataFrame:
    """(kind, name, bus0, bus1, capacity, efficiency, bidirectional) of all links and lines."""
    parts = []
    if links is not None:
        both = F.coalesce(F.col("p_min_pu") < 0, F.lit(False)) if "p_min_pu" in links.columns else F.lit(False)
        parts.append(
            links.select(
                F.lit("link").alias("kind"), "name", "bus0", "bus1", F.col("p_nom").alias("capacity"), "efficiency",
                both.alias("bidirectional"),
            )
        )
    if lines is not None:
        parts.append(
            lines.select(
                F.lit("line").alias("kind"), "name", "bus0", "bus1", F.col("s_nom").alias("capacity"),
                F.lit(None).cast("double").alias("efficiency"), F.lit(None).cast("boolean").alias("bidirectional"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


# --- diagnostics --------------------------------------------------------------------------------


def _metrics(df: DataFrame, section: str, key: Column, names: Sequence[str]) -> DataFrame:
    """Wide aggregates to (section, key, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("m"), F.col(n).cast("double").alias("v")) for n in names])
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.explode(pairs).alias("p")).select(
        "section", "key", F.col("p.m").alias("metric"), F.col("p.v").alias("value")
    )


def network_diagnostics(network: Network) -> DataFrame:
    """One long table: snapshots, capacity, availability, energy limits, load and ramp limits."""
    generators, series = network["generators"], network.series
    step = temporal.seconds_between(
        F.min(F.when(F.col("pos") == 0, F.col("snapshot"))), F.min(F.when(F.col("pos") == 1, F.col("snapshot")))
    ) / F.lit(3600.0)
    shots = network.snapshots.agg(F.count(F.lit(1)).alias("count"), step.alias("step_hours"))
    shots = shots.withColumn("total_hours", F.col("count") * F.col("step_hours"))
    parts = [_metrics(shots, "snapshots", F.lit("all"), ["count", "step_hours", "total_hours"])]

    per_carrier = {"capacity": ["p_nom"], "energy": ["e_sum_max", "e_sum_min"], "ramp": ["ramp_limit_up"]}
    present = {s: [c for c in cs if c in generators.columns] for s, cs in per_carrier.items()}
    aggs = [
        (F.avg(c) if s == "ramp" else total(c)).alias(c) for s, cs in present.items() for c in cs
    ]
    # All carrier figures from one aggregation of the units.
    by_carrier = generators.where(F.col("carrier").isNotNull()).groupBy("carrier").agg(*aggs)
    for section, columns in present.items():
        if columns:
            part = _metrics(by_carrier, section, F.col("carrier"), columns)
            parts.append(part.where(F.col("value").isNotNull()) if section == "ramp" else part)

    members = generators.select("name")
    availability = _of(series, "generators", "p_max_pu").groupBy("name").agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min")
    )
    parts.append(_metrics(availability.join(members, "name", "left_semi"), "p_max_pu", F.col("name"), ["mean", "max", "min"]))

    per_snapshot = _of(series, "loads", "p_set").groupBy("snapshot").agg(total("value").alias("load"))
    load = per_snapshot.agg(
        F.sum("load").alias("total"), F.avg("load").alias("average"), F.max("load").alias("peak"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") > 0)
    parts.append(_metrics(load, "load", F.lit("all"), ["total", "average", "peak"]))
    return reduce(DataFrame.unionByName, parts)


def adequacy_check(network: Network, first: int = 5) -> DataFrame:
    """Available capacity against load in the first snapshots, with the deficit where it falls short.

    Capacity of units without a series is one number; units with one are added up per snapshot, and a
    missing value there makes the availability of that snapshot unknown.
    """
    generators, series = network["generators"], network.series
    window = network.snapshots.where(F.col("pos") < first).select("snapshot")
    availability = _of(series, "generators", "p_max_pu")
    with_series = availability.select("name").distinct()
    fixed = scalar(generators.join(with_series, "name", "left_anti"), total("p_nom"))
    members = scalar(generators.join(with_series, "name", "left_semi"), F.count(F.lit(1)))
    varying = (
        availability.join(window, "snapshot", "left_semi")
        .join(generators.select("name", "p_nom"), "name")
        .groupBy("snapshot")
        .agg(F.sum(F.col("p_nom") * F.col("value")).alias("_sum"), F.count(F.col("p_nom") * F.col("value")).alias("_n"))
    )
    load = (
        _of(series, "loads", "p_set").join(window, "snapshot", "left_semi").groupBy("snapshot").agg(total("value").alias("load"))
    )
    known = F.coalesce("_n", F.lit(0)) == members
    available = F.when(known, F.coalesce("_sum", F.lit(0.0)) + fixed)
    return (
        window.join(varying, "snapshot", "left")
        .join(load, "snapshot", "left")
        .select("snapshot", available.alias("available"), F.coalesce("load", F.lit(0.0)).alias("load"))
        .withColumn("deficit", F.when(F.col("available") < F.col("load"), F.col("load") - F.col("available")))
    )


def resample_effect(series: DataFrame, snapshots: DataFrame, hours: int = 4, first: int | None = 5) -> DataFrame:
    """Per unit: mean and maximum of the availability, of its bucket means and of its bucket maxima, and the loss.

    `first` keeps that many units by name, as the report prints; None keeps all.
    """
    rows = _of(series, "generators", "p_max_pu")
    if first is not None:
        rows = rows.join(rows.select("name").distinct().orderBy("name").limit(first), "name", "left_semi").select(*series.columns)
    original = rows.groupBy("name").agg(F.avg("value").alias("original_mean"), F.max("value").alias("original_max"))
    anchor = scalar(snapshots, F.date_trunc("day", F.min("snapshot")).cast("timestamp_ntz"))
    bucket = temporal.bucket_start(F.col("snapshot"), anchor, hours)
    folded = rows.withColumn("bucket", bucket).groupBy("name", "bucket").agg(F.avg("value").alias("m"), F.max("value").alias("x"))
    after = folded.groupBy("name").agg(
        F.avg("m").alias("mean_rule_mean"), F.max("m").alias("mean_rule_max"),
        F.avg("x").alias("max_rule_mean"), F.max("x").alias("max_rule_max"),
    )
    loss = F.try_divide(F.col("original_mean") - F.col("mean_rule_mean"), F.col("original_mean")) * 100
    return original.join(after, "name").withColumn("loss_percent", loss)
