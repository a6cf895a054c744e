"""Loads: repair, regional allocation and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..model import ROW_ID, SERIES_COLUMNS, scalar, total
from .columns import standardize_region

# Label of the total row in demand tables, load of a region without demand data.
TOTAL_LABEL = "합계"
FALLBACK_LOAD = 1000.0


def repaired_loads(loads: DataFrame, buses: DataFrame, region_column: str) -> DataFrame:
    """Loads on an unknown bus move to the bus named like their region, or drop out if there is none."""
    known = buses.select(F.col("name").alias("_bus"))
    placed = loads.join(known, F.col("bus") == F.col("_bus"), "left")
    if region_column not in loads.columns:
        return placed.where(F.col("_bus").isNotNull()).select(*loads.columns)
    fallback = buses.select(F.col("name").alias("_alt"))
    return (
        placed.join(fallback, F.col(region_column) == F.col("_alt"), "left")
        .withColumn("bus", F.coalesce("_bus", "_alt"))
        .where(F.col("bus").isNotNull())
        .select(*loads.columns)
    )


def demand_shares(demand: DataFrame, region_column: str, region_map: DataFrame | None = None) -> DataFrame:
    """(region, demand, share), without the total row. Shares are of all demand, placed or not."""
    rows = standardize_region(demand, region_column, region_map)
    rows = rows.where(F.coalesce(F.col(region_column) != TOTAL_LABEL, F.lit(True)))
    whole = F.nullif(scalar(rows, F.sum("demand")), F.lit(0.0))
    return rows.withColumn("region", F.col(region_column)).withColumn("share", F.col("demand") / whole)


def base_pattern(series: DataFrame) -> DataFrame:
    """(snapshot, pattern): total load per snapshot."""
    return (
        series.where((F.col("component") == "loads") & (F.col("attribute") == "p_set"))
        .groupBy("snapshot")
        .agg(total("value").alias("pattern"))
    )


def placeable_shares(demand: DataFrame, buses: DataFrame, region_column: str, region_map: DataFrame | None = None) -> DataFrame:
    """Positive shares of regions that have a bus, the first row per region."""
    shares = demand_shares(demand, region_column, region_map).where(F.col("share") > 0)
    if ROW_ID in demand.columns:
        order: Column = F.col(ROW_ID)
    else:
        order = F.lit(0)
    first = shares.groupBy("region").agg(F.min_by(F.struct("demand", "share"), order).alias("_f"))
    known = buses.select(F.col("name").alias("region"))
    return first.join(known, "region", "left_semi").select("region", "_f.*")


def unallocated_share(demand: DataFrame, buses: DataFrame, region_column: str, region_map: DataFrame | None = None) -> DataFrame:
    """One row: the share of demand in regions without a bus."""
    shares = demand_shares(demand, region_column, region_map)
    known = buses.select(F.col("name").alias("region"))
    return shares.join(known, "region", "left_anti").agg(total("share").alias("unallocated_share"))


def allocated_pattern(pattern: DataFrame, shares: DataFrame) -> DataFrame:
    """Pattern times share for every region, as load series.

    The shares ride along as one array (a row per region, a dimension), so the pattern is read once and
    expands in place.
    """
    packed = scalar(shares, F.collect_list(F.struct("region", "share")))
    return pattern.withColumn("_s", F.explode(packed)).select(
        F.lit("loads").alias("component"),
        F.lit("p_set").alias("attribute"),
        F.concat(F.lit("load_"), F.col("_s.region")).alias("name"),
        "snapshot",
        (F.col("pattern") * F.col("_s.share")).alias("value"),
    )


def regional_loads(
    loads: DataFrame,
    series: DataFrame | None,
    buses: DataFrame,
    demand: DataFrame | None,
    region_column: str,
    region_map: DataFrame | None = None,
    carrier: str | None = None,
    replace_existing: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """(loads, series) with a load per region that follows the total pattern by share of demand.

    Without a pattern the static load is the demand itself; without demand data each bus gets a flat
    load. Loads that already exist stay (and add to the total) unless `replace_existing`.
    """
    kept = repaired_loads(loads, buses, region_column)
    if replace_existing:
        kept = kept.limit(0)
    taken = kept.select("name")
    has_pattern = series is not None and not series.where(
        (F.col("component") == "loads") & (F.col("attribute") == "p_set")
    ).isEmpty()
    pattern = base_pattern(series) if has_pattern else None
    if demand is None or region_column not in demand.columns:
        new = buses.select(F.concat(F.lit("load_"), "name").alias("name"), F.col("name").alias("bus"), F.lit(FALLBACK_LOAD).alias("p_set"))
        new = new.join(taken, "name", "left_anti")
        fresh = None
    else:
        shares = placeable_shares(demand, buses, region_column, region_map)
        regions_taken = taken.where(F.col("name").startswith("load_")).select(
            F.regexp_replace("name", "^load_", "").alias("region")
        )
        shares = shares.join(regions_taken, "region", "left_anti")
        if pattern is not None:
            value = scalar(pattern, F.avg("pattern")) * F.col("share")
            fresh = allocated_pattern(pattern, shares)
        else:
            value, fresh = F.col("demand"), None
        new = shares.select(F.concat(F.lit("load_"), "region").alias("name"), F.col("region").alias("bus"), value.alias("p_set"))
    if carrier:
        new = new.withColumn("carrier", F.lit(carrier))
    out = kept.unionByName(new, allowMissingColumns=True)
    if series is None:
        return out, None
    mine = F.col("component") == "loads"
    lasting = series.where(mine).join(kept.select("name"), "name", "left_semi").select(*SERIES_COLUMNS)
    rest = series.where(~mine).select(*SERIES_COLUMNS).unionByName(lasting)
    return out, rest if fresh is None else rest.unionByName(fresh)


def load_groups(loads: DataFrame, groups: DataFrame, region_groups: DataFrame) -> DataFrame:
    """Loads with the group of their bus; a bus that already is a group stands for itself."""
    own = groups.select(F.col("name").alias("bus"), F.col("name").alias("group"))
    pairs = region_groups.select("bus", F.col("region").alias("group"))
    # The region mapping wins over a group of the same name.
    both = pairs.unionByName(own.join(pairs.select("bus"), "bus", "left_anti"))
    return loads.drop("group").join(both, "bus")


def group_loads(
    loads: DataFrame, series: DataFrame | None, groups: DataFrame, region_groups: DataFrame, carrier: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """One load per group: static loads added up, series added up where no member is missing a value."""
    placed = load_groups(loads, groups, region_groups)
    sums = placed.groupBy("group").agg(total("p_set").alias("p_set")) if "p_set" in loads.columns else (
        placed.groupBy("group").agg(F.lit(0.0).alias("p_set"))
    )
    out = (
        groups.select(F.col("name").alias("group"))
        .join(sums, "group", "left")
        .select(
            F.concat(F.lit("load_"), "group").alias("name"),
            F.col("group").alias("bus"),
            F.coalesce("p_set", F.lit(0.0)).alias("p_set"),
        )
    )
    if carrier:
        out = out.withColumn("carrier", F.lit(carrier))
    if series is None:
        return out, None
    mine = (F.col("component") == "loads") & (F.col("attribute") == "p_set")
    rows = series.where(mine).join(placed.select("name", "group"), "name")
    # A member without a row at a snapshot is as missing as one with a null there.
    members = rows.select("group", "name").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("_members"))
    added = (
        rows.groupBy("group", "snapshot")
        .agg(F.count("value").alias("_known"), F.sum("value").alias("_sum"))
        .join(members, "group")
        .select(
            F.lit("loads").alias("component"),
            F.lit("p_set").alias("attribute"),
            F.concat(F.lit("load_"), "group").alias("name"),
            "snapshot",
            F.when(F.col("_known") == F.col("_members"), F.col("_sum")).alias("value"),
        )
    )
    return out, series.where(F.col("component") != "loads").select(*SERIES_COLUMNS).unionByName(added.select(*SERIES_COLUMNS))
