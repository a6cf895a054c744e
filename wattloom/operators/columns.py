"""Filters, name mappings and column updates on component tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..model import COMPONENTS, CARRIER_COMPONENTS, Network, scalar


def lifecycle(df: DataFrame, target_year: int) -> DataFrame:
    """Units built by the target year and not yet closed; an unknown build year does not count as built."""
    if "build_year" not in df.columns:
        return df
    keep = F.col("build_year") <= target_year
    if "close_year" in df.columns:
        keep = keep & ((F.col("close_year") > target_year) | F.col("close_year").isNull())
    return df.where(keep)


def lifecycle_network(network: Network, base_year: int | None, target_year: int | None) -> Network:
    """The filter on every component, and the series of the units that remain."""
    if not base_year or not target_year:
        return network
    dated = [n for n in COMPONENTS if n in network and "build_year" in network[n].columns]
    kept = {n: lifecycle(network[n], target_year) for n in dated}
    out = network.with_components(**kept)
    if network.series is None or not kept:
        return out
    members = reduce(
        DataFrame.unionByName, [df.select(F.lit(n).alias("component"), "name") for n, df in kept.items()]
    )
    filtered = F.col("component").isin(*dated)
    remaining = network.series.where(filtered).join(members, ["component", "name"], "left_semi")
    return out.with_series(network.series.where(~filtered).unionByName(remaining))


def blank_cc_group(df: DataFrame) -> DataFrame:
    return df.withColumn("cc_group", text.blank_to_null(F.col("cc_group"))) if "cc_group" in df.columns else df


def active_only(df: DataFrame) -> DataFrame:
    """Rows whose status is true, also when the flag was read as text or as 0/1."""
    return df.where(F.lower(F.col("status").cast("string")).isin("true", "1", "1.0"))


def parse_filters(arguments: Iterable[str]) -> dict[str, list[str]]:
    """`column=v1,v2` arguments to a mapping; a missing `=` is an error."""
    filters: dict[str, list[str]] = {}
    for argument in arguments:
        column, found, values = argument.partition("=")
        if not found:
            raise ValueError(f"filter {argument!r} is not of the form column=value1,value2")
        filters[column.strip()] = [v.strip() for v in values.split(",")]
    return filters


def in_lists(df: DataFrame, filters: Mapping[str, Sequence]) -> DataFrame:
    """All filters must hold; a filter on an unknown column is skipped."""
    known = [F.col(c).isin(*values) for c, values in filters.items() if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, known)) if known else df


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Drop the `.1` copies that a repeated CSV header leaves behind."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.endswith(".1")])


# --- mappings -----------------------------------------------------------------------------------


def map_values(
    df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, stripped: bool = False
) -> DataFrame:
    """Replace a column through a two-column mapping with unique keys; what it lacks stays.

    With `stripped` both the lookup and an unmapped result are free of outer white space. The mapping is
    not hinted: Spark broadcasts it when it is small enough and shuffles otherwise.
    """
    looked_up = text.strip(F.col(column)) if stripped else F.col(column)
    pairs = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return (
        df.withColumn("_lookup", looked_up)
        .join(pairs, F.col("_lookup") == F.col("_key"), "left")
        .withColumn(column, F.coalesce("_value", "_lookup"))
        .select(*df.columns)
    )


def map_carriers(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename carriers; unmapped, missing and empty ones stay."""
    usable = mapping.where(F.col("original_carrier") != "")
    return map_values(df, "carrier", usable, "original_carrier", "mapped_carrier")


def carrier_changes(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """How many rows a carrier mapping changes, by old and new name. Counts first, joins the counts."""
    counts = df.where(F.col("carrier").isNotNull() & (F.col("carrier") != "")).groupBy("carrier").agg(
        F.count(F.lit(1)).alias("n")
    )
    changed = mapping.where(F.col("original_carrier") != F.col("mapped_carrier"))
    return counts.join(changed, F.col("carrier") == F.col("original_carrier")).select(
        "original_carrier", "mapped_carrier", "n"
    )


def carriers_in_use(tables: Iterable[DataFrame]) -> DataFrame:
    """Distinct carriers per table first, so only those travel."""
    used = [
        df.select("carrier").where(F.col("carrier").isNotNull() & (F.col("carrier") != "")).distinct()
        for df in tables
        if "carrier" in df.columns
    ]
    return reduce(DataFrame.unionByName, used).distinct()


def sync_carriers(carriers: DataFrame, used: DataFrame, mapping: DataFrame) -> DataFrame:
    """The carrier dimension with missing names added and unused names that were mapped away removed."""
    names = used.select(F.col("carrier").alias("name"))
    added = names.join(carriers.select("name"), "name", "left_anti")
    removed = carrier_differences(carriers, used, mapping).where(F.col("change") == "remove").select("name")
    return carriers.join(removed, "name", "left_anti").unionByName(added, allowMissingColumns=True)


def carrier_differences(carriers: DataFrame, used: DataFrame, mapping: DataFrame) -> DataFrame:
    """(name, change): used but unknown -> 'add'; known, unused and a mapping key -> 'remove'."""
    known = carriers.select("name")
    names = used.select(F.col("carrier").alias("name"))
    old = mapping.select(F.col("original_carrier").alias("name"))
    add = names.subtract(known).withColumn("change", F.lit("add"))
    remove = known.subtract(names).intersect(old).withColumn("change", F.lit("remove"))
    return add.unionByName(remove)


def standardize_carriers(network: Network, mapping: DataFrame | None) -> Network:
    if mapping is None:
        return network
    touched = {
        n: map_carriers(network[n], mapping)
        for n in CARRIER_COMPONENTS
        if n in network and "carrier" in network[n].columns
    }
    out = network.with_components(**touched)
    if "carriers" not in out:
        return out
    used = carriers_in_use(touched.values())
    return out.with_components(carriers=sync_carriers(out["carriers"], used, mapping))


def standardize_region(df: DataFrame, column: str, region_map: DataFrame | None) -> DataFrame:
    """Official or short region name to the short one; unknown names are only stripped."""
    return df if region_map is None else map_values(df, column, region_map, "k", "short", stripped=True)


def unmapped_values(df: DataFrame, column: str, mapping: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty values the mapping does not know."""
    values = df.select(text.strip(F.col(column)).alias("value")).where(F.col("value") != "").distinct()
    return values.join(mapping.select(F.col(key).alias("value")), "value", "left_anti")


def map_region_report(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rows changed and number of distinct unmapped names."""
    counts = df.groupBy(text.strip(F.col(column)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = counts.where(F.col("_v").isNotNull()).join(pairs, F.col("_v") == F.col("_key"), "left")
    changed = F.col("_value").isNotNull() & (F.col("_value") != F.col("_v"))
    return joined.agg(
        F.coalesce(F.sum(F.when(changed, F.col("_n"))), F.lit(0)).cast("bigint").alias("changed"),
        F.count(F.when(F.col("_key").isNull() & (F.col("_v") != ""), 1)).alias("unmapped"),
    )


def map_region_column(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Replace values found in the mapping (looked up without outer white space); the rest is untouched."""
    pairs = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return (
        df.withColumn("_lookup", text.strip(F.col(column)))
        .join(pairs, F.col("_lookup") == F.col("_key"), "left")
        .withColumn(column, F.coalesce("_value", column))
        .select(*df.columns)
    )


def tag_cc_group(df: DataFrame) -> DataFrame:
    return df.withColumn("cc_group", text.cc_group(F.col("name"), F.col("type")))


# --- limits and rescaling -----------------------------------------------------------------------


def cf_energy_limits(generators: DataFrame, carrier_attrs: DataFrame, hours: Column) -> DataFrame:
    """`e_sum_max/min = p_nom * capacity factor * hours`, by carrier, else by the `default` row, else as it was."""
    df = generators
    if "e_sum_max" not in df.columns:
        df = df.withColumn("e_sum_max", F.lit(float("inf")))
    if "e_sum_min" not in df.columns:
        df = df.withColumn("e_sum_min", F.lit(0.0))
    columns = df.columns
    present = [c for c in ("max_cf", "min_cf") if c in carrier_attrs.columns]
    own = carrier_attrs.where(F.col("carrier") != "default").select(
        F.col("carrier").alias("_carrier"), *[F.col(c).alias(f"_{c}") for c in present]
    )
    fallback = carrier_attrs.where(F.col("carrier") == "default")
    joined = df.join(own, F.col("carrier") == F.col("_carrier"), "left")
    for cf, target in (("max_cf", "e_sum_max"), ("min_cf", "e_sum_min")):
        if cf not in present:
            continue
        factor = F.coalesce(F.col(f"_{cf}"), scalar(fallback, F.max(cf)))
        limit = F.when(F.col("carrier").isNotNull(), F.col("p_nom") * factor * hours)
        joined = joined.withColumn(target, F.when(factor.isNull() | F.col("carrier").isNull(), F.col(target)).otherwise(limit))
    return joined.select(*columns)


def scale_load(series: DataFrame, target: float | None) -> DataFrame:
    """Scale all load series to a target total. No total, or a total of zero, leaves them alone."""
    if target is None or target <= 0:
        return series
    is_load = (F.col("component") == "loads") & (F.col("attribute") == "p_set")
    current = scalar(series.where(is_load), F.sum("value"))
    factor = F.coalesce(F.lit(float(target)) / F.nullif(current, F.lit(0.0)), F.lit(1.0))
    return series.withColumn("value", F.when(is_load, F.col("value") * factor).otherwise(F.col("value")))
