"""Merging and aggregating units by per-attribute rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.rules import LEADER, SERIES_RULES, finish, plan_rules
from ..model import ROW_ID, total

_HIDDEN = (ROW_ID, "name")


# --- combined-cycle units -----------------------------------------------------------------------


def merge_cc(units: DataFrame, rules: Mapping[str, object], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Units that share a `cc_group` with another one become one row; all others stay as they are.

    Groups are found and merged by partially aggregated sums and extremes; the rest is told apart by
    joining the merged groups back.
    """
    if "cc_group" not in units.columns or not rules:
        return units
    columns = [c for c in units.columns if c not in _HIDDEN]
    plan = plan_rules(units, columns, rules, "p_nom", {"cc_group": F.col("_group")}, constants=False)
    grouped = (
        units.where(F.col("cc_group").isNotNull())
        .groupBy(F.col("cc_group").alias("_group"))
        .agg(*plan.aggregates, F.count(F.lit(1)).alias("_n"), F.min(ROW_ID).alias("_first"))
        .where(F.col("_n") > 1)
    )
    named = _free_names(grouped, units)
    merged = named.select(
        F.col("_name").alias("name"),
        *[finish(c, plan.outputs.get(c, F.lit(None)), defaults).cast(units.schema[c].dataType).alias(c) for c in columns],
        *([F.col("_first").alias(ROW_ID)] if ROW_ID in units.columns else []),
    )
    groups = grouped.select(F.col("_group").alias("cc_group"))
    # Units without a group share no key worth meeting under.
    single = units.where(F.col("cc_group").isNotNull()).join(groups, "cc_group", "left_anti")
    rest = single.select(*units.columns).unionByName(units.where(F.col("cc_group").isNull()))
    return rest.select(*merged.columns).unionByName(merged).select(*units.columns)


def _free_names(grouped: DataFrame, units: DataFrame) -> DataFrame:
    """`<group>_CC`, or with the first free `_1, _2, ...` behind it if a unit has that name already."""
    pattern = r"^(.*)_CC(?:_([1-9][0-9]*))?$"
    taken = (
        units.where(F.col("name").rlike(pattern))
        .select(
            F.regexp_extract("name", pattern, 1).alias("_base"),
            F.coalesce(F.nullif(F.regexp_extract("name", pattern, 2), F.lit("")).cast("bigint"), F.lit(0)).alias("_at"),
        )
        .distinct()
    )
    # The run of taken numbers that starts at 0 ends where the successor is missing.
    ends = taken.join(taken.select("_base", (F.col("_at") - 1).alias("_at")), ["_base", "_at"], "left_anti")
    runs = ends.groupBy("_base").agg(F.min("_at").alias("_end"))
    blocked = runs.join(taken.where(F.col("_at") == 0).select("_base"), "_base", "left_semi")
    suffix = F.when(F.col("_end").isNull(), F.lit("")).otherwise(F.concat(F.lit("_"), (F.col("_end") + 1).cast("string")))
    return (
        grouped.join(blocked, F.col("_group") == F.col("_base"), "left")
        .withColumn("_name", F.concat(F.col("_group"), F.lit("_CC"), suffix))
        .drop("_base", "_end")
    )


def merge_cc_simple(units: DataFrame) -> DataFrame:
    """Every `cc_group` becomes one row: its first unit named with `GT` (else its first), capacities added."""
    if "cc_group" not in units.columns:
        return units
    columns = [c for c in units.columns if c not in ("name", "p_nom", "cc_group")]
    turbine = F.coalesce(F.contains(F.col("name"), F.lit("GT")), F.lit(False))
    template = F.min_by(F.struct(*columns), F.struct(~turbine, F.col(ROW_ID)))
    merged = (
        units.where(F.col("cc_group").isNotNull())
        .groupBy("cc_group")
        .agg(template.alias(LEADER), total("p_nom").alias("p_nom"))
        .select("cc_group", "p_nom", F.col("cc_group").alias("name"), f"{LEADER}.*")
    )
    return units.where(F.col("cc_group").isNull()).unionByName(merged.select(*units.columns))


def cc_summary(units: DataFrame) -> DataFrame:
    """One row: units with a group, number of groups, group sizes."""
    per_group = units.where(F.col("cc_group").isNotNull()).groupBy("cc_group").agg(F.count(F.lit(1)).alias("n"))
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("units"),
        F.count(F.lit(1)).alias("groups"),
        F.max("n").alias("largest"),
    )


def cc_samples(units: DataFrame, size: int = 5) -> DataFrame:
    """The first `size` units with a group, in file order: the sample the report prints."""
    return units.where(F.col("cc_group").isNotNull()).orderBy(ROW_ID).select("name", "cc_group").limit(size)


# --- carrier and region -------------------------------------------------------------------------


def _region_key(units: DataFrame, region_column: str | None) -> str | None:
    return region_column if region_column in units.columns else None


def merged_name(carrier: Column, region: Column | None) -> Column:
    return F.concat(carrier, F.lit("_aggregated")) if region is None else F.concat_ws("_", carrier, region)


def aggregate_by_carrier(
    units: DataFrame,
    rules: Mapping[str, object],
    region_column: str | None = None,
    region_map: DataFrame | None = None,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """One unit per carrier, or per carrier and region. Rows without a key drop out.

    All rules become aggregates of one `groupBy`: a single pass, and what is shuffled are partial results,
    a row per key and task. Rules whose name is no rule are constants.
    """
    region = _region_key(units, region_column)
    keys = ["carrier"] + ([region] if region else [])
    columns = [c for c in units.columns if c not in _HIDDEN]
    keyed = {"carrier": F.col("_carrier"), "region": F.col("_region") if region else F.lit(None).cast("string")}
    plan = plan_rules(units, columns, rules, "sum", keyed, constants=True)
    key_columns = [F.col("carrier").alias("_carrier")] + ([F.col(region).alias("_region")] if region else [])
    present = units.dropna(subset=keys)
    first = [F.min(ROW_ID).alias("_first")] if ROW_ID in units.columns else []
    grouped = present.groupBy(*key_columns).agg(*plan.aggregates, *first)
    if region and region_map is not None and rules.get("bus", rules.get("others")) == "region" and "bus" in plan.outputs:
        # Only the bus carries the short name; the mapping meets the aggregated rows, not the units.
        pairs = region_map.select(F.col("k").alias("_k"), F.col("short").alias("_short"))
        grouped = grouped.join(pairs, text.strip(F.col("_region")) == F.col("_k"), "left")
        plan.outputs["bus"] = F.coalesce("_short", text.strip(F.col("_region")))
    name = merged_name(F.col("_carrier"), F.col("_region") if region else None)
    return grouped.select(
        name.alias("name"),
        *[finish(c, value, defaults).alias(c) for c, value in plan.outputs.items()],
        *([F.col("_first").alias(ROW_ID)] if ROW_ID in units.columns else []),
    )


def name_clashes(units: DataFrame) -> DataFrame:
    """Names that different keys lead to; callers treat any row here as an error."""
    return units.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def membership(units: DataFrame, region_column: str | None = None) -> DataFrame:
    """(name, new_name): which aggregated unit each unit went into."""
    region = _region_key(units, region_column)
    present = units.where(F.col("carrier").isNotNull())
    if region:
        present = present.where(F.col(region).isNotNull())
    return present.select("name", merged_name(F.col("carrier"), F.col(region) if region else None).alias("new_name"))


def aggregate_generator_series(
    series: DataFrame, members: DataFrame, rules: Mapping[str, str] | None = None, default: str | None = None
) -> DataFrame:
    """Combine the series of the units behind each aggregated unit, by a rule per attribute.

    Unknown rules mean `mean`. Units without a series take no part; series of units that went nowhere vanish.
    """
    rules = dict(rules or {})
    fallback = default or rules.pop("others", "mean")
    mine = F.col("component") == "generators"
    value = None
    for attribute, rule in rules.items():
        expr = SERIES_RULES.get(rule, F.avg)("value")
        hit = F.col("attribute") == attribute
        value = F.when(hit, expr) if value is None else value.when(hit, expr)
    rest = SERIES_RULES.get(fallback, F.avg)("value")
    value = rest if value is None else value.otherwise(rest)
    folded = (
        series.where(mine)
        .join(members, "name")
        .groupBy("component", "attribute", F.col("new_name").alias("name"), "snapshot")
        .agg(value.alias("value"))
    )
    return series.where(~mine).unionByName(folded.select(*series.columns))


# --- facilities ---------------------------------------------------------------------------------


def facility_rollup(
    df: DataFrame, group_by: Sequence[str], agg_column: str = "p_nom", name_order: Sequence[str] | None = None
) -> DataFrame:
    """Sum one column per group; the name is the chosen key columns joined by `_`."""
    missing = [c for c in group_by if c not in df.columns]
    if missing:
        raise ValueError(f"no such grouping columns: {missing}")
    if agg_column not in df.columns:
        raise ValueError(f"no such column to add up: {agg_column!r}")
    name_columns = list(name_order or group_by)
    stray = [c for c in name_columns if c not in group_by]
    if stray:
        raise ValueError(f"name columns that are not grouping columns: {stray}")
    present = df.dropna(subset=list(group_by))
    return present.groupBy(*group_by).agg(total(agg_column).alias(agg_column)).select(
        text.joined_name(name_columns).alias("name"), *group_by, agg_column
    )
