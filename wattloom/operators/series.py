"""Operators on the long series table and on the snapshot dimension."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import temporal
from ..functions.rules import SERIES_RULES
from ..model import SERIES_COLUMNS, Network, scalar, total
from .scans import HOT_ROWS, filled, positions

SERIES_KEYS = ("component", "attribute", "name")
_EPOCH = "1970-01-01 00:00:00"


def epoch_seconds(ts: Column) -> Column:
    return temporal.seconds_between(F.lit(_EPOCH).cast("timestamp_ntz"), ts)


# --- shape --------------------------------------------------------------------------------------


def unpivot(wide: DataFrame, component: str, attribute: str, index: str = "snapshot") -> DataFrame:
    """One row per snapshot and name; a text index is parsed day first."""
    names = [c for c in wide.columns if c != index]
    long = wide.unpivot([F.col(index).alias("snapshot")], [F.col(f"`{c}`").cast("double").alias(c) for c in names], "name", "value")
    if dict(wide.dtypes)[index] == "string":
        long = long.withColumn("snapshot", temporal.parse_dayfirst(F.col("snapshot")))
    return long.select(
        F.lit(component).alias("component"),
        F.lit(attribute).alias("attribute"),
        "name",
        F.col("snapshot").cast("timestamp_ntz").alias("snapshot"),
        "value",
    )


def wide_export(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per name for a named, bounded set of names: the pivot needs no look at the data."""
    picked = series.where(F.col("name").isin(*names))
    # A (name, snapshot) pair is unique, so the maximum is the value.
    return picked.groupBy("snapshot").pivot("name", list(names)).agg(F.max("value"))


def name_slots(series: DataFrame, width: int = 1000) -> DataFrame:
    """(name, block, slot): every name of the series in blocks of `width`, in order."""
    names = series.select("name").distinct()
    at = positions(names, ["name"], F.substring("name", 1, 3), "_at")
    return at.select("name", F.floor(F.col("_at") / width).cast("int").alias("block"), (F.col("_at") % width).cast("int").alias("slot"))


def wide_blocks(series: DataFrame, slots: DataFrame) -> DataFrame:
    """(block, snapshot, values): one array per block and snapshot, so the plan does not grow with the names.

    `series` holds one attribute; a value lies at the slot of its name, and a name without a value there has null.
    """
    rows = series.join(slots, "name").groupBy("block", "snapshot").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_held")  # at most the names of a block
    )
    widths = slots.groupBy(F.col("block").alias("_block")).agg(F.max("slot").alias("_last"))
    joined = rows.join(widths, F.col("block") == F.col("_block"))
    values = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: F.try_element_at("_held", k))
    return joined.select("block", "snapshot", values.alias("values"))


def from_wide_blocks(blocks: DataFrame, slots: DataFrame, component: str, attribute: str) -> DataFrame:
    """The series rows of `wide_blocks`, one per name and snapshot of a block."""
    long = blocks.select("block", "snapshot", F.posexplode("values").alias("slot", "value")).join(slots, ["block", "slot"])
    return long.select(F.lit(component).alias("component"), F.lit(attribute).alias("attribute"), "name", "snapshot", "value")


def catalog(series: DataFrame) -> DataFrame:
    """(component, attribute, n_names): what exists, decided from the data."""
    return series.groupBy("component", "attribute").agg(F.countDistinct("name").alias("n_names"))


# --- fill ---------------------------------------------------------------------------------------


def forward_fill(series: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Last known value so far, per item in snapshot order; leading gaps stay."""
    return filled(series, SERIES_KEYS, "snapshot", "value", position=epoch_seconds(F.col("snapshot")), hot_rows=hot_rows)


# --- snapshots ----------------------------------------------------------------------------------


def snapshot_dimension(snapshots: DataFrame, weighting: float = 1.0) -> DataFrame:
    """(snapshot, pos, weighting) from a table with a `snapshot` column."""
    distinct = snapshots.select("snapshot").distinct()
    numbered = positions(distinct, ["snapshot"], F.to_date("snapshot"), "pos")
    return numbered.withColumn("weighting", F.lit(float(weighting)))


def renumber(snapshots: DataFrame) -> DataFrame:
    return positions(snapshots.drop("pos"), ["snapshot"], F.to_date("snapshot"), "pos").select(*snapshots.columns)


def first_snapshots(snapshots: DataFrame, n: int) -> DataFrame:
    return snapshots.where(F.col("pos") < n)


def limited_snapshots(snapshots: DataFrame, start: str | dt.datetime | None, count: int | None) -> DataFrame:
    """From the first snapshot at or after `start`, the next `count`; positions start again at 0."""
    if start is None and count is None:
        return snapshots
    if start is not None:
        snapshots = snapshots.where(F.col("snapshot") >= temporal.ntz(temporal.parse_dayfirst_literal(start)))
    snapshots = renumber(snapshots)
    return snapshots if count is None else snapshots.where(F.col("pos") < int(count))


def within(series: DataFrame, snapshots: DataFrame) -> DataFrame:
    return series.join(snapshots.select("snapshot"), "snapshot", "left_semi").select(*series.columns)


def limit_network(network: Network, start: str | dt.datetime | None = None, count: int | None = None) -> Network:
    if start is None and count is None:
        return network
    kept = limited_snapshots(network.snapshots, start, count)
    out = network.with_snapshots(kept)
    return out if network.series is None else out.with_series(within(network.series, kept))


def optimization_range(snapshots: DataFrame, start: int = 0, end: int | None = None, weights: int = 1) -> DataFrame:
    """Positions given at the original resolution, read on the resampled snapshots."""
    if weights > 1:
        start, end = start // weights, None if end is None else end // weights
    kept = snapshots.where(F.col("pos") >= start)
    return kept if end is None else kept.where(F.col("pos") < end)


def total_hours(snapshots: DataFrame) -> DataFrame:
    """One row: sum of the weightings, else count times the first step, else one hour."""
    first, second = (F.min(F.when(F.col("pos") == p, F.col("snapshot"))) for p in (0, 1))
    step = temporal.seconds_between(first, second) / F.lit(3600.0)
    counted = F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1)) * step).otherwise(F.lit(1.0))
    return snapshots.agg(F.coalesce(F.sum("weighting"), counted).alias("total_hours"))


def ordered_output(series: DataFrame) -> DataFrame:
    """Sorted for hand-off only; nothing inside the library depends on row order."""
    return series.orderBy("snapshot", *[k for k in SERIES_KEYS if k in series.columns])


# --- years --------------------------------------------------------------------------------------


def shift_year(df: DataFrame, base: int | None, target: int | None, column: str = "snapshot") -> DataFrame:
    """Move a year of data to another year, adding or dropping 29 February as the target needs it.

    The copy of 28 February comes from one `explode` in the same pass, not from a second scan.
    """
    if not base or not target or base == target:
        return df
    ts = F.col(column)
    if temporal.is_leap_year(base) and not temporal.is_leap_year(target):
        df = df.where(~temporal.is_feb29(ts))
    if not temporal.is_leap_year(base) and temporal.is_leap_year(target):
        days = F.when(temporal.is_feb28(ts), F.array(F.lit(28), F.lit(29))).otherwise(F.array(F.dayofmonth(ts)))
        return (
            df.withColumn("_day", F.explode(days))
            .withColumn(column, temporal.replace_date(ts, target, F.col("_day")))
            .select(*df.columns)
        )
    return df.withColumn(column, temporal.replace_date(ts, target))


def shift_network(network: Network, base: int | None, target: int | None) -> Network:
    """Series and snapshots alike."""
    if not base or not target or base == target:
        return network
    out = network
    if network.series is not None:
        out = out.with_series(shift_year(network.series, base, target))
    if network.snapshots is not None:
        out = out.with_snapshots(renumber(shift_year(network.snapshots, base, target)))
    return out


def base_year_rows(df: DataFrame, base: int, column: str = "snapshot") -> DataFrame:
    return df.where(temporal.in_year(F.col(column), base))


def monthly_to_target(df: DataFrame, base: int | None, target: int | None) -> tuple[DataFrame, DataFrame]:
    """Base-year rows moved to the target year, and the rows whose day the target year lacks."""
    if not base or not target:
        return df, df.limit(0)
    kept = base_year_rows(df, base)
    if base == target:
        return kept, kept.limit(0)
    moved = temporal.replace_date(F.col("snapshot"), target)
    accepted = kept.withColumn("_moved", moved).where(F.col("_moved").isNotNull())
    return accepted.withColumn("snapshot", F.col("_moved")).select(*df.columns), kept.where(moved.isNull())


# --- resampling ---------------------------------------------------------------------------------


def _anchor(snapshots: DataFrame) -> Column:
    """Midnight of the first day, as a scalar subquery."""
    return scalar(snapshots, F.date_trunc("day", F.min("snapshot")).cast("timestamp_ntz"))


def resampled_snapshots(snapshots: DataFrame, hours: int) -> DataFrame:
    """All buckets from the first to the last, empty ones included; weighting is the bucket width."""
    if hours <= 1:
        return snapshots
    bounds = snapshots.agg(
        F.date_trunc("day", F.min("snapshot")).cast("timestamp_ntz").alias("_anchor"),
        F.min("snapshot").alias("_first"),
        F.max("snapshot").alias("_last"),
    )
    first, last = (
        F.floor(temporal.seconds_between(F.col("_anchor"), F.col(c)) / F.lit(hours * 3600)) for c in ("_first", "_last")
    )
    spine = bounds.where(F.col("_first").isNotNull()).select(
        "_anchor", first.alias("_i0"), F.explode(F.sequence(first, last)).alias("_i")
    )
    return spine.select(
        F.timestamp_add("HOUR", (F.col("_i") * hours).cast("int"), F.col("_anchor")).alias("snapshot"),
        (F.col("_i") - F.col("_i0")).cast("bigint").alias("pos"),
        F.lit(float(hours)).alias("weighting"),
    )


def _rule_expr(rules: Mapping[tuple[str, str], str], default: str | None) -> Column:
    """Aggregate chosen by (component, attribute); only the aggregates some rule asks for are computed."""
    expr = None
    for (component, attribute), rule in rules.items():
        hit = (F.col("component") == component) & (F.col("attribute") == attribute)
        value = SERIES_RULES[rule]("value")
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    fallback = SERIES_RULES[default]("value") if default else F.lit(None)
    return fallback if expr is None else expr.otherwise(fallback)


def resample(
    series: DataFrame,
    snapshots: DataFrame,
    hours: int,
    rules: Mapping[tuple[str, str], str] | None = None,
    default: str | None = "mean",
) -> DataFrame:
    """Aggregate each series to `hours`-wide buckets counted from the first midnight.

    `rules` maps (component, attribute) to mean, sum, max, min or skip. Attributes without a rule take
    `default`; with no default they stay as they are, as do skipped ones. Buckets without rows come out
    as missing (zero under `sum`).
    """
    if hours <= 1:
        return series
    rules = dict(rules or {})
    active = {k: r for k, r in rules.items() if r in SERIES_RULES}
    key = F.struct("component", "attribute")

    def among(pairs) -> Column:
        return key.isin(*[F.struct(F.lit(c).alias("component"), F.lit(a).alias("attribute")) for c, a in pairs]) if pairs else F.lit(False)

    passive = [k for k in rules if k not in active]
    touched = ~among(passive) if default else among(list(active))
    work = series.where(touched)
    bucket = temporal.bucket_start(F.col("snapshot"), _anchor(snapshots), hours)
    placed = work.withColumn("snapshot", bucket)
    folded = placed.groupBy(*SERIES_KEYS, "snapshot").agg(_rule_expr(active, default).alias("value"))
    out = _with_empty_buckets(folded, resampled_snapshots(snapshots, hours), active, default)
    if not passive and default:
        return out
    return out.unionByName(series.where(~touched).select(*SERIES_COLUMNS))


def _with_empty_buckets(folded: DataFrame, buckets: DataFrame, rules: Mapping, default: str | None) -> DataFrame:
    """Add the buckets a series has no rows in.

    A row knows the next row of its series and the bucket that is due after its own; only where they differ, and before
    the first row, the buckets in between are listed. No series meets the calendar as a whole.
    """
    calendar = scalar(buckets, F.array_sort(F.collect_list("snapshot")))
    due = F.lead("snapshot").over(W.orderBy("snapshot"))  # one row per bucket
    known = buckets.select("snapshot", due.alias("_due"), F.lit(True).alias("_inside"))
    # Rows outside the calendar, or without a time, only tell that the series is there.
    at = F.coalesce("snapshot", F.lit(dt.datetime(1, 1, 1)).cast("timestamp_ntz"))
    own = W.partitionBy(*SERIES_KEYS).orderBy("_at")  # a row per bucket
    rows = folded.join(known, "snapshot", "left").withColumn("_at", at)
    rows = rows.withColumns({"_next": F.lead("_at").over(own), "_first": F.lag("_at").over(own).isNull()})
    # Only now, so that it does not travel.
    rows = rows.withColumn("_calendar", calendar)
    gap = F.col("_inside").isNull() | ~F.col("_next").eqNullSafe(F.col("_due"))
    none = F.array().cast("array<timestamp_ntz>")
    after = F.filter("_calendar", lambda b: (b > F.col("_at")) & (F.col("_next").isNull() | (b < F.col("_next"))))
    before = F.filter("_calendar", lambda b: b < F.col("_at"))
    missing = F.concat(F.when(F.col("_first"), before).otherwise(none), F.when(gap, after).otherwise(none))
    empty = F.when(_zero_rule(rules, default), F.lit(0.0))
    listed = F.transform(missing, lambda b: F.struct(b.alias("snapshot"), empty.alias("value")))
    here = F.array(F.struct(F.col("snapshot").cast("timestamp_ntz").alias("snapshot"), F.col("value").cast("double").alias("value")))
    both = F.concat(F.when(F.col("_inside"), here).otherwise(F.array().cast("array<struct<snapshot:timestamp_ntz,value:double>>")), listed)
    return rows.select(*SERIES_KEYS, F.explode(both).alias("_b")).select(*SERIES_KEYS, "_b.snapshot", "_b.value")


def _zero_rule(rules: Mapping, default: str | None) -> Column:
    expr = F.lit(default == "sum")
    for (component, attribute), rule in rules.items():
        hit = (F.col("component") == component) & (F.col("attribute") == attribute)
        expr = F.when(hit, F.lit(rule == "sum")).otherwise(expr)
    return expr


# --- dispatch -----------------------------------------------------------------------------------


def alias_series(series: DataFrame, source: str = "fuel_cost", target: str = "marginal_cost", component: str = "generators") -> DataFrame:
    """`target := source`, replacing an earlier target; source rows stay. One scan, copies by `explode`."""
    mine = F.col("component") == component
    kept = series.where(~(mine & (F.col("attribute") == target)))
    names = F.when(mine & (F.col("attribute") == source), F.array(F.lit(source), F.lit(target))).otherwise(F.array("attribute"))
    return kept.withColumn("attribute", F.explode(names)).select(*series.columns)


def _dispatched(series: DataFrame, generators: DataFrame, carriers: Sequence[str] | None) -> tuple[Column, DataFrame]:
    chosen = generators if carriers is None else generators.where(F.col("carrier").isin(*carriers))
    mine = (F.col("component") == "generators") & (F.col("attribute") == "p_max_pu")
    return mine, chosen.select("name", "carrier", "p_nom")


def fixed_dispatch(series: DataFrame, generators: DataFrame, carriers: Sequence[str] | None = None) -> DataFrame:
    """`p_set(t) = p_nom * p_max_pu(t)`; the availability rows used are replaced, and so are older `p_set` rows."""
    mine, chosen = _dispatched(series, generators, carriers)
    availability = series.where(mine)
    dispatch = availability.join(chosen, "name").select(
        "component", F.lit("p_set").alias("attribute"), "name", "snapshot", (F.col("p_nom") * F.col("value")).alias("value")
    )
    # A unit is replaced as a whole, so the anti joins need its name only.
    replaced = dispatch.select("component", "name").distinct()
    old = mine | ((F.col("component") == "generators") & (F.col("attribute") == "p_set"))
    left = series.where(old).join(replaced, ["component", "name"], "left_anti").select(*SERIES_COLUMNS)
    return series.where(~old).select(*SERIES_COLUMNS).unionByName(left).unionByName(dispatch)


def dispatch_summary(series: DataFrame, generators: DataFrame, carriers: Sequence[str] | None = None) -> DataFrame:
    """One row: mean of the unit means, overall maximum and minimum of the dispatch."""
    mine, chosen = _dispatched(series, generators, carriers)
    per_unit = (
        series.where(mine)
        .groupBy("name")
        .agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))
        .join(chosen, "name")
    )
    p = F.col("p_nom")
    high, low = F.greatest(p * F.col("max"), p * F.col("min")), F.least(p * F.col("max"), p * F.col("min"))
    return per_unit.agg(
        F.avg(p * F.col("mean")).alias("mean_dispatch"), F.max(high).alias("max_dispatch"), F.min(low).alias("min_dispatch")
    )


def dispatch_by_carrier(series: DataFrame, generators: DataFrame, carriers: Sequence[str] | None = None) -> DataFrame:
    """Units with a dispatch and their capacity, per carrier."""
    mine, chosen = _dispatched(series, generators, carriers)
    members = series.where(mine).select("name").distinct()
    return chosen.join(members, "name", "left_semi").groupBy("carrier").agg(
        F.count(F.lit(1)).alias("generators"), total("p_nom").alias("capacity")
    )


def clear_dispatch(series: DataFrame) -> DataFrame:
    return series.where(~((F.col("component") == "generators") & (F.col("attribute") == "p_set")))
