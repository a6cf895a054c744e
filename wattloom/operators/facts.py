"""Match monthly and hourly fact rows to components and lay them over the snapshots."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.temporal import month_start
from ..model import SERIES_COLUMNS, scalar, spread
from .columns import active_only
from .scans import filled, salted_join

# Aggregation levels of a fact are generator, national and province. Where several match anything, the
# last one in this order counts.


def national_facts(facts: DataFrame, national_region: str) -> DataFrame:
    return facts.where((F.col("aggregation") == "national") & (F.col("region") == national_region))


def match_national(facts: DataFrame, items: DataFrame, national_region: str) -> DataFrame:
    """Facts of the whole country to items of the same carrier."""
    rows = national_facts(facts, national_region).drop("region", "name")
    matched_items = salted_join(items.select("component", "carrier", "name"), rows, ["component", "carrier"])
    return matched_items.select("component", "carrier", *[c for c in rows.columns if c not in ("component", "carrier")], "name")


def match_province(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts of a province to its items of the same carrier; exact text, missing never matches."""
    rows = facts.where(F.col("aggregation") == "province").drop("name")
    return _by_region(rows, items)


def _by_region(rows: DataFrame, items: DataFrame, keep: bool = False) -> DataFrame:
    places = items.select("component", "name", "carrier", F.col("province").alias("region")).where(F.col("region") != "")
    joined = salted_join(places, rows, ["component", "carrier", "region"])
    return joined if keep else joined.drop("region")


def _folded(rows: DataFrame, keys: Sequence[str], fold: Mapping[str, Column] | None) -> DataFrame:
    """One row per key, level and snapshot with the aggregates of its facts; without `fold`, the facts themselves."""
    if fold is None:
        return rows
    return rows.groupBy(*keys, "aggregation", "snapshot").agg(*[c.alias(name) for name, c in fold.items()])


def match_generator(facts: DataFrame, items: DataFrame, fold: Mapping[str, Column] | None = None) -> DataFrame:
    """Facts by item name; an item no fact names falls back to its province. Facts without names match nothing.

    Every fact of a province meets every item that falls back to it. With `fold` (name -> aggregate of fact columns, such
    as a count, sum or maximum) the facts of a key and snapshot are aggregated before items multiply them, and an item
    has one row per attribute and snapshot; whoever groups further combines these.
    """
    if "name" not in facts.columns:
        none = match_province(facts, items).limit(0)
        return _folded(none, ["component", "carrier", "name", "attribute"], fold)
    rows = facts.where(F.col("aggregation") == "generator")
    name_key, place_key = ["component", "carrier", "name"], ["component", "carrier", "region"]
    by_name = _folded(rows, [*name_key, "attribute"], fold).join(items.select(*name_key), name_key)
    by_name = by_name.drop("region")
    # Which items fall back is settled per item and attribute, before their facts multiply the rows.
    mark = F.coalesce(F.concat(F.lit("="), F.col("attribute")), F.lit("")).alias("_mark")  # a missing attribute is one too
    offered = rows.select(*place_key, "attribute", mark).distinct()
    named = rows.select("component", "attribute", "carrier", "name").where(F.col("name").isNotNull()).distinct()
    open_items = _by_region(offered, items, keep=True).join(named, ["component", "attribute", "carrier", "name"], "left_anti")
    placed = _folded(rows.drop("name"), [*place_key, "attribute"], fold).withColumn("_mark", mark)
    by_place = salted_join(open_items.drop("attribute"), placed, [*place_key, "_mark"]).drop("region", "_mark")
    return by_name.unionByName(by_place, allowMissingColumns=True)


def matched(
    facts: DataFrame, items: DataFrame, national_region: str, mode: str = "replace", fold: Mapping[str, Column] | None = None
) -> DataFrame:
    """(component, attribute, name, snapshot, value, aggregation): the facts each item takes, after precedence.

    `replace`: per attribute the last level that matches anything supplies all values. `merge`: per item
    and attribute the closest level that matches it does (generator, then province, then national).
    With `fold` the aggregates of `match_generator` stand for the value.
    """
    keyed = keyed_facts(facts, national_region)
    chosen = assigned(keyed, items, mode)
    rows = salted_join(chosen, _folded(keyed, KEY, fold), KEY)
    return rows.select("component", "attribute", "name", "snapshot", *(fold or ["value"]), "aggregation")


# A fact's key: what it must have in common with an item. Unused parts are empty text.
KEY = ["component", "attribute", "kind", "carrier", "place", "item"]


def keyed_facts(facts: DataFrame, national_region: str) -> DataFrame:
    """Facts under the keys they may match by, in one pass; a generator fact has a key by name and one by place."""

    def key(kind: str, place, item):
        return F.struct(F.lit(kind).alias("kind"), place.alias("place"), item.alias("item"))

    empty, region = F.lit(""), F.col("region")
    kinds = F.when(F.col("aggregation") == "province", F.array(key("province", region, empty)))
    kinds = kinds.when(
        (F.col("aggregation") == "national") & (region == national_region), F.array(key("national", empty, empty))
    )
    if "name" in facts.columns:
        by_name, by_place = key("name", empty, F.col("name")), key("place", region, empty)
        kinds = kinds.when(F.col("aggregation") == "generator", F.array(by_name, by_place))
    rows = facts.withColumn("_k", F.explode(kinds))
    # Every kind but the national one needs its text.
    named = (F.col("_k.kind") == "national") | (F.concat(F.col("_k.place"), F.col("_k.item")) != "")
    return rows.where(named).select(
        "component", "attribute", "_k.kind", "carrier", "_k.place", "_k.item", "aggregation", "snapshot", "value"
    )


_STRENGTH = {"national": 1, "province": 2, "place": 3, "name": 4}
_LEVEL_ORDER = {"place": 0, "name": 0, "national": 1, "province": 2}


def _by_kind(values: dict[str, int]):
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("kind"))


def assigned(keyed: DataFrame, items: DataFrame, mode: str = "replace") -> DataFrame:
    """(key, name): the one key per item and attribute that supplies its values.

    Works on distinct keys and on items; the time dimension stays out of it.
    """
    keys = keyed.select(*KEY).distinct()
    place = F.coalesce(F.col("province"), F.lit(""))
    empty = F.lit("")
    offers = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), p.alias("place"), i.alias("item"))
            for kind, p, i in (
                ("national", empty, empty),
                ("province", place, empty),
                ("place", place, empty),
                ("name", empty, F.col("name")),
            )
        ]
    )
    offered = items.select("component", "carrier", "name", F.explode(offers).alias("_o")).select(
        "component", "_o.kind", "carrier", "_o.place", "_o.item", "name"
    )
    # All items of a carrier offer its one national key. Keys are distinct under more columns than the join uses, so both
    # sides are shuffled for it and AQE can split that key's items.
    found = offered.join(keys, ["component", "kind", "carrier", "place", "item"])
    if mode == "replace":
        # A handful of attributes: their last level travels as a map, so the matches are filtered in place.
        label = F.concat_ws("/", "component", "attribute")
        last = found.groupBy(label.alias("k")).agg(F.max(_by_kind(_LEVEL_ORDER)).alias("v"))
        lookup = scalar(last, F.map_from_entries(F.collect_list(F.struct("k", "v"))))
        # Written as a difference: an equality of one side's columns with the other's would become a join key, and a
        # broadcast does not wait for a subquery in its key.
        found = found.where(F.try_element_at(lookup, label) - _by_kind(_LEVEL_ORDER) == 0)
    best = found.groupBy("component", "attribute", "name").agg(F.max_by(F.struct("kind", "carrier", "place", "item"), _by_kind(_STRENGTH)).alias("_b"))
    return best.select("component", "attribute", "_b.kind", "_b.carrier", "_b.place", "_b.item", "name")


def normalized_facts(facts: DataFrame) -> DataFrame:
    """Active rows with the component column under its model name."""
    active = active_only(facts) if "status" in facts.columns else facts
    return active.withColumnRenamed("components", "component") if "components" in active.columns else active


def duplicate_facts(rows: DataFrame, keys: Sequence[str], period: Callable = month_start, counts: str | None = None) -> DataFrame:
    """Key and period pairs with more than one value; these cannot be laid over the snapshots.

    `counts` names the column of folded rows that says how many facts a row stands for.
    """
    n = F.count(F.lit(1)) if counts is None else F.sum(counts)
    return rows.groupBy(*keys, period(F.col("snapshot")).alias("period")).agg(n.alias("n")).where(F.col("n") > 1)


def _by_period(rows: DataFrame, keys: Sequence[str], period: Callable) -> DataFrame:
    """One row per key and period, with the number of facts that fell on it."""
    return rows.groupBy(*keys, period(F.col("snapshot")).alias("period")).agg(
        F.max("value").alias("value"), F.count(F.lit(1)).alias("n")
    )


def _unambiguous(counted: DataFrame) -> DataFrame:
    return counted.where(F.col("n") == 1).drop("n")


def lay_monthly(keyed: DataFrame, chosen: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every snapshot gets its month's value, carried forward over months without one.

    Filling happens per fact key and month, long before items and snapshots multiply the rows: all
    items of a key and all snapshots of a month share a value.
    """
    months = snapshots.groupBy(month_start(F.col("snapshot")).alias("period")).agg(
        F.collect_list("snapshot").alias("_at")
    )
    counted = _by_period(keyed, KEY, month_start)
    calendar = scalar(months, F.collect_list("period"))
    grid = counted.select(*KEY).distinct().select(*KEY, F.explode(calendar).alias("period"))
    placed = grid.join(_unambiguous(counted), [*KEY, "period"], "left")
    number = F.year("period") * 12 + F.month("period")
    by_month = filled(placed, KEY, "period", "value", position=number).join(months, "period")
    return (
        salted_join(spread(chosen, "name"), by_month, KEY)
        .select("component", "attribute", "name", F.explode("_at").alias("snapshot"), "value")
    )


def lay_hourly(keyed: DataFrame, chosen: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Exact timestamps, no fill; every item gets a row for every snapshot, put together per fact key."""
    counted = _by_period(keyed, KEY, lambda c: c)
    days = snapshots.groupBy(F.to_date("snapshot").alias("_day")).agg(F.collect_list("snapshot").alias("_at"))
    calendar = scalar(days, F.collect_list("_day"))
    grid = (
        spread(counted.select(*KEY).distinct(), *KEY)
        .select(*KEY, F.explode(calendar).alias("_day"))
        .join(days, "_day")
        .select(*KEY, F.explode("_at").alias("period"))
    )
    dense = grid.join(_unambiguous(counted), [*KEY, "period"], "left")
    return salted_join(chosen, dense, KEY).select(
        "component", "attribute", "name", F.col("period").alias("snapshot"), "value"
    )


def replace_attributes(series: DataFrame | None, new: DataFrame) -> DataFrame:
    """New attributes take the place of old ones as a whole."""
    if series is None:
        return new
    fresh = new.select("component", "attribute").distinct()
    return series.join(fresh, ["component", "attribute"], "left_anti").select(*SERIES_COLUMNS).unionByName(new)


def apply_facts(
    series: DataFrame | None,
    facts: DataFrame,
    items: DataFrame,
    snapshots: DataFrame,
    national_region: str,
    monthly: bool,
    mode: str = "replace",
) -> tuple[DataFrame, DataFrame]:
    """(series with the new attributes, rejected key-period pairs)."""
    keyed = keyed_facts(normalized_facts(facts), national_region)
    chosen = assigned(keyed, items, mode)
    lay = lay_monthly if monthly else lay_hourly
    rejects = duplicate_facts(keyed, KEY, month_start if monthly else (lambda c: c))
    return replace_attributes(series, lay(keyed, chosen, snapshots)), rejects
