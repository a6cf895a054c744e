"""Registry of the per-attribute aggregation rules. A rule name becomes one aggregate expression."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..model import INTEGER_ATTRIBUTES, ROW_ID, is_text, total

# Rule names as they appear in rule tables.
MINIMUM = ("oldest", "smallest")
MAXIMUM = ("newest", "largest")
OMIT = ("remove", "ignore")
SERIES_RULES = {"sum": total, "mean": F.avg, "max": F.max, "min": F.min}

LEADER = "_leader"


@dataclass
class RulePlan:
    """Aggregates to compute and how each output column reads from them."""

    aggregates: list[Column] = field(default_factory=list)
    outputs: dict[str, Column] = field(default_factory=dict)


def lookup(rules: Mapping[str, object], column: str, default: str) -> object:
    return rules.get(column, rules.get("others", default))


def leader_row(columns: Iterable[str], weight: str = "p_nom") -> Column:
    """The wanted columns of the row with the largest weight, first in file order on ties.

    One struct for all columns: a single aggregation buffer and a single pass, however many are wanted.
    """
    wanted = F.struct(*[F.col(c).alias(c) for c in columns])
    return F.min_by(wanted, F.struct(F.col(weight).isNull(), -F.col(weight), F.col(ROW_ID)))


def plan_rules(
    df: DataFrame,
    columns: Iterable[str],
    rules: Mapping[str, object],
    default: str,
    keyed: Mapping[str, Column],
    constants: bool,
) -> RulePlan:
    """Turn rules into aggregates.

    `keyed` holds rules that read a grouping key ('carrier', 'region', 'cc_group'). With `constants`
    any other rule text is the value itself; without, it means the leader's value.
    """
    plan = RulePlan()
    led: list[str] = []
    for column in columns:
        rule = lookup(rules, column, default)
        if rule in OMIT:
            continue
        if rule in keyed:
            plan.outputs[column] = keyed[rule]
        elif rule in MINIMUM or rule in MAXIMUM or rule in ("sum", "mean"):
            if rule in ("sum", "mean") and is_text(df, column):
                raise TypeError(f"rule {rule!r} needs a numeric column, but {column!r} is text")
            alias = f"_agg_{column}"
            how = F.min if rule in MINIMUM else F.max if rule in MAXIMUM else total if rule == "sum" else F.avg
            plan.aggregates.append(how(F.col(column)).alias(alias))
            plan.outputs[column] = F.col(alias)
        elif rule == "p_nom" or not constants:
            led.append(column)
            plan.outputs[column] = F.col(LEADER)[column]
        else:
            plan.outputs[column] = F.lit(rule)
    if led:
        plan.aggregates.append(leader_row(led).alias(LEADER))
    return plan


def finish(column: str, value: Column, defaults: Mapping[str, object] | None) -> Column:
    """Whole-number attributes are truncated; a missing result takes the component default if one is given."""
    if column in INTEGER_ATTRIBUTES:
        value = value.cast("bigint")
    if defaults and column in defaults:
        value = F.coalesce(value, F.lit(defaults[column]))
    return value
