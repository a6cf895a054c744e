"""Attribute overlays by carrier, and rescaling of static attributes after resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..model import INTEGER_ATTRIBUTES, Network, is_text, scalar


def overlay_attributes(df: DataFrame, carrier_attrs: DataFrame, skip: Sequence[str] = (), whole: Sequence[str] = ()) -> DataFrame:
    """Set attributes by carrier: the carrier's value, else the `default` row's, else what is there.

    `carrier_attrs` has one row per carrier and one column per attribute; `whole` are truncated to integers.
    """
    attributes = [c for c in carrier_attrs.columns if c != "carrier" and c not in skip]
    own = carrier_attrs.where(F.col("carrier") != "default").select(
        F.col("carrier").alias("_carrier"), *[F.col(a).alias(f"_own_{a}") for a in attributes]
    )
    # One scalar subquery for all defaults: a struct from the single `default` row.
    default_row = carrier_attrs.where(F.col("carrier") == "default")
    defaults = scalar(default_row, F.max(F.struct(*attributes))) if attributes else None
    joined = df.join(own, F.col("carrier") == F.col("_carrier"), "left")
    updates = {}
    for a in attributes:
        value = F.coalesce(F.col(f"_own_{a}"), defaults[a])
        if a in whole:
            value = value.cast("bigint")
        if a in df.columns:
            value = F.coalesce(value.cast("string") if is_text(df, a) else value, F.col(a))
        updates[a] = value
    return joined.withColumns(updates).select(*df.columns, *[a for a in attributes if a not in df.columns])


def overlay_generator_attrs(network: Network, carrier_attrs: DataFrame | None) -> Network:
    """Overlay on generators; `p_max_pu` is left alone once any generator has such a series."""
    if carrier_attrs is None:
        return network
    skip = ("p_max_pu",) if network.has_series("generators", "p_max_pu") else ()
    out = overlay_attributes(network["generators"], carrier_attrs, skip, INTEGER_ATTRIBUTES)
    return network.with_components(generators=out)


def overlay_storage_attrs(network: Network, carrier_attrs: DataFrame | None) -> Network:
    if carrier_attrs is None or "storage_units" not in network:
        return network
    return network.with_components(storage_units=overlay_attributes(network["storage_units"], carrier_attrs))


def _rescaled(
    df: DataFrame, attribute: str, rule: str, value, weights: int, default, scope: Column | None
) -> Column | None:
    """The new column for one rule; None leaves it as it is."""
    kind = df.schema[attribute].dataType
    current = F.col(attribute)
    if rule == "scale":
        return current * F.lit(weights)
    if rule == "fixed":
        return None if value is None else F.lit(value).cast(kind)
    if rule == "default":
        return None if default is None else F.lit(default).cast(kind)
    if rule in ("max", "min"):
        rows = df if scope is None else df.where(scope)
        return scalar(rows, (F.max if rule == "max" else F.min)(attribute))
    return None


def static_rescale(
    df: DataFrame, component: str, rules: Sequence[Mapping], weights: int, defaults: Mapping | None = None
) -> DataFrame:
    """Rules per attribute: `scale` by the weights, `fixed` value, component `default`, `skip`.

    Later rules see the result of earlier ones. Rules for series (`..._t`) and unknown attributes are ignored.
    """
    if weights <= 1:
        return df
    for rule in rules:
        attribute = rule["attribute"]
        if rule["component"] != component or attribute not in df.columns or rule["rule"] in ("max", "min"):
            continue
        new = _rescaled(
            df, attribute, rule["rule"], rule.get("value"), weights, (defaults or {}).get((component, attribute)), None
        )
        if new is not None:
            df = df.withColumn(attribute, new)
    return df


def static_rescale_by_carrier(
    df: DataFrame, component: str, rules: Sequence[Mapping], weights: int, defaults: Mapping | None = None
) -> DataFrame:
    """The carrier-aware form: rules for a carrier first, the rule without one for all other carriers.

    Adds `max` and `min`, which give every row in scope the extreme of that scope.
    """
    if weights <= 1:
        return df
    by_attribute: dict[str, dict] = {}
    for rule in rules:
        if rule["component"] == component and rule["attribute"] in df.columns:
            by_attribute.setdefault(rule["attribute"], {})[rule.get("carrier") or None] = rule
    updates = {}
    for attribute, scoped in by_attribute.items():
        named = [c for c in scoped if c is not None] if "carrier" in df.columns else []
        rest = ~F.coalesce(F.col("carrier").isin(*named), F.lit(False)) if named else None
        expr = None
        for carrier in [*named, None]:
            if carrier not in scoped:
                continue
            rule = scoped[carrier]
            scope = F.col("carrier") == carrier if carrier is not None else rest
            new = _rescaled(
                df, attribute, rule["rule"], rule.get("value"), weights, (defaults or {}).get((component, attribute)), scope
            )
            if new is None:
                continue
            hit = F.lit(True) if scope is None else scope
            expr = F.when(hit, new) if expr is None else expr.when(hit, new)
        if expr is not None:
            updates[attribute] = expr.otherwise(F.col(attribute))
    return df.withColumns(updates) if updates else df
