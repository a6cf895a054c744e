"""Rule, mapping and setting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..model import ROW_ID, with_row_id
from ..operators.loads import TOTAL_LABEL
from .tables import read_csv


def coerce(value):
    """Text from a settings table: TRUE/FALSE to a boolean, digits to a whole number, then to a decimal."""
    if not isinstance(value, str):
        return value
    if value.strip().upper() in ("TRUE", "FALSE"):
        return value.strip().upper() == "TRUE"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def read_settings(path: str) -> dict:
    """A YAML settings file as nested dictionaries."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def settings_dict(df: DataFrame, names: Sequence[str], key: str = "setting", value: str = "value") -> dict:
    """The settings called `names`; no others leave the cluster. Of repeated settings the last row counts."""
    wanted = _last(df.where(F.col(key).isin(*names)), key, value)
    return {r[key]: coerce(r[value]) for r in wanted.collect()}


def _last(df: DataFrame, key: str, value: str) -> DataFrame:
    rows = with_row_id(df)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, ROW_ID).alias(value))


def rules_frame(df: DataFrame) -> DataFrame:
    """(attribute, rule): the last row of each attribute; attributes without a rule are left out."""
    return _last(df, "attribute", "rule").where(F.col("rule").isNotNull())


def rules_dict(df: DataFrame, attributes: Sequence[str]) -> dict[str, str]:
    """attribute -> rule for the columns that exist, since rules steer planning; no other rules leave the cluster."""
    wanted = rules_frame(df.where(F.col("attribute").isin(*attributes)))
    return {r["attribute"]: r["rule"] for r in wanted.collect()}


def rules_list(df: DataFrame, attributes: Sequence[str]) -> list[dict]:
    """Resampling rules of the attributes that exist, as dictionaries."""
    return [r.asDict() for r in df.where(F.col("attribute").isin(*attributes)).collect()]


def carrier_attributes(df: DataFrame) -> DataFrame:
    """One row per carrier with numeric attribute columns; `carriers` is accepted as the key's name."""
    if "carriers" in df.columns and "carrier" not in df.columns:
        df = df.withColumnRenamed("carriers", "carrier")
    attributes = [c for c in df.columns if c not in ("carrier", "_row_id", "notes")]
    return df.select("carrier", *[F.col(c).cast("string").try_cast("double").alias(c) for c in attributes])


def attributes_frame(spark: SparkSession, attributes: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The same from a nested dictionary (YAML settings)."""
    names = sorted({a for values in attributes.values() for a in values})
    schema = "carrier string" + "".join(f", `{n}` double" for n in names)
    rows = [(c, *[None if v.get(n) is None else float(v[n]) for n in names]) for c, v in attributes.items()]
    return spark.createDataFrame(rows, schema)


def region_map(df: DataFrame) -> DataFrame:
    """(k, short): official and short name both lead to the short one; rows without a short name are skipped.

    Of rows with the same name the last counts.
    """
    tidy = _spellings(df).where(F.col("short") != "")
    pairs = tidy.select("at", F.explode(F.array("official", "short")).alias("k"), "short")
    return pairs.where(F.col("k") != "").groupBy("k").agg(F.max_by("short", "at").alias("short"))


def _spellings(df: DataFrame) -> DataFrame:
    rows = with_row_id(df)
    return rows.select(
        F.col(ROW_ID).alias("at"), text.strip(F.col("short")).alias("short"), text.strip(F.col("official")).alias("official")
    )


def directed_region_map(df: DataFrame, direction: str = "to_short") -> DataFrame:
    """(k, v) to the short or to the official names; both spellings are keys, and of repeated keys the last row counts."""
    for column in ("short", "official"):
        if column not in df.columns:
            raise ValueError(f"region map lacks the column {column!r}")
    if direction not in ("to_short", "to_official"):
        raise ValueError(f"unknown direction {direction!r}")
    target = direction.removeprefix("to_")
    pairs = _spellings(df).select("at", F.explode(F.array("official", "short")).alias("k"), F.col(target).alias("v"))
    return pairs.where(F.col("k").isNotNull() & F.col("v").isNotNull()).groupBy("k").agg(F.max_by("v", "at").alias("v"))


def read_region_map(spark: SparkSession, path: str | None = None, data: DataFrame | None = None) -> DataFrame:
    """The map from data in memory if there is any, else from a file, else empty."""
    if data is not None:
        return region_map(data)
    if path is None:
        return spark.createDataFrame([], "k string, short string")
    return region_map(read_csv(spark, path))


def demand_table(df: DataFrame, region_column: str = "province", mapping: DataFrame | None = None) -> DataFrame:
    """Demand by standard region name, without the total row."""
    from ..operators.columns import standardize_region

    rows = standardize_region(df, region_column, mapping)
    return rows.where(F.coalesce(F.col(region_column) != TOTAL_LABEL, F.lit(True)))
