"""Table hygiene: duplicate names, coordinate checks, distinct values, region expansion."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.geo import jitter_offset
from ..model import ROW_ID
from .scans import HOT_ROWS, numbered, salted_join

# The provinces that a mainland row stands for, and its usual label.
MAINLAND_PROVINCES = (
    "강원특별자치도",
    "경기도",
    "경상남도",
    "경상북도",
    "광주광역시",
    "대구광역시",
    "대전광역시",
    "부산광역시",
    "서울특별시",
    "세종특별자치시",
    "울산광역시",
    "인천광역시",
    "전라남도",
    "전북특별자치도",
    "충청남도",
    "충청북도",
)
MAINLAND_LABEL = "육지"


def duplicate_names(df: DataFrame, column: str = "name") -> DataFrame:
    """(name, n): names used more than once; outer white space and blanks do not count."""
    return (
        df.select(text.strip(F.col(column)).alias("name"))
        .where(F.col("name") != "")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def duplicate_positions(df: DataFrame, column: str = "name", order: str = ROW_ID) -> DataFrame:
    """(name, position): one row per occurrence of a duplicated name; nothing is gathered per name."""
    rows = df.select(text.strip(F.col(column)).alias("name"), F.col(order).alias("position"))
    return salted_join(rows, duplicate_names(df, column).select("name"), ["name"])


def unique_names(df: DataFrame, column: str = "name", order: str = ROW_ID, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every occurrence of a duplicated name gets `_1, _2, ...` in row order; all else is unchanged."""
    stripped = text.strip(F.col(column))
    repeated = duplicate_names(df, column).select(F.col("name").alias("_name"), F.lit(True).alias("_dup"))
    marked = salted_join(df.withColumn("_name", stripped), repeated, ["_name"], hot_rows, "left")
    unchanged = marked.where(F.col("_dup").isNull()).select(*df.columns)
    renamed = numbered(marked.where(F.col("_dup").isNotNull()), ["_name"], order, "_i", hot_rows=hot_rows)
    name = F.concat_ws("_", F.col("_name"), F.col("_i").cast("string"))
    return unchanged.unionByName(renamed.withColumn(column, name).select(*df.columns))


def unique_names_count(df: DataFrame, column: str = "name") -> DataFrame:
    """One row: how many rows `unique_names` would change (its dry run)."""
    return duplicate_names(df, column).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("modified"))


def all_same_coordinates(df: DataFrame) -> DataFrame:
    """One row: whether there is a known pair of coordinates and all of them are the same.

    Extremes tell this without collecting distinct values.
    """
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    same = (F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))
    return df.where(both).agg(F.coalesce(same, F.lit(False)).alias("all_same"))


def jitter(df: DataFrame, km: float = 1.0, key: str = ROW_ID, seed: int = 0) -> DataFrame:
    """Scatter known coordinates in a circle; repeatable, since the offsets hash the row's key."""
    dx, dy = jitter_offset(F.col(key), km, seed)
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return df.withColumns(
        {"x": F.when(both, F.col("x") + dx).otherwise(F.col("x")), "y": F.when(both, F.col("y") + dy).otherwise(F.col("y"))}
    )


def jitter_if_same(df: DataFrame, km: float = 1.0, key: str = ROW_ID, seed: int = 0) -> DataFrame:
    """`auto`: scatter only when all known coordinates are the same."""
    same = all_same_coordinates(df).scalar()
    moved = jitter(df.withColumns({"_x": F.col("x"), "_y": F.col("y")}), km, key, seed)
    return moved.withColumns(
        {"x": F.when(same, F.col("x")).otherwise(F.col("_x")), "y": F.when(same, F.col("y")).otherwise(F.col("_y"))}
    ).select(*df.columns)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): sorted distinct known values. One pass over all columns; the sort sees distinct values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("column", "value")
    )


def head_rows(df: DataFrame, eligible: Column, n: int = 10, order: str = ROW_ID) -> DataFrame:
    """The first eligible rows, for a dry run."""
    return df.where(eligible).orderBy(order).limit(n)


def concat_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def parse_mainland_labels(single: str | None = None, several: str | None = None) -> list[str]:
    """Labels from a comma-separated list, else the single one, else the usual one."""
    raw = several.split(",") if several else [MAINLAND_LABEL if single is None else single]
    labels = [" ".join(label.split()) for label in raw]
    return [label for label in labels if label] if several else labels


def expand_mainland(
    df: DataFrame,
    labels: Sequence[str] = (MAINLAND_LABEL,),
    provinces: Sequence[str] = MAINLAND_PROVINCES,
    column: str = "region",
) -> DataFrame:
    """A row of the mainland becomes one row per province; regions come out with tidy white space."""
    if column not in df.columns:
        raise KeyError(f"no column {column!r}")
    tidy = text.normalize_ws(F.col(column))
    targets = F.when(tidy.isin(*labels), F.array(*[F.lit(p) for p in provinces])).otherwise(F.array(tidy))
    return df.withColumn(column, F.explode(targets))
