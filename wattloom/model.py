"""The data model: component tables, one long series table and the snapshot dimension."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROW_ID = "_row_id"

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("component", T.StringType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("snapshot", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
    ]
)
SERIES_COLUMNS = SERIES_SCHEMA.fieldNames()

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("snapshot", T.TimestampNTZType()),
        T.StructField("pos", T.LongType()),
        T.StructField("weighting", T.DoubleType()),
    ]
)

# Attributes that carry whole numbers.
INTEGER_ATTRIBUTES = ("min_up_time", "min_down_time", "up_time_before", "down_time_before")

# Component tables a network may hold, and those that carry a carrier name.
COMPONENTS = (
    "generators",
    "storage_units",
    "stores",
    "loads",
    "lines",
    "links",
    "transformers",
    "buses",
    "shunt_impedances",
    "carriers",
)
CARRIER_COMPONENTS = ("generators", "loads", "storage_units", "stores", "links", "buses")


@dataclass(frozen=True)
class Network:
    """Component tables by name, the long series table and the snapshots. Operators return new ones."""

    components: Mapping[str, DataFrame]
    series: DataFrame | None = None
    snapshots: DataFrame | None = None
    rejects: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.components[name]

    def __contains__(self, name: str) -> bool:
        return name in self.components

    def with_components(self, **tables: DataFrame) -> "Network":
        return replace(self, components={**self.components, **tables})

    def with_series(self, series: DataFrame | None) -> "Network":
        return replace(self, series=series)

    def with_snapshots(self, snapshots: DataFrame | None) -> "Network":
        return replace(self, snapshots=snapshots)

    def with_rejects(self, **tables: DataFrame) -> "Network":
        return replace(self, rejects={**self.rejects, **tables})

    def map_components(self, fn: Callable[[str, DataFrame], DataFrame]) -> "Network":
        return replace(self, components={name: fn(name, df) for name, df in self.components.items()})

    def series_of(self, component: str, attribute: str) -> DataFrame:
        """The rows of one attribute; prunes partitions when the series table is stored by them."""
        return self.series.where((F.col("component") == component) & (F.col("attribute") == attribute))

    def has_series(self, component: str, attribute: str) -> bool:
        """One `LIMIT 1` probe: some overlays depend on whether an attribute has any series."""
        return self.series is not None and not self.series_of(component, attribute).isEmpty()


def with_row_id(df: DataFrame) -> DataFrame:
    """File order as an increasing, gap-tolerant id. Kept if the table already has one."""
    if ROW_ID in df.columns:
        return df
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere: Spark's max and avg let a NaN through, null they skip. Infinity stays."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def total(column: Column | str) -> Column:
    """Sum in which 'nothing to add' is zero, not null."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def scalar(df: DataFrame, expr: Column) -> Column:
    """One aggregate of a whole table as a scalar subquery: no join, and no action at plan time."""
    return df.agg(expr.alias("_scalar")).scalar()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition rows that are about to multiply.

    AQE sizes partitions by what goes into them; rows that each unfold to many need the full parallelism.
    A fixed number of partitions is one AQE leaves alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
