"""Ordered scans inside groups (fill, numbering) that stay parallel when one group is huge.

A plain window sorts a whole group in one task. Here groups above `hot_rows` are cut into chunks along
the order column; each chunk is scanned on its own, and what a chunk needs from those before it comes
from a summary with one row per chunk. Groups below the bound form a single chunk, so the usual case is
one shuffle and one window. Rows with a null key belong to no group; they are scattered and left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOT_ROWS = 1_000_000
_CHUNK = "_chunk"


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of two key tuples. Plain equality, so that a join can use a partitioning by the keys."""
    return reduce(lambda a, b: a & b, [x == y for x, y in zip(left, right)])


def keyless(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int, *extra: Column) -> DataFrame:
    """Groups with more than `hot_rows` rows. At most rows / hot_rows of them exist, however skewed."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *extra).where(F.col("_n") > hot_rows)


def _with_chunk(df: DataFrame, keys: Sequence[str], position: Column, hot_rows: int) -> DataFrame:
    """Add `_chunk`: 0 in ordinary groups, about four chunks per `hot_rows` in hot ones."""
    placed = df.withColumn("_p", position)
    grouped = placed.dropna(subset=list(keys))
    hot = hot_groups(grouped, keys, hot_rows, F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_n", "_lo", "_hi")
    # Bounded by construction (see hot_groups), hence the hint.
    joined = placed.join(
        F.broadcast(hot), same_keys([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys]), "left"
    )
    width = F.greatest((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") * 4 / F.lit(hot_rows)), F.lit(1e-9))
    chunk = F.when(keyless(keys), F.pmod(F.xxhash64("_p"), F.lit(4096))).otherwise(
        F.coalesce(F.floor((F.col("_p") - F.col("_lo")) / width), F.lit(0))
    )
    joined = joined.withColumns({_CHUNK: chunk, "_hot": F.col("_n").isNotNull()})
    return joined.drop("_p", "_n", "_lo", "_hi", *[f"_h_{k}" for k in keys])


def _carry(df: DataFrame, keys: Sequence[str], summary: Column, carried: Column) -> DataFrame:
    """One row per chunk with what the chunks before it hand over."""
    per_chunk = df.groupBy(*keys, _CHUNK).agg(summary.alias("_s"))
    return per_chunk.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.col(_CHUNK).alias("_c_chunk"), carried.alias("_carry")
    ).where(F.col("_carry").isNotNull())


def _attach(df: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    left = [F.col(k) for k in [*keys, _CHUNK]]
    right = [F.col(f"_c_{k}") for k in keys] + [F.col("_c_chunk")]
    return df.join(carry, same_keys(left, right), "left")


def filled(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    backward: bool = False,
    position: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace a missing `value` by the nearest known one before it (after it with `backward`).

    `order` must be unique within a group; `position` is its numeric form if it is not a number.
    """
    place = F.col(order) if position is None else position
    chunked = _with_chunk(df, keys, place, hot_rows)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    over_chunks = W.partitionBy(*keys)
    inside = W.partitionBy(*keys, _CHUNK)
    # Backward goes down the order: a frame that starts at the row is evaluated anew for each row, one that ends there grows.
    if backward:
        summary, frame, inside = F.min_by(value, known), over_chunks.orderBy(F.desc(_CHUNK)), inside.orderBy(F.desc(order))
    else:
        summary, frame, inside = F.max_by(value, known), over_chunks.orderBy(_CHUNK), inside.orderBy(order)
    local = F.last(value, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    before = F.last("_s", ignorenulls=True).over(frame.rowsBetween(W.unboundedPreceding, -1))
    # Chunk 0 of an ordinary group is alone and needs nothing, so only hot groups reach the summary.
    carry = _carry(chunked.where("_hot"), keys, summary, before)
    scanned = chunked.withColumn("_local", local)
    result = F.when(keyless(keys), F.col(value)).otherwise(F.coalesce("_local", "_carry"))
    return _attach(scanned, keys, carry).withColumn(value, result).select(*df.columns)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    alias: str,
    position: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based rank of each row inside its group."""
    place = F.col(order) if position is None else position
    chunked = _with_chunk(df, keys, place, hot_rows)
    before = F.sum("_s").over(W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1))
    carry = _carry(chunked.where("_hot"), keys, F.count(F.lit(1)), before)
    scanned = chunked.withColumn("_local", F.row_number().over(W.partitionBy(*keys, _CHUNK).orderBy(order)))
    return (
        _attach(scanned, keys, carry)
        .withColumn(alias, (F.col("_local") + F.coalesce("_carry", F.lit(0))).cast("bigint"))
        .select(*df.columns, alias)
    )


def positions(df: DataFrame, order: Sequence[str | Column], chunk: Column, alias: str) -> DataFrame:
    """0-based position of each row in the whole table, without sorting the table in one task.

    `chunk` must grow with `order`. Rows are ranked inside their chunk; the one-task window only sees
    one row per chunk.
    """
    marked = df.withColumn("_part", chunk)
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(
        F.col("_part").alias("_at"),
        F.coalesce(
            F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        marked.withColumn("_rank", local)
        .join(starts, F.col("_part").eqNullSafe(F.col("_at")))
        .withColumn(alias, (F.col("_start") + F.col("_rank") - 1).cast("bigint"))
        .select(*df.columns, alias)
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, how: str = "inner"
) -> DataFrame:
    """Join (`inner` or `left`) in which `left` may repeat a key without bound and `right` holds a bounded number of rows per key.

    A key with more than `hot_rows` rows on the left is split by a salt, and only such a key's rows on the
    right are copied, once per salt. Rows with a null key meet nothing and are scattered. All others join as usual.
    """
    hot = hot_groups(left.dropna(subset=list(keys)), keys, hot_rows).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts")
    )
    on = same_keys([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys])
    drop = ["_salts", *[f"_h_{k}" for k in keys]]
    scatter = F.xxhash64(*[F.col(c) for c in left.columns if c not in keys])
    spread = F.when(keyless(keys), F.pmod(scatter, F.lit(1 << 20)).cast("int"))
    spread = spread.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(scatter, F.col("_salts")).cast("int"))
    # Bounded by construction (see hot_groups), hence the hints.
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", spread).drop(*drop)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    copied = right.join(F.broadcast(hot), on, "left").withColumn("_salt", copies).drop(*drop)
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
