"""Exact medians and order statistics per group, for groups of any size.

Ordinary groups use the built-in exact `percentile`. Groups above `hot_rows` are not gathered: their
values are counted in buckets that keep the order of the numbers, the bucket holding the wanted rank is
found from those counts, and only its rows are looked at more finely. Three rounds leave at most a few
thousand distinct values per group, whatever its size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scans import HOT_ROWS, hot_groups, same_keys

_STEPS = 4096
_LOG_STEPS = 16
_ROUNDS = 3


def _first_digit(v: Column) -> Column:
    """Order-keeping bucket by magnitude: sixteen per power of two."""
    size = F.floor(F.log2(F.abs(v)) * _LOG_STEPS) + 20000
    return (
        F.when(v == 0, F.lit(0))
        .when(v == float("inf"), F.lit(100000))
        .when(v == float("-inf"), F.lit(-100000))
        .otherwise(F.signum(v).cast("bigint") * size)
        .cast("bigint")
    )


def _inner_digit(v: Column, lo: Column, hi: Column) -> Column:
    """Order-keeping bucket between the smallest and largest value seen; halves avoid overflow."""
    part = (v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    return F.coalesce(F.least(F.floor(part * _STEPS), F.lit(_STEPS - 1)), F.lit(0)).cast("bigint")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column]
) -> DataFrame:
    """(keys, n, one column per rank): the value at each 0-based rank.

    Ranks are expressions over the group size `n`. Nulls do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("which"), rank.cast("bigint").alias("k")) for name, rank in ranks.items()])
    state = sizes.select(*keys, "n", F.explode(wanted).alias("_w")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "n", F.col("_w.which").alias("_which"), F.col("_w.k").alias("_k")
    )
    left, right = [F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys]
    path: list[str] = []
    current = rows.withColumn("_d0", _first_digit(F.col("_v")))
    for depth in range(_ROUNDS):
        digit = f"_d{depth}"
        counts = current.groupBy(*keys, *path, digit).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        state = _holding(counts, state, keys, path, digit).select(
            *right,
            "n",
            "_which",
            (F.col("_k") - F.col("_before")).alias("_k"),
            *[F.col(f"_s{p}") for p in path],
            F.col(digit).alias(f"_s{digit}"),
            "_lo",
            "_hi",
        )
        path.append(digit)
        # Two ranks often share a bucket, hence the distinct: at most one row per group and rank.
        chosen = state.select(*right, *[F.col(f"_s{p}") for p in path], "_lo", "_hi").distinct()
        on = same_keys(left + [F.col(p) for p in path], right + [F.col(f"_s{p}") for p in path])
        current = current.join(chosen, on)
        if depth + 1 < _ROUNDS:
            finer = _inner_digit(F.col("_v"), F.col("_lo"), F.col("_hi"))
            current = current.withColumn(f"_d{depth + 1}", finer).select(*keys, "_v", *path, f"_d{depth + 1}")
        else:
            current = current.select(*keys, "_v", *path)
        state = state.drop("_lo", "_hi")
    # Equal values collapse before the last window, which therefore sees distinct values only.
    values = current.groupBy(*keys, *path, "_v").agg(F.count(F.lit(1)).alias("_c"))
    found = _holding(values, state, keys, path, "_v").select(*keys, "n", "_which", "_v")
    picks = [F.max(F.when(F.col("_which") == name, F.col("_v"))).alias(name) for name in ranks]
    return found.groupBy(*keys, "n").agg(*picks)


def _holding(
    counts: DataFrame, state: DataFrame, keys: Sequence[str], path: Sequence[str], by: str
) -> DataFrame:
    """Join each wanted rank to the bucket (or value) `by` that holds it."""
    upto = W.partitionBy(*keys, *path).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    on = same_keys(
        [F.col(c) for c in [*keys, *path]],
        [F.col(f"_k_{k}") for k in keys] + [F.col(f"_s{p}") for p in path],
    )
    return placed.join(state, on & (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c")))


def split_by_size(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of hot groups or None.

    Looks for hot groups right away, with a partially aggregated count of the keys: most data have none,
    and their plan should not carry the other branch.
    """
    hot = hot_groups(df, keys, hot_rows).select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    if hot.isEmpty():
        return df, None
    on = same_keys([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys])
    # Bounded by construction (see hot_groups), hence the hints.
    return df.join(F.broadcast(hot), on, "left_anti"), df.join(F.broadcast(hot), on, "left_semi")


def medians(df: DataFrame, keys: Sequence[str], value: str, alias: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, alias): the exact median of the known values of each group."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    usual, hot = split_by_size(known, keys, hot_rows)
    small = usual.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias(alias))
    if hot is None:
        return small
    n = F.col("n")
    picked = order_statistics(hot, keys, value, {"_m0": F.floor((n - 1) / 2), "_m1": F.floor(n / 2)})
    # Halves first, so that the midpoint of two huge numbers stays finite.
    return small.unionByName(picked.select(*keys, (F.col("_m0") / 2 + F.col("_m1") / 2).alias(alias)))
