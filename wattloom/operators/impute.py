"""Fill missing values of one column from groups, time windows, neighbours in row order or a regression."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..model import ROW_ID, scalar
from ..session import checkpointed
from .quantiles import medians, order_statistics, split_by_size
from .scans import HOT_ROWS, filled, positions, salted_join, same_keys

# Arrays of a group's values are only built below this size; larger groups go by order statistics.
LIST_ROWS = 100_000

METHODS = (
    "regression",
    "group_mean",
    "group_median",
    "forward_fill",
    "backward_fill",
    "recent_mean",
    "recent_median",
)


def fill_missing(
    df: DataFrame,
    target: str,
    groups: Sequence[str],
    method: str = "regression",
    non_negative: bool = True,
    predictors: Sequence[str] | None = None,
    time_window: int = 10,
    year_column: str | None = None,
    exclude_outliers: int = 0,
) -> DataFrame:
    """One entry point for all methods; validates the columns."""
    for column in [target, *groups]:
        if column not in df.columns:
            raise ValueError(f"no such column: {column!r}")
    if method == "regression":
        return fill_regression(df, target, groups, predictors, non_negative)
    if method in ("group_mean", "group_median"):
        return fill_group(df, target, groups, method.removeprefix("group_"), non_negative)
    if method in ("recent_mean", "recent_median"):
        how = method.removeprefix("recent_")
        return fill_recent(df, target, groups, how, non_negative, time_window, year_column, exclude_outliers)
    if method in ("forward_fill", "backward_fill"):
        return fill_neighbour(df, target, groups, method == "backward_fill", non_negative)
    raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")


def _clipped(value: Column, non_negative: bool) -> Column:
    # Not `greatest`, which would turn a missing fill into 0.
    return F.when(value < 0, F.lit(0.0)).otherwise(value) if non_negative else value


def _with_fill(df: DataFrame, target: str, keys: Sequence[str], fills: DataFrame, non_negative: bool) -> DataFrame:
    """Left join of one fill value per key; a null key finds nothing."""
    value = F.coalesce(F.col(target), _clipped(F.col("_fill"), non_negative))
    joined = salted_join(df, fills.select(*keys, "_fill"), keys, how="left")
    return joined.withColumn(target, value).select(*df.columns)


def fill_group(
    df: DataFrame, target: str, groups: Sequence[str], how: str = "mean", non_negative: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The group's mean or exact median; groups without a value stay missing."""
    if how == "mean":
        fills = df.groupBy(*groups).agg(F.avg(target).alias("_fill"))
    else:
        fills = medians(df, groups, target, "_fill", hot_rows)
    return _with_fill(df, target, groups, fills, non_negative)


# --- time windows -------------------------------------------------------------------------------


def _year_column(df: DataFrame, year_column: str | None) -> str:
    if year_column is not None:
        if year_column not in df.columns:
            raise ValueError(f"no such year column: {year_column!r}")
        return year_column
    found = [c for c in df.columns if "year" in c.lower()]
    if not found:
        raise ValueError("name the year column: no column name contains 'year'")
    return found[0]


def fill_recent(
    df: DataFrame,
    target: str,
    groups: Sequence[str],
    how: str = "mean",
    non_negative: bool = True,
    time_window: int = 10,
    year_column: str | None = None,
    exclude_outliers: int = 0,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Mean or median of the same group's known values within half the window either side of the row's year.

    With `exclude_outliers = k`, the k smallest and k largest values are left out when more than 2k exist.
    Works on (group, year) aggregates; only those meet the rows again. Leaving out as many values at
    both ends does not move a median, so trimming matters to the mean only.
    """
    year = _year_column(df, year_column)
    half = time_window // 2
    keys = [c for c in groups if c != year]
    rows = df.select(*keys, F.col(year).alias("_year"), F.col(target).alias("_v")).where(F.col("_year").isNotNull())
    rows = rows.dropna(subset=keys) if keys else rows.withColumn("_all", F.lit(1))
    names = keys or ["_all"]
    if how == "mean" and exclude_outliers <= 0:
        fills = _window_means(rows, names, half)
    else:
        trim = exclude_outliers if how == "mean" else 0
        usual, hot = split_by_size(rows, names, list_rows)
        fills = _window_lists(usual, names, half, how, trim)
        if hot is not None:
            bounded = how == "mean" and trim <= LIST_ROWS
            fills = fills.unionByName(_window_trims(hot, names, half, trim) if bounded else _window_ranks(hot, names, half, how, trim))
    if keys:
        return _with_fill(df, target, [*keys, year], fills.withColumnRenamed("_year", year), non_negative)
    return _with_fill(df, target, [year], fills.select(F.col("_year").alias(year), "_fill"), non_negative)


def _range(names: Sequence[str], half: int):
    return W.partitionBy(*names).orderBy("_year").rangeBetween(-half, half)


def _window_means(rows: DataFrame, names: Sequence[str], half: int) -> DataFrame:
    """Sums and counts per year first; the window then slides over years, not rows."""
    years = rows.groupBy(*names, "_year").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    w = _range(names, half)
    return years.select(*names, "_year", F.try_divide(F.sum("_s").over(w), F.sum("_n").over(w)).alias("_fill"))


def _window_lists(rows: DataFrame, names: Sequence[str], half: int, how: str, trim: int) -> DataFrame:
    """One array per group and year; the window joins the arrays of the years in reach."""
    years = rows.groupBy(*names, "_year").agg(F.collect_list("_v").alias("_vs"))
    values = F.array_sort(F.flatten(F.collect_list("_vs").over(_range(names, half))))
    out = years.select(*names, "_year", values.alias("_vs")).where(F.size("_vs") > 0)
    n = F.size("_vs")
    if how == "median":
        low, high = F.element_at("_vs", F.floor((n + 1) / 2).cast("int")), F.element_at("_vs", F.floor(n / 2).cast("int") + 1)
        return out.select(*names, "_year", (low / 2 + high / 2).alias("_fill"))
    kept = F.when(n > 2 * trim, F.slice("_vs", F.lit(trim + 1), n - 2 * trim)).otherwise(F.col("_vs"))
    mean = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v) / F.size(kept)
    return out.select(*names, "_year", mean.alias("_fill"))


# Rows of a task that are summarised together.
_SUMMARY_ROWS = 1 << 20


def _ends(table: pa.Table, keys: Sequence[str], trim: int) -> pa.RecordBatch:
    """Per key the `trim` smallest and largest values, and the sum and number of the others; of few values all are kept."""
    code = np.zeros(len(table), np.int64)
    for key in keys:
        found = table.column(key).combine_chunks().dictionary_encode()
        # Numbered anew after each column, so that the codes stay below the number of rows.
        code = np.unique(code * len(found.dictionary) + found.indices.to_numpy(), return_inverse=True)[1]
    v = table.column("_v").to_numpy()
    order = np.lexsort((v, code))
    v, code = v[order], code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    sizes = np.diff(np.r_[starts, len(v)])
    rank, size = np.arange(len(v)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)
    edge = (rank < trim) | (rank >= size - trim)
    offsets = np.r_[0, np.cumsum(np.add.reduceat(edge, starts, dtype=np.int64))].astype(np.int32)
    first = pa.array(order[starts])
    return pa.RecordBatch.from_arrays(
        [
            *(table.column(key).combine_chunks().take(first) for key in keys),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[edge])),
            pa.array(np.add.reduceat(np.where(edge, 0.0, v), starts)), pa.array(np.maximum(sizes - 2 * trim, 0)),
        ],
        names=[*keys, "_edges", "_rest", "_n"],
    )


def _window_trims(rows: DataFrame, names: Sequence[str], half: int, trim: int) -> DataFrame:
    """Means without the extremes for groups too large to hold: tasks send the extremes of a year and the sum of the rest.

    What is not among the extremes of its own rows is not among those of a window around them, so no row meets a window.
    """
    keys = [*names, "_year"]
    known = rows.where(F.col("_v").isNotNull()).select(*keys, F.col("_v").cast("double").alias("_v"))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= _SUMMARY_ROWS:
                yield _ends(pa.Table.from_batches(held), keys, trim)
                held = []
        if held:
            yield _ends(pa.Table.from_batches(held), keys, trim)

    schema = T.StructType([*(known.schema[k] for k in keys), *T._parse_datatype_string("_edges array<double>, _rest double, _n bigint").fields])
    parts = known.mapInArrow(summarised, schema).groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list("_edges"))).alias("_all"), F.sum("_rest").alias("_rest"), F.sum("_n").alias("_n")
    )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    size = F.size("_all")
    middle = F.when(size > 2 * trim, F.slice("_all", F.lit(trim + 1), size - 2 * trim)).otherwise(F.array().cast("array<double>"))
    ends = F.when(size > 2 * trim, F.concat(F.slice("_all", 1, trim), F.slice("_all", -trim, trim))).otherwise(F.col("_all"))
    years = parts.select(*keys, ends.alias("_edges"), (F.col("_rest") + total(middle)).alias("_rest"), (F.col("_n") + size).alias("_n"))
    # A year without a known value is a year to fill as well.
    years = rows.select(*keys).distinct().join(years, keys, "left")
    w = _range(names, half)
    near = years.select(
        *keys, F.array_sort(F.flatten(F.collect_list("_edges").over(w))).alias("_edges"), F.sum("_rest").over(w).alias("_rest"), F.sum("_n").over(w).alias("_n")
    ).where(F.col("_n") > 0)
    n, size = F.col("_n"), F.size("_edges")
    kept = F.when(n > 2 * trim, F.slice("_edges", F.lit(trim + 1), size - 2 * trim)).otherwise(F.col("_edges"))
    count = F.when(n > 2 * trim, n - 2 * trim).otherwise(n)
    return near.select(*keys, ((F.col("_rest") + total(kept)) / count).alias("_fill"))


def _window_ranks(rows: DataFrame, names: Sequence[str], half: int, how: str, trim: int) -> DataFrame:
    """The same for groups too large to hold: only years that need a fill unfold, and nothing is gathered."""
    needed = rows.where(F.col("_v").isNull()).select(*names, "_year").distinct()
    reach = needed.withColumn("_near", F.explode(F.sequence(F.col("_year") - half, F.col("_year") + half)))
    centred = (
        rows.where(F.col("_v").isNotNull())
        .withColumnRenamed("_year", "_near")
        .join(reach, [*names, "_near"])
        .select(*names, "_year", "_v")
    )
    keys = [*names, "_year"]
    n = F.col("n")
    if how == "median":
        picked = order_statistics(centred, keys, "_v", {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)})
        return picked.select(*keys, (F.col("_a") / 2 + F.col("_b") / 2).alias("_fill"))
    cut = F.when(n > 2 * trim, F.lit(trim)).otherwise(F.lit(0))
    bounds = order_statistics(centred, keys, "_v", {"_a": cut, "_b": n - 1 - cut}).withColumn("_cut", cut)
    bounds = bounds.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "n", "_a", "_b", "_cut")
    on = same_keys([F.col(k) for k in keys], [F.col(f"_b_{k}") for k in keys])
    v = F.col("_v")
    sums = (
        centred.join(bounds, on)
        .groupBy(*keys, "n", "_a", "_b", "_cut")
        .agg(
            F.coalesce(F.sum(F.when((v > F.col("_a")) & (v < F.col("_b")), v)), F.lit(0.0)).alias("_inner"),
            F.count(F.when(v <= F.col("_a"), 1)).alias("_le"),
            F.count(F.when(v >= F.col("_b"), 1)).alias("_ge"),
        )
    )
    # Copies of the bounding values that are not cut count with the bound itself.
    edges = (F.col("_le") - F.col("_cut")) * F.col("_a") + (F.col("_ge") - F.col("_cut")) * F.col("_b")
    mean = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        (F.col("_inner") + edges) / (F.col("n") - 2 * F.col("_cut"))
    )
    return sums.select(*keys, mean.alias("_fill"))


# --- neighbours in row order --------------------------------------------------------------------


def fill_neighbour(
    df: DataFrame, target: str, groups: Sequence[str], backward: bool = False, non_negative: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Previous (next) known value of the group in row order; then every negative value becomes 0.

    Rows without a group keep what they have.
    """
    out = filled(df.withColumn("_own", F.col(target)), groups, ROW_ID, target, backward, hot_rows=hot_rows)
    grouped = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups])
    out = out.withColumn(target, F.when(grouped, F.col(target)).otherwise(F.col("_own")))
    if non_negative:
        out = out.withColumn(target, F.when(F.col(target) < 0, F.lit(0.0)).otherwise(F.col(target)))
    return out.select(*df.columns)


# --- regression ---------------------------------------------------------------------------------


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): alphabetical rank from 0 of the distinct values."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    # Dealt by ranges of the values, so no task sorts all of them; written, so that both readers see the same ranges.
    dealt = checkpointed(values.repartitionByRange("value").withColumn("_range", F.spark_partition_id()))
    ranked = positions(dealt, ["value"], F.col("_range"), "code").drop("_range")
    return ranked.withColumn("code", F.col("code").cast("double"))


def _features(df: DataFrame, predictors: Sequence[str], target: str) -> tuple[DataFrame, list[str]]:
    """Numbers as they are; text by its rank among the values of the rows with a known target."""
    names = []
    known = df.where(F.col(target).isNotNull())
    for i, column in enumerate(predictors):
        name = f"_x{i}"
        names.append(name)
        if isinstance(df.schema[column].dataType, T.NumericType):
            df = df.withColumn(name, F.col(column).cast("double"))
        else:
            codes = label_codes(known, column).withColumnsRenamed({"value": f"_lv{i}", "code": name})
            df = df.join(codes, F.col(column).cast("string") == F.col(f"_lv{i}"), "left").drop(f"_lv{i}")
    return df, names


def normal_equations(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """One row with the moments of a least-squares fit: a single partially aggregated pass.

    Rows with a missing predictor do not take part.
    """
    columns = [*names, target]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    known = whole & F.col(target).isNotNull()
    seen = {c: F.when(known, F.col(c)) for c in columns}
    aggs = [F.count(F.when(known, 1)).alias("_n")]
    aggs += [F.avg(seen[c]).alias(f"m_{c}") for c in columns]
    aggs += [F.covar_pop(seen[a], seen[b]).alias(f"c_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(*aggs)


def solve(moments: Mapping[str, float], names: Sequence[str], target: str) -> tuple[list[float], float, float | None]:
    """(coefficients, intercept, R²) from the moments; the least-norm answer where the design is singular."""

    def cov(a: str, b: str) -> float:
        return moments[f"c_{a}_{b}"] if f"c_{a}_{b}" in moments else moments[f"c_{b}_{a}"]

    a = np.array([[cov(x, y) for y in names] for x in names], dtype=float)
    b = np.array([cov(x, target) for x in names], dtype=float)
    beta = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    intercept = moments[f"m_{target}"] - sum(float(k) * moments[f"m_{x}"] for k, x in zip(beta, names))
    spread = cov(target, target)
    return [float(k) for k in beta], float(intercept), float(beta @ b / spread) if spread else None


def fill_regression(
    df: DataFrame, target: str, groups: Sequence[str], predictors: Sequence[str] | None = None, non_negative: bool = True
) -> DataFrame:
    """Least squares over all rows with a known target, then a plain projection.

    The data are reduced to k x k moments on the cluster; only those reach the driver. The fit uses the rows with all
    predictors; rows that lack one get their group's mean, and so do all if fewer than two rows can be fitted.
    """
    chosen = [c for c in (groups if predictors is None else predictors) if c in df.columns]
    if not chosen:
        return fill_group(df, target, groups, "mean", non_negative)
    coded, names = _features(df, chosen, target)
    moments = normal_equations(coded, names, target).first().asDict()
    if moments["_n"] < 2:
        return fill_group(df, target, groups, "mean", non_negative)
    beta, intercept, _ = solve(moments, names, target)
    prediction = reduce(lambda acc, kx: acc + F.lit(kx[0]) * F.col(kx[1]), zip(beta, names), F.lit(intercept))
    value = F.coalesce(F.col(target), _clipped(prediction, non_negative))
    fitted = coded.withColumn("_fitted", value).select(*df.columns, "_fitted")
    means = df.groupBy(*groups).agg(F.avg(target).alias("_fill"))
    filled_rows = _with_fill(fitted, target, groups, means, non_negative)
    return filled_rows.withColumn(target, F.coalesce("_fitted", target)).select(*df.columns)


def regression_quality(df: DataFrame, target: str, predictor: str) -> DataFrame:
    """One row with slope, intercept and R² of a one-predictor fit."""
    coded, (name,) = _features(df, [predictor], target)
    return coded.agg(
        F.regr_slope(target, name).alias("slope"),
        F.regr_intercept(target, name).alias("intercept"),
        F.regr_r2(target, name).alias("r2"),
        F.regr_count(target, name).alias("n"),
    )


# --- report -------------------------------------------------------------------------------------


def imputation_stats(before: DataFrame, after: DataFrame, target: str, groups: Sequence[str], key: str = ROW_ID) -> DataFrame:
    """One row: rows, missing before, filled, still missing, range and mean of the fills, number of groups."""
    old = before.where(F.col(target).isNull()).select(F.col(key).alias("_key"))
    fills = after.join(old, F.col(key) == F.col("_key"), "left_semi").agg(
        F.count(target).alias("filled"), F.min(target).alias("filled_min"),
        F.max(target).alias("filled_max"), F.avg(target).alias("filled_mean"),
    )
    whole = fills.select(F.struct("*").alias("f")).scalar()
    keyed = before.dropna(subset=list(groups)).select(*groups).distinct()
    return before.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count(F.when(F.col(target).isNull(), 1)).alias("missing_before")
    ).select(
        "total_rows",
        "missing_before",
        whole["filled"].alias("filled"),
        (F.col("missing_before") - whole["filled"]).alias("remaining"),
        whole["filled_min"].alias("filled_min"),
        whole["filled_max"].alias("filled_max"),
        whole["filled_mean"].alias("filled_mean"),
        scalar(keyed, F.count(F.lit(1))).alias("group_count"),
    )
