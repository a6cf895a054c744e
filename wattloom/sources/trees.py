"""Whole trees of CSV files as one table, whatever their headers: conversion, unique names and region names per file.

A row of the table is (table, place, names, cells): the file by its path below the folder, the place of the record in
it, the header and the cells. So ten thousand files with a thousand headers are one plan and a fixed number of jobs;
only typed output has a plan per different header.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text
from ..operators.scans import HOT_ROWS, numbered, salted_join
from ..session import checkpointed, packed
from . import records

ROWS = ["table", "place", "names", "cells"]


class Tree(NamedTuple):
    """`files` (table, encoding, names) has a row per file, `rows` (table, place, names, cells) one per record below a header.

    `encoding` is null for a file that no encoding fits, `names` for one without a record; neither has rows.
    """

    files: DataFrame
    rows: DataFrame


def place() -> Column:
    """The place of a record in its file: a line has at least one byte, so twice the split's start leaves room for all before."""
    return F.col("block") * 2 + F.col("at")


def table_name(path: Column, folder: str, suffix: str = ".csv") -> Column:
    """`a/b` for the file `a/b.csv` below the folder."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    inner = folder.rstrip("/").split("://", 1)[-1].split(":", 1)[-1] + "/"
    start = F.instr(plain, inner)
    below = F.when(start > 0, F.substring(plain, start + F.lit(len(inner)), F.length(plain))).otherwise(plain)
    return F.when(F.endswith(below, F.lit(suffix)), F.substring(below, F.lit(1), F.length(below) - len(suffix))).otherwise(below)


def numbered_names(names: Column) -> Column:
    """Column names without outer white space, repeats numbered `.1, .2, ...`."""
    plain = F.transform(names, lambda x: F.coalesce(text.strip(x), F.lit("")))

    def name(x: Column, i: Column) -> Column:
        count = F.size(F.filter(F.slice(plain, F.lit(1), i), lambda y: y == x))
        return F.when(count == 0, x).otherwise(F.concat(x, F.lit("."), count.cast("string")))

    return F.transform(plain, name)


def read_tree(
    spark: SparkSession,
    folder: str,
    recursive: bool = True,
    pattern: str = "*.csv",
    encodings: Sequence[str] = records.TRY_ENCODINGS,
) -> Tree:
    """All CSV files of a folder, each in the first encoding that fits it; files are split, also with quoted line breaks."""
    lines = records.scanned_lines(spark, folder, recursive, pattern)
    encoding = checkpointed(records.file_encodings(lines, "line", encodings))
    found = records.decoded(records.records(lines), "record", encoding)
    found = packed(found.select("path", place().alias("place"), records.cells(F.col("record")).alias("cells")))
    first = found.groupBy("path").agg(F.min("place").alias("first"), F.min_by("cells", "place").alias("names"))
    first = checkpointed(first.select(F.col("path").alias("_path"), "first", numbered_names(F.col("names")).alias("names")))
    # One row per file, as many as the driver lists to read them, hence the hint.
    rows = found.join(F.broadcast(first), F.col("path") == F.col("_path")).where(F.col("place") > F.col("first"))
    name = table_name(F.col("path"), folder, pattern.removeprefix("*")).alias("table")
    files = encoding.join(first, F.col("path") == F.col("_path"), "left").select(name, "encoding", "names")
    return Tree(files, rows.select(name, "place", "names", "cells"))


def file_counts(tree: Tree) -> DataFrame:
    """(table, encoding, rows, cols) of every file."""
    counts = tree.rows.groupBy(F.col("table").alias("_table")).agg(F.count(F.lit(1)).alias("n"))
    joined = tree.files.join(counts, F.col("table") == F.col("_table"), "left")
    return joined.select(
        "table", "encoding", F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("cols")
    )


# --- one column of all files --------------------------------------------------------------------


def _with_value(rows: DataFrame, column: str) -> DataFrame:
    """Add `_index` (0 if the file has no such column) and `_value`, the cell without outer white space."""
    index = F.array_position("names", F.lit(column)).cast("int")
    rows = rows.withColumn("_index", index)
    return rows.withColumn("_value", F.when(F.col("_index") > 0, text.strip(F.get("cells", F.col("_index") - 1))))


def _replaced(value: Column) -> Column:
    return F.transform("cells", lambda x, i: F.when(i == F.col("_index") - 1, value).otherwise(x))


def duplicate_names_tree(rows: DataFrame, column: str = "name") -> DataFrame:
    """(table, name, n): names used more than once in a file; blanks do not count."""
    named = _with_value(rows, column).where(F.col("_value") != "")
    return named.groupBy("table", F.col("_value").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_names_tree(rows: DataFrame, column: str = "name", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every occurrence of a name that a file uses twice gets `_1, _2, ...` in the order of the file; all else is unchanged."""
    repeated = duplicate_names_tree(rows, column).select("table", F.col("name").alias("_value"), F.lit(True).alias("_dup"))
    marked = salted_join(_with_value(rows, column), repeated, ["table", "_value"], hot_rows, "left")
    unchanged = marked.where(F.col("_dup").isNull()).select(*ROWS)
    renamed = numbered(marked.where(F.col("_dup").isNotNull()), ["table", "_value"], "place", "_i", hot_rows=hot_rows)
    name = F.concat_ws("_", F.col("_value"), F.col("_i").cast("string"))
    return unchanged.unionByName(renamed.withColumn("cells", _replaced(name)).select(*ROWS))


def unique_names_report(tree: Tree, column: str = "name") -> DataFrame:
    """(table, duplicates, modified) of every file: what `unique_names_tree` would change, without changing it."""
    found = duplicate_names_tree(tree.rows, column).groupBy(F.col("table").alias("_table")).agg(
        F.count(F.lit(1)).alias("duplicates"), F.sum("n").alias("modified")
    )
    joined = tree.files.select("table").join(found, F.col("table") == F.col("_table"), "left")
    return joined.select("table", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("duplicates", "modified")])


def map_region_tree(rows: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Values of a column found in the mapping replaced in all files; the rest is untouched."""
    pairs = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_to"))
    joined = _with_value(rows, column).join(pairs, F.col("_value") == F.col("_key"), "left")
    return joined.withColumn("cells", F.when(F.col("_to").isNull(), F.col("cells")).otherwise(_replaced(F.col("_to")))).select(*ROWS)


def unmapped_tree(rows: DataFrame, column: str, mapping: DataFrame, key: str) -> DataFrame:
    """(table, value): distinct non-empty values of each file that the mapping does not know."""
    values = _with_value(rows, column).where(F.col("_value") != "").select("table", F.col("_value").alias("value")).distinct()
    return values.join(mapping.select(F.col(key).alias("value")), "value", "left_anti").select("table", "value")


def map_region_tree_report(tree: Tree, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """(table, changed, unmapped) of every file: cells changed and distinct non-empty values without a mapping."""
    counts = _with_value(tree.rows, column).where(F.col("_value") != "").groupBy(F.col("table").alias("_table"), "_value")
    pairs = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_to"))
    joined = counts.agg(F.count(F.lit(1)).alias("n")).join(pairs, F.col("_value") == F.col("_key"), "left")
    changed = F.col("_to").isNotNull() & (F.col("_to") != F.col("_value"))
    found = joined.groupBy("_table").agg(
        F.coalesce(F.sum(F.when(changed, F.col("n"))), F.lit(0)).alias("changed"), F.count(F.when(F.col("_key").isNull(), 1)).alias("unmapped")
    )
    joined = tree.files.select("table").join(found, F.col("table") == F.col("_table"), "left")
    return joined.select("table", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("changed", "unmapped")])


# --- output -------------------------------------------------------------------------------------


def write_tree(tree: Tree, rows: DataFrame, out: str) -> None:
    """All files as CSV below `out/table=<table>`, in order over their parts; the header is the first line of the first part."""
    heads = tree.files.where("names IS NOT NULL").select("table", F.lit(-1).cast("bigint").alias("place"), F.col("names").alias("cells"))
    lines = heads.union(rows.select("table", "place", "cells")).withColumn("line", records.csv_line(F.col("cells")))
    ranged = lines.repartitionByRange("table", "place").sortWithinPartitions("table", "place")
    ranged.select("table", "line").write.mode("overwrite").partitionBy("table").text(out)


# Numbers as type inference knows them.
_WHOLE = r"^[+-]?\d+$"
_NUMBER = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Inf|-?Infinity)$"


def inferred_types(cells: DataFrame, columns: dict[str, Column]) -> dict[str, T.DataType]:
    """The narrowest type that all known cells of a column fit: int, bigint, double, boolean, else text; one pass over all."""
    if not columns:
        return {}

    def all_fit(test: Column, cell: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(cell.isNotNull(), F.coalesce(test, F.lit(False)))), F.lit(False))

    tests = []
    for cell in columns.values():
        whole = F.rlike(cell, F.lit(_WHOLE))
        tests.append(
            F.array(
                all_fit(whole & cell.try_cast("int").isNotNull(), cell), all_fit(whole & cell.try_cast("bigint").isNotNull(), cell),
                all_fit(F.rlike(cell, F.lit(_NUMBER)), cell), all_fit(F.lower(cell).isin("true", "false"), cell),
            )
        )
    found = cells.agg(F.array(*tests)).head()[0]
    kinds = (T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType())
    return {n: next((k for k, fits in zip(kinds, f) if fits), T.StringType()) for n, f in zip(columns, found)}


def typed(rows: DataFrame, names: Sequence[str], known: dict[str, T.DataType], parsed) -> DataFrame:
    """The rows of the files with this header as (_table, _place, one column per name): known types, else inferred ones."""
    same = rows.where(F.col("names") == F.array(*[F.lit(n) for n in names]))
    cells = {n: F.get("cells", F.lit(i)) for i, n in enumerate(names)}
    kinds = inferred_types(same, {n: c for n, c in cells.items() if n not in known})
    own = [F.col("table").alias("_table"), F.col("place").alias("_place")]
    texts = same.select(*own, *[c.alias(n) for n, c in cells.items()])
    return texts.select("_table", "_place", *[parsed(n, known.get(n) or kinds[n]).alias(n) for n in names])


def headers(tree: Tree) -> list[tuple[str, ...]]:
    """The different headers of a tree."""
    found = tree.files.where("names IS NOT NULL").select("names").distinct().collect()  # a row per different header
    return sorted(tuple(r.names) for r in found)


def write_tables(tree: Tree, out: str, known: dict[str, T.DataType], parsed) -> None:
    """Files with one header as one Parquet table `out/header=<k>`, partitioned by file; `out/files` has the k of each file."""
    kinds = headers(tree)
    spark = tree.files.sparkSession
    numbers = spark.createDataFrame([(k, list(names)) for k, names in enumerate(kinds)], "header int, names array<string>")
    tree.files.join(numbers, "names").select("table", "header").write.mode("overwrite").parquet(f"{out}/files")
    for k, names in enumerate(kinds):
        rows = typed(tree.rows, names, known, parsed)
        key, order = (c if c not in names else f"_{c}" for c in ("table", "place"))
        spread = rows.withColumnsRenamed({"_table": key, "_place": order}).repartitionByRange(key, order).sortWithinPartitions(key, order)
        writer = spread.drop(order).write.mode("overwrite")
        # A table partitioned by nothing has no files, so not even its columns would be known.
        (spread.drop(key, order).write.mode("overwrite") if rows.isEmpty() else writer.partitionBy(key)).parquet(f"{out}/header={k}")


def combined(tree: Tree) -> DataFrame:
    """One table of all files as text, with the file as `table`; a column that a file lacks is null."""
    parts = []
    for names in headers(tree):
        same = tree.rows.where(F.col("names") == F.array(*[F.lit(n) for n in names]))
        cells = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names) if n != "table"]
        parts.append(same.select("table", *cells))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
