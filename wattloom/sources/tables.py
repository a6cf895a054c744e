"""Component folders, fact files, encodings and sinks."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import temporal
from ..model import COMPONENTS, ROW_ID, Network, nan_to_null, with_row_id
from ..operators import series as series_ops
from ..session import checkpointed, packed, written
from . import records, trees

# Encodings a conversion of Korean files tries, in order.
KOREAN_ENCODINGS = ("cp949", "euc-kr")

# Spark's names for the encodings that occur.
_SPARK_ENCODING = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "MS949", "euc-kr": "EUC-KR", "latin1": "ISO-8859-1"}

_D, _S, _I, _B = T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()

# Types of the columns known by name; any other column keeps the type Spark infers for it.
KNOWN_TYPES: dict[str, T.DataType] = {
    **{c: _S for c in (
        "name bus bus0 bus1 type carrier address country province region company membership market control "
        "cc_group components components_t component attribute aggregation snapshot status short official"
    ).split()},
    **{c: _D for c in (
        "x y v_nom p_nom s_nom r b length num_parallel terrain_factor efficiency efficiency_store marginal_cost "
        "p_min_pu p_max_pu p_set capital_cost state_of_charge_initial value demand e_sum_max e_sum_min"
    ).split()},
    **{c: _I for c in ("build_year", "close_year")},
    "cyclic_state_of_charge": _B,
}

# Texts that stand for a missing number.
_MISSING = ("", "nan", "na", "n/a", "null", "none")

REJECTS = "row_id bigint, column string, cell string"


def _names(header: Sequence[str]) -> list[str]:
    """Column names with repeats numbered `.1, .2, ...`."""
    seen: dict[str, int] = {}
    out = []
    for raw in header:
        name = raw.lstrip("﻿").strip()
        count = seen.get(name, 0)
        out.append(name if count == 0 else f"{name}.{count}")
        seen[name] = count + 1
    return out


def _in_file_order(df: DataFrame) -> DataFrame:
    """Add the row id. Spark packs large files first, so over several files the order follows path and position.

    The id is made of the file's place in the sorted list, the megabyte at which the split starts and the row's place
    inside its task, which ascends within a split.
    """
    if len(df.inputFiles()) < 2:
        return with_row_id(df)
    files = sorted(df.select(F.col("_metadata.file_path").alias("f")).distinct().toLocalIterator(), key=lambda r: r["f"])
    order = df.sparkSession.createDataFrame([(r["f"], i) for i, r in enumerate(files)], "_path string, _file bigint")
    columns = df.columns
    place = F.shiftleft(F.floor(F.col("_metadata.file_block_start") / F.lit(1 << 20)), 27)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 27) - 1))
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias("_at"), (place + inside).alias("_place"))
    rows = rows.join(F.broadcast(order), F.col("_at") == F.col("_path"))  # one row per file
    return rows.select(*[F.col(f"`{c}`") for c in columns], (F.shiftleft("_file", 47) + F.col("_place")).alias(ROW_ID))


def _parsed(column: str, kind: T.DataType) -> Column:
    """A text cell as its type, null where it does not parse. Whole numbers may be written with decimals."""
    cell = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return cell
    if isinstance(kind, T.BooleanType):
        return F.lower(F.trim(cell)).try_cast("boolean")
    if isinstance(kind, (T.IntegerType, T.LongType)):
        number = cell.try_cast("double")
        return F.when(number == F.rint(number), number.try_cast(kind.simpleString()))
    return cell.try_cast(kind.simpleString())


def _header(record: str) -> list[str]:
    cells = next(csv.reader([record], escapechar="\\"), [])
    return _names([c or f"_c{i}" for i, c in enumerate(cells)])


def _record_cells(spark: SparkSession, path: str | Sequence[str], encoding: str | Sequence[str]) -> tuple[list[str], DataFrame] | None:
    """Column names and the cells as text with their row id, from records found in the splits of the files."""
    lines = records.scanned_lines(spark, path, escape="\\")
    if isinstance(encoding, str):
        named = lines.select("path").distinct().withColumn("encoding", F.lit(encoding.lower()))
    else:
        named = checkpointed(records.file_encodings(lines, "line", encoding))
    found = records.decoded(records.records(lines), "record", named).select("path", trees.place().alias("place"), "record")
    found = packed(found)
    first = found.groupBy("path").agg(F.min("place").alias("first"), F.min_by("record", "place").alias("header"))
    # One row per file.
    first = first.withColumn("file", F.row_number().over(W.orderBy("path")) - 1)
    first = checkpointed(first.select(F.col("path").alias("_path"), "first", "header", "file"))
    head = first.orderBy("file").first()
    if head is None:
        return None
    names = _header(head["header"])
    kind = T.StructType([T.StructField(n, _S) for n in names]).toDDL()
    # One row per file, as many as the driver lists to read them, hence the hint.
    rows = found.join(F.broadcast(first), F.col("path") == F.col("_path")).where(F.col("place") > F.col("first"))
    cells = F.from_csv("record", F.lit(kind), {"ignoreLeadingWhiteSpace": "false", "maxCharsPerColumn": "-1"})
    rows = rows.select(cells.alias("c"), (F.shiftleft(F.col("file").cast("bigint"), 47) + F.col("place")).alias(ROW_ID))
    return names, written(rows.select(*[F.col(f"c.`{n}`") for n in names], ROW_ID), "cells")


def _line_cells(spark: SparkSession, path: str | Sequence[str], encoding: str) -> tuple[list[str], DataFrame] | None:
    """The same from files without quoted line breaks, as Spark splits them."""
    reader = spark.read.option("encoding", _SPARK_ENCODING.get(encoding, encoding)).option("ignoreLeadingWhiteSpace", False)
    header = reader.option("header", False).csv(path).first()
    if header is None:
        return None
    names = _names([h or f"_c{i}" for i, h in enumerate(header)])
    schema = T.StructType([T.StructField(n, _S) for n in names])
    return names, _in_file_order(reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path))


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str | Sequence[str] = "utf-8-sig",
    infer: bool = True,
    row_id: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """The rows of `read_csv_checked`; cells that do not parse are null."""
    return read_csv_checked(spark, path, encoding, infer, row_id, multi_line)[0]


def read_csv_checked(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str | Sequence[str] = "utf-8-sig",
    infer: bool = True,
    row_id: bool = True,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """CSV with a header: known columns typed by name, the rest inferred, missing as null, file order kept.

    Returns the rows and the cells that do not parse as (row_id, column, cell). Cells are read as text and then cast, so
    that `2015.0` is a year. The header is the first record of the first file; every file has one. Types of unknown columns
    cost one pass; switch `infer` off to read them as text. Several encodings are tried in order, per file; a file that
    none fits has no rows. With `multi_line` quoted cells may hold line breaks: records
    are found in the splits of the files (`records`). Long fact files, which have none, are read without.
    """
    if multi_line or not isinstance(encoding, str):
        found = _record_cells(spark, path, encoding)
    else:
        found = _line_cells(spark, path, encoding)
    if found is None:
        return spark.createDataFrame([], T.StructType()), spark.createDataFrame([], REJECTS)
    names, cells = found
    unknown = {n: F.col(f"`{n}`") for n in names if n not in KNOWN_TYPES}
    inferred = trees.inferred_types(cells, unknown) if infer else {}
    kinds = {n: KNOWN_TYPES.get(n, inferred.get(n, _S)) for n in names}
    wrong = [
        F.when(
            F.col(f"`{n}`").isNotNull() & ~F.lower(F.trim(F.col(f"`{n}`"))).isin(*_MISSING) & _parsed(n, k).isNull(),
            F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("cell")),
        )
        for n, k in kinds.items()
        if not isinstance(k, T.StringType)
    ]
    rejects = spark.createDataFrame([], REJECTS)
    if wrong:
        rejects = cells.select(F.col(ROW_ID).alias("row_id"), F.explode(F.array_compact(F.array(*wrong))).alias("w"))
        rejects = rejects.select("row_id", "w.column", "w.cell")
    kept = [] if not row_id or ROW_ID in names else [F.col(ROW_ID)]
    rows = cells.select(*[_parsed(n, k).alias(n) for n, k in kinds.items()], *kept)
    return nan_to_null(rows), rejects


def read_encoded_csv(spark: SparkSession, path: str, encoding: str | Sequence[str] = records.TRY_ENCODINGS) -> DataFrame:
    """CSV in a named encoding, or in the first of several that fits a file; without a name, those that files come in."""
    return read_csv(spark, path, encoding)


def read_network(spark: SparkSession, folder: str, encoding: str = "utf-8-sig") -> Network:
    """A folder of component CSVs, `<component>-<attribute>.csv` series files and `snapshots.csv`.

    `rejects` of the network holds, per component table, the cells that do not parse.
    """
    names = _listing(spark, folder)
    components, rejects, parts, snapshots = {}, {}, [], None
    for file in names:
        stem, path = file.removesuffix(".csv"), f"{folder.rstrip('/')}/{file}"
        if stem in COMPONENTS or stem.rstrip("s") + "s" in COMPONENTS:
            table = stem if stem in COMPONENTS else stem.rstrip("s") + "s"
            rows, rejects[table] = read_csv_checked(spark, path, encoding)
            components[table] = _named(rows)
        elif stem == "snapshots":
            snapshots = read_csv(spark, path, encoding, row_id=False)
        elif "-" in stem and stem.split("-", 1)[0] in COMPONENTS:
            component, attribute = stem.split("-", 1)
            parts.append(read_wide_series(spark, path, component, attribute, encoding))
    series = reduce(DataFrame.unionByName, parts) if parts else None
    if snapshots is not None:
        column = "snapshot" if "snapshot" in snapshots.columns else snapshots.columns[0]
        stamps = snapshots.select(temporal.parse_dayfirst(F.col(column).cast("string")).alias("snapshot"))
        snapshots = series_ops.snapshot_dimension(stamps)
    elif series is not None:
        snapshots = series_ops.snapshot_dimension(series)
    return Network(components, series, snapshots, rejects)


def _named(df: DataFrame) -> DataFrame:
    """The first column is the component name when none is called so."""
    if "name" in df.columns:
        return df
    return df.withColumnRenamed(df.columns[0], "name")


def _listing(spark: SparkSession, folder: str) -> list[str]:
    """CSV file names of a folder (a handful of component files), through Hadoop, so any file system works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in files if f.getPath().getName().endswith(".csv"))


def read_wide_series(
    spark: SparkSession,
    path: str | Sequence[str],
    component: str,
    attribute: str,
    encoding: str | Sequence[str] = "utf-8-sig",
    parts: bool = False,
) -> DataFrame:
    """Series rows of CSV files with a column per name, however many: the first cell of a row is its time, day first.

    Cells become rows by their position and meet the names of the header, which are rows as well, so the plan does not
    grow with the columns. With `parts` the files of a folder are one table, and only the first begins with a header.
    """
    lines = records.scanned_lines(spark, path)
    if isinstance(encoding, str):
        named = lines.select("path").distinct().withColumn("encoding", F.lit(encoding.lower()))
    else:
        named = checkpointed(records.file_encodings(lines, "line", encoding))
    found = records.decoded(records.records(lines), "record", named)
    table = F.regexp_replace("path", "/[^/]*$", "") if parts else F.col("path")
    place = F.struct("path", trees.place().alias("place")).alias("place")
    found = packed(found.select(table.alias("table"), place, records.cells(F.col("record")).alias("cells")))
    first = found.groupBy("table").agg(F.min("place").alias("place"))
    heads = found.join(first, ["table", "place"], "left_semi").select("table", F.posexplode("cells").alias("pos", "name"))
    heads = heads.withColumn("name", F.trim(F.coalesce("name", F.lit(""))))
    again = F.row_number().over(W.partitionBy("table", "name").orderBy("pos")) - 1
    numbered = F.when(F.col("again") > 0, F.concat_ws(".", "name", F.col("again").cast("string"))).otherwise(F.col("name"))
    heads = heads.withColumn("again", again).select("table", "pos", numbered.alias("name"))
    data = found.join(first, ["table", "place"], "left_anti")
    stamp = temporal.parse_dayfirst(F.get("cells", F.lit(0))).cast("timestamp_ntz")
    cells = data.select("table", stamp.alias("snapshot"), F.posexplode("cells").alias("pos", "cell")).where("pos > 0")
    long = cells.join(heads, ["table", "pos"])
    value = nan_to_null(long.select("name", "snapshot", F.col("cell").try_cast("double").alias("value")))
    return value.select(F.lit(component).alias("component"), F.lit(attribute).alias("attribute"), "name", "snapshot", "value")


def write_wide_series(series: DataFrame, out: str, width: int = 1000, index: str = "snapshot") -> DataFrame:
    """All names of one attribute as CSV with a column per name, in blocks of `width` names below `out/block=<k>`.

    Returns which column lies where, as (name, block, slot). The parts of a block are one table, see `read_wide_series`.
    """
    slots = checkpointed(series_ops.name_slots(series, width))
    blocks = series_ops.wide_blocks(series, slots)
    stamp = F.date_format("snapshot", "dd/MM/yyyy HH:mm:ss")
    rows = blocks.select("block", F.col("snapshot").alias("at"), F.concat(F.array(stamp), F.transform("values", lambda x: x.cast("string"))).alias("c"))
    names = slots.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", "name"))).alias("n"))
    heads = names.select("block", F.lit(None).cast("timestamp_ntz").alias("at"), F.concat(F.array(F.lit(index)), "n.name").alias("c"))
    ranged = heads.union(rows).repartitionByRange("block", F.col("at").asc_nulls_first())
    ranged = ranged.sortWithinPartitions("block", F.col("at").asc_nulls_first())
    ranged.select("block", records.csv_line(F.col("c")).alias("line")).write.mode("overwrite").partitionBy("block").text(out)
    return slots


def read_monthly(spark: SparkSession, path: str, base: int | None, target: int | None) -> tuple[DataFrame, DataFrame]:
    """(monthly facts at the target year, rows set aside): timestamps that do not parse or do not exist."""
    parsed, broken = _facts(spark, path)
    moved, lost = series_ops.monthly_to_target(parsed, base, target)
    return moved, broken.unionByName(lost)


def read_hourly(spark: SparkSession, path: str, base: int | None, target: int | None) -> tuple[DataFrame, DataFrame]:
    """(hourly facts at the target year with leap days handled, rows set aside)."""
    parsed, broken = _facts(spark, path)
    if base and target:
        parsed = series_ops.base_year_rows(parsed, base)
    return series_ops.shift_year(parsed, base, target), broken


def _facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = read_csv(spark, path, multi_line=False)
    parsed = temporal.parse_dayfirst(F.col("snapshot").cast("string"))
    good = raw.where(parsed.isNotNull()).withColumn("snapshot", parsed)
    bad = raw.where(parsed.isNull()).withColumn("snapshot", F.lit(None).cast("timestamp_ntz"))
    return good, bad


# --- conversions --------------------------------------------------------------------------------


def transcoded(
    spark: SparkSession, path: str, pattern: str = "*.csv", encodings: Sequence[str] = KOREAN_ENCODINGS, recursive: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(report, lines) of every file under a folder, by the first encoding that fits all of it.

    `report` has (path, encoding, n_chars, ok); `lines` has (path, place, line), the text of the files that some encoding
    fits. Files are read in splits and a file's text never lies in one cell: tasks judge their lines, the verdicts are put
    together per file, and the lines are then decoded. Line feeds are bytes of their own in all these encodings, so no
    character lies on a border. A line feed counts as a character; that of the last line, if it has one, does too.
    """
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"),
    )
    found = checkpointed(found)
    verdict = checkpointed(records.file_encodings(found, "line", encodings))
    # Rows ascend inside a split, and splits by their start.
    place = F.struct("block", "at").alias("place")
    lines = records.decoded(found.select("path", place, "line"), "line", verdict)
    feeds = found.groupBy("path").agg((F.max("size") - F.sum(F.octet_length("line"))).alias("feeds"))
    chars = lines.groupBy("path").agg(F.sum(F.length("line")).alias("chars"))
    report = verdict.join(feeds, "path").join(chars, "path", "left").select(
        "path", "encoding", F.when(F.col("encoding").isNotNull(), F.coalesce("chars", F.lit(0)) + F.col("feeds")).alias("n_chars"),
        F.col("encoding").isNotNull().alias("ok"),
    )
    return report, lines


def transcode_files(
    spark: SparkSession, path: str, pattern: str = "*.csv", encodings: Sequence[str] = KOREAN_ENCODINGS, recursive: bool = True
) -> DataFrame:
    """(path, encoding, n_chars, ok, content): the report of `transcoded` with the text of each file in one cell.

    For files that fit a cell; larger ones stay in lines (`transcoded`, `write_transcoded`).
    """
    report, lines = transcoded(spark, path, pattern, encodings, recursive)
    parts = lines.groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    text = parts.select("_path", F.array_join("l.line", "\n").alias("t"))
    # The last line feed, if there is one.
    whole = F.concat("t", F.repeat(F.lit("\n"), F.col("n_chars").cast("int") - F.length("t")))
    joined = report.join(text, F.col("path") == F.col("_path"), "left")
    return joined.select("path", "encoding", "n_chars", "ok", whole.alias("content"))


def write_transcoded(lines: DataFrame, folder: str, out: str, pattern: str = "*.csv") -> None:
    """The lines of `transcoded` as UTF-8 text below `out/file=<path below the folder>`, in order over the parts."""
    name = trees.table_name(F.col("path"), folder, pattern.removeprefix("*")).alias("file")
    ranged = lines.repartitionByRange("path", "place").sortWithinPartitions("path", "place")
    ranged.select(name, "line").write.mode("overwrite").partitionBy("file").text(out)


def csv_dir_to_tables(
    spark: SparkSession,
    folder: str,
    out: str,
    recursive: bool = False,
    encodings: Sequence[str] = records.TRY_ENCODINGS,
    combined: bool = False,
) -> DataFrame:
    """Each CSV of a folder as a Parquet table named by its path below the folder; returns (table, rows, cols) per file.

    Files with one header are written together, partitioned by table; `table_of` reads one of them back. With `combined`
    all files become one table of texts with the name as a column, whose own counts come first. The number of jobs
    follows the number of different headers, not of files.
    """
    tree = trees.read_tree(spark, folder, recursive, encodings=encodings)
    tree = trees.Tree(checkpointed(tree.files), checkpointed(tree.rows))
    if not trees.headers(tree):
        return trees.file_counts(tree).drop("encoding")
    counts = trees.file_counts(tree).drop("encoding")
    if not combined:
        trees.write_tables(tree, out, KNOWN_TYPES, _parsed)
        return counts
    together = trees.combined(tree)
    write_table(together, f"{out}/combined")
    total = counts.agg(F.lit("combined").alias("table"), F.sum("rows").alias("rows"), F.lit(len(together.columns)).cast("bigint").alias("cols"))
    return total.union(counts)


def table_of(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of one converted file, from the folder of all files with its header; other files are not read."""
    found = spark.read.parquet(f"{out}/files").where(F.col("table") == table).head()
    if found is None:
        raise ValueError(f"no table {table!r} below {out}")
    rows = spark.read.option("recursiveFileLookup", False).parquet(f"{out}/header={found['header']}")
    key = rows.columns[-1] if rows.columns else None
    return rows.where(F.col(key) == table).drop(key) if key in ("table", "_table") else rows


# --- sinks --------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Parquet by default; `csv` gets a header and UTF-8, `json` one object per line."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8")
    writer.options(**options).format(fmt).save(path)


def write_series(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by component and attribute, so that reading one attribute skips all others.

    Rows are dealt by ranges of component, attribute, name and time, cut by sampled row counts: few files per
    partition, and an attribute that dominates is written by as many tasks as its rows need.
    """
    spread = series.repartitionByRange("component", "attribute", "name", "snapshot")
    spread.write.mode(mode).partitionBy("component", "attribute").parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select("component", "attribute", "name", "snapshot", "value")


def write_network(network: Network, folder: str) -> None:
    """All tables of a network as Parquet."""
    for name, df in network.components.items():
        write_table(df, f"{folder}/{name}")
    if network.series is not None:
        write_series(network.series, f"{folder}/series")
    if network.snapshots is not None:
        write_table(network.snapshots, f"{folder}/snapshots")
