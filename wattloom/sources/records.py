"""CSV records from the splits of their files.

A quoted cell may hold line breaks, so which lines start a record depends on all text before them. Here no file is read
in one task. Every task goes through the lines of its splits under both assumptions, that a split starts outside or
inside a quoted cell, and keeps what each line leads to. A split then is a function from one state to the next (always
the same state, or the state as it came, or its opposite), and functions of splits are composed by windows over one row
per split. Lines of records that go over several lines, and only those, are then brought together by record, as far as they are not
in one task anyway.

Lines end with a line feed; a carriage return before it at the end of a record is not kept. Bytes stay as they are until
the encoding of a file is known: the first of a list in which all its lines decode, a verdict that tasks give line by
line. This holds for encodings in which the bytes of quote, comma and line feed mean nothing else, as in UTF-8, the
Korean code pages and Latin 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import packed

# Encodings that readers try, in order.
TRY_ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin1")

_UTF8 = ("utf-8-sig", "utf-8")
_BOM = b"\xef\xbb\xbf"
_LINES = "path string, block long, at long, line binary, outside struct<inside: boolean, start: long, after: boolean>, inside struct<inside: boolean, start: long, after: boolean>"
_SPLIT = ["path", "block"]
_STATES = ["outside", "inside"]
# Lines of one record that a task holds; those of a longer one are brought together by record.
_HELD_LINES = 100_000
_PARTS = "path string, rblock long, rstart long, block long, at long, line binary, done boolean"

# A quoted cell from after its opening quote; quotes inside are doubled, or follow a backslash.
_CLOSE = {'"': re.compile(rb'[^"]*(?:""[^"]*)*"(?!")'), "\\": re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)}


def ends_inside(line: bytes, inside: bool, escape: str = '"') -> bool:
    """Whether a line ends inside a quoted cell."""
    close, at = _CLOSE[escape], 0
    while True:
        if inside or line.startswith(b'"', at):
            end = close.match(line, at if inside else at + 1)
            if end is None:
                return True
            at, inside = end.end(), False
        at = line.find(b',"', at)
        if at < 0:
            return False
        at += 1


def _states(lines: list[bytes], quoted: np.ndarray, at: np.ndarray, state: bool, start: int, escape: str):
    """Per line, whether it starts inside a quoted cell, where its record starts, and whether it ends inside one."""
    before, done = np.empty(len(lines), bool), 0
    for k in quoted:
        before[done : k + 1] = state
        state, done = ends_inside(lines[k], state, escape), k + 1
    before[done:] = state
    begun = np.maximum.accumulate(np.where(before, -1, at))
    return before, np.where(begun < 0, start, begun), np.r_[before[1:], state]


def scanned_lines(
    spark: SparkSession, path: str | Sequence[str], recursive: bool = False, pattern: str | None = None, escape: str = '"'
) -> DataFrame:
    """The lines of files by path, split and place, with what they lead to if their split starts outside or inside."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    plain = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, states = None, 0, []
        for batch in batches:
            if not len(batch):
                continue
            paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lines = batch.column(2).to_pylist()
            quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
            new = [k for k in range(len(lines)) if k == 0 or blocks[k] != blocks[k - 1] or paths[k] != paths[k - 1]]
            for low, high in zip(new, [*new[1:], len(lines)]):
                if (paths[low], blocks[low]) != current:
                    current, place, states = (paths[low], blocks[low]), 0, [(False, -1), (True, -1)]
                    if blocks[low] == 0 and lines[low].startswith(_BOM):
                        lines[low] = lines[low][3:]
                at = place + np.arange(high - low)
                hits = np.flatnonzero(quoted[low:high])
                found = [_states(lines[low:high], hits, at, *s, escape) for s in states]
                states = [(bool(after[-1]), int(start[-1])) for _, start, after in found]
                place += high - low
                names = ["inside", "start", "after"]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(at),
                        pa.array(lines[low:high], pa.binary()),
                        *(pa.StructArray.from_arrays([pa.array(x) for x in f], names=names) for f in found),
                    ],
                    names=["path", "block", "at", "line", "outside", "inside"],
                )

    # Record starts are kept as distances, which are small and pack well.
    found = plain.mapInArrow(scan, _LINES)
    far = {c: F.when(F.col(f"{c}.start") >= 0, (F.col("at") - F.col(f"{c}.start"))).cast("int") for c in _STATES}
    flat = [x for c in _STATES for x in (F.col(f"{c}.inside").alias(f"{c}0"), far[c].alias(f"{c}1"), F.col(f"{c}.after").alias(f"{c}2"))]
    kept = packed(found.select(*_SPLIT, "at", "line", *flat))
    states = [
        F.struct(F.col(f"{c}0").alias("inside"), F.coalesce(F.col("at") - F.col(f"{c}1"), F.lit(-1)).cast("long").alias("start"), F.col(f"{c}2").alias("after")).alias(c)
        for c in _STATES
    ]
    return kept.select(*_SPLIT, "at", "line", *states)


def split_starts(lines: DataFrame) -> DataFrame:
    """(path, block, record_block, record_start) of the splits that start inside a quoted cell, with the record it is in."""
    ends = lines.groupBy(*_SPLIT).agg(F.max_by(F.struct("outside", "inside"), "at").alias("e"))
    ends = ends.select(*_SPLIT, F.col("e.outside").alias("o"), F.col("e.inside").alias("i"))
    fixed = F.col("o.after") == F.col("i.after")
    flip = (F.col("o.after") & ~F.col("i.after")).cast("int")
    order = W.partitionBy("path").orderBy("block")  # one row per split
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("flips", F.sum(flip).over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct(F.col("o.after").alias("state"), "flips")), ignorenulls=True).over(before)
    since = F.coalesce(F.lag("flips").over(order), F.lit(0)) - F.coalesce(F.col("last.flips"), F.lit(0))
    ends = ends.withColumn("last", last).withColumn("odd", since % 2 == 1)
    ends = ends.withColumn("starts_inside", F.coalesce("last.state", F.lit(False)) != F.col("odd"))
    begun = F.when(F.col("starts_inside"), F.col("i.start")).otherwise(F.col("o.start"))
    record = F.when(begun >= 0, F.struct(F.col("block").alias("record_block"), begun.alias("record_start")))
    ends = ends.withColumn("record", F.last(record, ignorenulls=True).over(before))
    return ends.where("starts_inside").select(*_SPLIT, "record.record_block", "record.record_start")


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of records, joined (`done`) where all of a record follow each other; the others as they are.

    Which are joined does not depend on the batches, nor on whether records of one line are among the rows.
    """
    held: pa.Table | None = None  # the lines so far of a record that goes on in the next batch
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        at, inside, after = (table.column(c).to_numpy() for c in ("at", "inside", "after"))
        same = inside[1:] & (at[1:] == at[:-1] + 1)
        for c in ("path", "rblock", "rstart", "block"):
            column = table.column(c)
            same &= pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy()
        starts = np.flatnonzero(np.r_[True, ~same])
        stops = np.r_[starts[1:], len(table)]
        done = ~inside[starts] & ~after[stops - 1] & (stops - starts < _HELD_LINES)
        open_end = not inside[starts[-1]] and after[-1] and len(table) - starts[-1] < _HELD_LINES
        held = table.slice(starts[-1]) if open_end else None
        left = ~np.repeat(done, stops - starts)
        if open_end:
            left[starts[-1] :] = False
        yield _parts(table.filter(pa.array(left)), False)
        # Lines of the finished records, and where each record ends among them.
        lines = table.column("line").filter(pa.array(np.repeat(done, stops - starts))).combine_chunks()
        ends = pa.array(np.r_[0, np.cumsum((stops - starts)[done])].astype(np.int32))
        whole = pc.binary_join(pa.ListArray.from_arrays(ends, lines), b"\n")
        heads = table.take(pa.array(starts[done]))
        yield _parts(heads.set_column(heads.schema.get_field_index("line"), "line", whole), True)
    if held is not None:
        yield _parts(held, False)


def _parts(table: pa.Table, done: bool) -> pa.RecordBatch:
    columns = [table.column(c).combine_chunks() for c in ("path", "rblock", "rstart", "block", "at", "line")]
    return pa.RecordBatch.from_arrays([*columns, pa.array([done] * len(table), pa.bool_())], names=["path", "rblock", "rstart", "block", "at", "line", "done"])


def records(lines: DataFrame) -> DataFrame:
    """(path, block, at, record) for every record; block and at order the records of a file. Blank lines are left out."""
    inside = split_starts(lines).select(*[F.col(c).alias(f"_{c}") for c in _SPLIT], "record_block", "record_start")
    # One row per split at most, fewer than the driver lists to read the files, hence the hint: lines stay where they are.
    rows = lines.join(F.broadcast(inside), (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")), "left")
    line = F.when(F.col("_path").isNotNull(), F.col("inside")).otherwise(F.col("outside"))
    rows = rows.select(*_SPLIT, "at", "line", line.alias("s"), "record_block", "record_start")
    here = F.col("s.start") >= 0
    rows = rows.select(
        "path",
        F.when(here, F.col("block")).otherwise(F.col("record_block")).alias("rblock"),
        F.when(here, F.col("s.start")).otherwise(F.col("record_start")).alias("rstart"),
        "block", "at", "line", F.col("s.inside").alias("inside"), F.col("s.after").alias("after"),
    )
    single = rows.mapInArrow(_joined_lines, _PARTS).where("done").select(*_SPLIT, "at", F.col("line").alias("record"))
    # What is left are lines of records that go on in another split or task. One record becomes one row anyway.
    several = rows.where("inside OR after").mapInArrow(_joined_lines, _PARTS).where("NOT done")
    several = several.select("path", "rblock", "rstart", F.struct("block", "at", F.col("line").alias("l")).alias("part"))
    joined = several.groupBy("path", "rblock", "rstart").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    feed, text = F.unhex(F.lit("0A")), F.col("parts.l")
    joined = joined.select(
        "path", F.col("rblock").alias("block"), F.col("rstart").alias("at"),
        F.aggregate(F.slice(text, 2, F.size(text)), F.element_at(text, 1), lambda a, b: F.concat(a, feed, b)).alias("record"),
    )
    last = F.expr("substring(record, length(record), 1) = X'0D'")
    trimmed = F.when(last, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    return single.union(joined).withColumn("record", trimmed).where(F.length("record") > 0)


def file_encodings(rows: DataFrame, column: str, encodings: Sequence[str] = TRY_ENCODINGS) -> DataFrame:
    """(path, encoding): the first encoding in which all rows of a file decode; null if there is none."""
    order = list(dict.fromkeys("utf-8" if e in _UTF8 else e for e in encodings))
    text = F.col(column).cast("string")
    ascii_only = F.octet_length(text) == F.length(text)
    unclear = rows.where(~ascii_only | ~F.is_valid_utf8(text)).select("path", F.col(column).alias("line"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed: dict[str, int] = {}
            for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = failed.get(path, 0)
                for k, encoding in enumerate(order):
                    if not bits >> k & 1 and not _decodes(line, encoding):
                        bits |= 1 << k
                failed[path] = bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(failed.keys(), pa.string()), pa.array(failed.values(), pa.int64())], names=["path", "failed"]
            )

    found = unclear.mapInArrow(judge, "path string, failed long").groupBy("path").agg(F.bit_or("failed").alias("failed"))
    fits = F.lit(None).cast("string")
    for k, encoding in reversed(list(enumerate(order))):
        name = next(e for e in encodings if e == encoding or encoding == "utf-8" and e in _UTF8)
        fits = F.when(F.coalesce("failed", F.lit(0)).bitwiseAND(F.lit(1 << k)) == 0, F.lit(name)).otherwise(fits)
    paths = rows.select("path").distinct()
    return paths.join(found, "path", "left").select("path", fits.alias("encoding"))


def _decodes(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def decoded(rows: DataFrame, column: str, encodings: DataFrame) -> DataFrame:
    """`rows` (path, ...) with the bytes of a column as text, by the encodings (path, encoding) of the files.

    Rows of files without an encoding are left out. UTF-8 stays in the JVM.
    """
    # One row per file, as many as the driver lists to read them, hence the hint.
    named = rows.join(F.broadcast(encodings), "path").where("encoding IS NOT NULL")
    names = [c for c in rows.columns if c != column]
    easy = named.where(F.col("encoding").isin(*_UTF8)).select(*names, F.col(column).cast("string").alias(column))
    hard = named.where(~F.col("encoding").isin(*_UTF8)).select(*names, "encoding", column)
    schema = easy.schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b.decode(e, "replace") for e, b in zip(batch.column("encoding").to_pylist(), batch.column(column).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(text, pa.string())], names=[*names, column]
            )

    return easy.union(hard.mapInArrow(decode, schema))


def cells(record: Column) -> Column:
    """The cells of a record whose quotes are doubled inside quotes, as an array of texts; an empty cell is null."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'), F.lit(0))

    def plain(part: Column) -> Column:
        cell = F.substring(part, 2, 1 << 30)
        inner = F.regexp_replace(F.regexp_extract(cell, '^"([^"]*+(?:""[^"]*+)*+)"', 1), '""', '"')
        return F.when(F.startswith(cell, F.lit('"')), inner).otherwise(F.nullif(cell, F.lit("")))

    return F.transform(parts, plain)


def csv_line(values: Column) -> Column:
    """A record of cells, quoted where they need it; null is an empty cell and an empty text is quoted."""

    def cell(x: Column) -> Column:
        needs = F.rlike(x, F.lit('[",\r\n]')) | (x == "")
        return F.when(x.isNull(), F.lit("")).when(needs, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return F.array_join(F.transform(values, cell), ",")
