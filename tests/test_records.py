"""CSV records from splits, encodings and whole trees of files."""

import csv
import io
import random
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattloom.model import ROW_ID
from wattloom.sources import records, tables, trees


@contextmanager
def splits_of(spark, size):
    """Splits of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "200"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def some_rows(n, seed):
    pick = random.Random(seed)
    parts = ["a", "b c", '"', '""', ",", "\n", "\r\n", "ü漢", "", "x" * 40, "'", '",\n"']
    return [["".join(pick.choices(parts, k=pick.randrange(5))) for _ in range(4)] for _ in range(n)]


def as_csv(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def found(lines):
    rows = records.records(lines).select("block", "at", records.cells(F.col("record").cast("string")).alias("c"))
    return [[x or "" for x in r.c] for r in rows.orderBy("block", "at").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_do_not_depend_on_splits(spark, tmp_path, end):
    rows = [[f"row {i}", *r] for i, r in enumerate(some_rows(400, 1))]
    rows[200][2] = 'a long cell, "quoted"\n' * 100
    (tmp_path / "a.csv").write_text(as_csv(rows, end), newline="", encoding="utf-8")
    with splits_of(spark, 300):
        lines = records.scanned_lines(spark, str(tmp_path / "a.csv"))
        assert lines.select("block").distinct().count() > 50
        assert found(lines) == rows
        # Some splits lie inside one cell, and the states come through all of them.
        assert records.split_starts(lines).count() > 5
    assert found(records.scanned_lines(spark, str(tmp_path / "a.csv"))) == rows


def test_stray_quotes_open_ends_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfname,size\npipe,5" wide\nb,"x"y\n\n"c\n",d\ne,"never closed\nat all\n')
    want = [["name", "size"], ["pipe", '5" wide'], ["b", "x"], ["c\n", "d"]]
    for size in (8, 1 << 20):
        with splits_of(spark, size):
            got = records.records(records.scanned_lines(spark, str(tmp_path / "a.csv"))).orderBy("block", "at")
            rows = [bytes(r.record) for r in got.collect()]
        assert rows[-1] == b'e,"never closed\nat all'
        parsed = spark.createDataFrame([(r.decode(),) for r in rows[:-1]], "r string").select(records.cells(F.col("r")).alias("c"))
        assert [list(r.c) for r in parsed.collect()] == want
    (tmp_path / "none.csv").write_bytes(b"")
    assert found(records.scanned_lines(spark, str(tmp_path / "none.csv"))) == []


def test_reader_equals_the_one_task_reader(spark, tmp_path):
    pick = random.Random(3)
    text = "name,remark,p_nom,n\n" + "".join(
        f'u{i},{pick.choice(["plain", chr(34) + "two" + chr(10) + "lines" + chr(34), chr(34) + "a, b" + chr(34), "", chr(34) * 2])},{i / 4},{i}\n'
        for i in range(500)
    )
    (tmp_path / "u.csv").write_text(text, encoding="utf-8")
    plain = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "u.csv"))
    want = [(r["name"], r.remark, float(r.p_nom), int(r.n)) for r in plain.collect()]
    with splits_of(spark, 500):
        rows = tables.read_csv(spark, str(tmp_path / "u.csv"))
        assert [f.dataType.simpleString() for f in rows.schema.fields[:4]] == ["string", "string", "double", "int"]
        assert [tuple(r)[:4] for r in rows.orderBy(ROW_ID).collect()] == want


def test_first_encoding_that_fits_all_lines(spark, tmp_path):
    for name, text, encoding in (("a", "값,b\n부산,1\n", "cp949"), ("b", "é,b\nü,2\n", "utf-8"), ("c", "é,b\n\xa0\xff,3\n", "latin1"), ("d", "x,b\ny,4\n", "ascii")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    tree = trees.read_tree(spark, str(tmp_path))
    assert {r.table: r.encoding for r in tree.files.collect()} == {"a": "cp949", "b": "utf-8-sig", "c": "latin1", "d": "utf-8-sig"}
    assert {(r.table, *r.cells) for r in tree.rows.collect()} == {("a", "부산", "1"), ("b", "ü", "2"), ("c", "\xa0\xff", "3"), ("d", "y", "4")}
    strict = trees.read_tree(spark, str(tmp_path), encodings=("utf-8", "euc-kr"))
    assert {r.table: r.encoding for r in strict.files.collect()}["c"] is None
    rows = tables.read_encoded_csv(spark, str(tmp_path / "a.csv"))
    assert [(r["값"], r.b) for r in rows.collect()] == [("부산", 1)]


def tree_of(spark, tmp_path):
    files = {
        "one": [["name", "p"], ["x", "1"], [" x ", "2"], ["y", "3"], ["", "4"], ["", "5"]],
        "deep/two": [["p", "name"], ["1", "x"], ["2", "z"], ["3", "z"], ["4"], ["5", "z"]],
        "deep/a b": [["other"], ["x"], ["x"]],
        "head": [["name", "name"]],
    }
    for name, rows in files.items():
        path = tmp_path / "in" / f"{name}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(as_csv(rows))
    (tmp_path / "in" / "empty.csv").write_text("")
    return trees.read_tree(spark, str(tmp_path / "in"))


def cells_of(rows):
    return [(r.table, list(r.cells)) for r in rows.orderBy("table", "place").collect()]


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_unique_names_of_a_tree(spark, tmp_path, hot_rows):
    tree = tree_of(spark, tmp_path)
    got = cells_of(trees.unique_names_tree(tree.rows, hot_rows=hot_rows))
    assert got == [
        ("deep/a b", ["x"]), ("deep/a b", ["x"]), ("deep/two", ["1", "x"]), ("deep/two", ["2", "z_1"]), ("deep/two", ["3", "z_2"]),
        ("deep/two", ["4"]), ("deep/two", ["5", "z_3"]), ("one", ["x_1", "1"]), ("one", ["x_2", "2"]), ("one", ["y", "3"]),
        ("one", [None, "4"]), ("one", [None, "5"]),
    ]
    report = {r.table: (r.duplicates, r.modified) for r in trees.unique_names_report(tree).collect()}
    assert report == {"deep/a b": (0, 0), "deep/two": (1, 3), "one": (1, 2), "head": (0, 0)}


def test_regions_of_a_tree(spark, tmp_path):
    tree = tree_of(spark, tmp_path)
    mapping = spark.createDataFrame([("x", "EX"), ("y", "y")], "k string, v string")
    got = cells_of(trees.map_region_tree(tree.rows, "name", mapping, "k", "v"))
    assert [c for t, c in got if t == "one"] == [["EX", "1"], ["EX", "2"], ["y", "3"], [None, "4"], [None, "5"]]
    report = {r.table: (r.changed, r.unmapped) for r in trees.map_region_tree_report(tree, "name", mapping, "k", "v").collect()}
    assert report == {"deep/a b": (0, 0), "deep/two": (1, 1), "one": (2, 0), "head": (0, 0)}
    assert [tuple(r) for r in trees.unmapped_tree(tree.rows, "name", mapping, "k").collect()] == [("deep/two", "z")]


def test_trees_are_written_and_converted(spark, tmp_path):
    tree = tree_of(spark, tmp_path)
    trees.write_tree(tree, tree.rows, str(tmp_path / "out"))
    text = {p.parent.name: p.read_text() for p in sorted((tmp_path / "out").rglob("part-*"))}
    assert text["table=one"] == "name,p\nx,1\n x ,2\ny,3\n,4\n,5\n" and text["table=head"] == "name,name.1\n"
    counts = tables.csv_dir_to_tables(spark, str(tmp_path / "in"), str(tmp_path / "typed"), recursive=True)
    assert {r.table: (r.rows, r.cols) for r in counts.collect()} == {"one": (5, 2), "deep/two": (5, 2), "deep/a b": (2, 1), "head": (0, 2)}
    back = tables.table_of(spark, str(tmp_path / "typed"), "one")
    assert back.schema["p"].dataType.simpleString() == "int" and sorted(r.p for r in back.collect()) == [1, 2, 3, 4, 5]
    assert tables.table_of(spark, str(tmp_path / "typed"), "head").columns == ["name", "name.1"]
    with pytest.raises(ValueError):
        tables.table_of(spark, str(tmp_path / "typed"), "none")
    both = tables.csv_dir_to_tables(spark, str(tmp_path / "in"), str(tmp_path / "all"), recursive=True, combined=True)
    assert both.head().rows == 12 and both.count() == 5


def test_transcoded_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("부산,1\n" * 3000).encode("cp949"))
    (tmp_path / "b.csv").write_bytes("끝".encode("euc-kr"))
    with splits_of(spark, 1000):
        report, lines = tables.transcoded(spark, str(tmp_path))
        got = {r["path"].rsplit("/", 1)[-1]: (r["encoding"], r["n_chars"], r["ok"]) for r in report.collect()}
        assert got == {"a.csv": ("cp949", 15_000, True), "b.csv": ("cp949", 1, True)}
        tables.write_transcoded(lines, str(tmp_path), str(tmp_path / "out"))
    text = [p.read_text() for p in sorted((tmp_path / "out" / "file=a").glob("part-*"))]
    assert "".join(text) == "부산,1\n" * 3000


def test_wide_files_of_many_columns(spark, tmp_path):
    """Thousands of columns are cells by position: the plan has as many columns as the result."""
    names = [f"unit {i}" for i in range(3000)] + ["twice", "twice"]
    rows = [["01/03/2024 00:00", *[str(i / 2) for i in range(3001)], ""], ["02/03/2024 00:00", *["nan"] * 3001, "7"]]
    (tmp_path / "w.csv").write_text(as_csv([["snapshot", *names], *rows]))
    long = tables.read_wide_series(spark, str(tmp_path / "w.csv"), "loads", "p_set")
    assert long.columns == ["component", "attribute", "name", "snapshot", "value"]
    got = {(r["name"], r.snapshot.day): r.value for r in long.collect()}
    assert len(got) == 2 * 3002 and got["unit 2999", 1] == 1499.5 and got["unit 5", 2] is None
    assert (got["twice", 1], got["twice.1", 1], got["twice.1", 2]) == (1500.0, None, 7.0)


def test_wide_blocks_round_trip(spark, tmp_path):
    rows = spark.range(700).selectExpr(
        "concat('n', id % 35) AS name", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id div 35)) AS snapshot",
        "CASE WHEN id % 11 > 0 THEN double(id) / 7 END AS value",
    )
    slots = tables.write_wide_series(rows, str(tmp_path / "w"), 8)
    assert sorted(r["count"] for r in slots.groupBy("block").count().collect()) == [3, 8, 8, 8, 8]
    back = tables.read_wide_series(spark, str(tmp_path / "w"), "a", "b", parts=True).select("name", "snapshot", "value")
    assert back.count() == 700 and back.exceptAll(rows).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_lines_join_alike_in_any_batches(monkeypatch, size):
    """Records of any length in batches of any size, with and without those of one line, over two splits and a gap."""
    monkeypatch.setattr(records, "_HELD_LINES", 6)
    rows, want = [], {}
    for block, lengths in ((0, [1, 2, 3, 1, 5, 6, 9, 2]), (90, [4, 1])):
        at = 0
        for n in lengths:
            start = at
            for k in range(n):
                rows.append(("p", block, start, block, at, b"%d" % at, k > 0, k < n - 1))
                at += 1
            want["p", block, start] = b"\n".join(b"%d" % i for i in range(start, at))
        at += 1
    rows.append(("q", 0, 0, 0, 0, b"x", False, True))  # never closed
    rows.insert(3, ("p", None, None, 7, 3, b"y", True, False))  # of a record that another task holds
    names = ["path", "rblock", "rstart", "block", "at", "line", "inside", "after"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]

    def joined(some):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some[i : i + size]), kinds)], names=names) for i in range(0, len(some), size)]
        return [r for b in records._joined_lines(iter(batches)) for r in b.to_pylist()]

    found = joined(rows)
    done = {(r["path"], r["rblock"], r["rstart"]): r["line"] for r in found if r["done"]}
    several = [r for r in joined([r for r in rows if r[6] or r[7]]) if not r["done"]]
    assert sorted(r["line"] for r in several) == sorted(r["line"] for r in found if not r["done"])
    parts = {}
    for r in several:
        parts.setdefault((r["path"], r["rblock"], r["rstart"]), []).append((r["at"], r["line"]))
    rest = {k: b"\n".join(x for _, x in sorted(v)) for k, v in parts.items() if k[1] is not None}
    assert not set(done) & set(rest) and done | rest == want | {("q", 0, 0): b"x"}
    # The record that the stray line interrupts and those of 6 lines and more are left to be brought together.
    assert {k for k, v in want.items() if v.count(b"\n") >= 5} <= set(rest) and len(done) >= len(want) - 4


def test_records_of_a_tree_take_no_more_disk_than_its_files_do(spark, tmp_path):
    rows = [[str(i * 7919), f" n{i % 97}", f'said "{"ANR"[i % 3]}",\nO', "NATION "] for i in range(40_000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(as_csv([["unit", "name", "remark", "province"], *rows]))
    trees.read_tree(spark, str(tmp_path))  # the folder exists from here on
    kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = sum(p.stat().st_size for p in kept.rglob("*") if p.is_file())
    tree = trees.read_tree(spark, str(tmp_path))
    grown = sum(p.stat().st_size for p in kept.rglob("*") if p.is_file()) - before
    assert grown < 1.5 * sum(p.stat().st_size for p in tmp_path.glob("*.csv"))
    assert tree.rows.count() == 80_000 and tree.rows.where("cells[2] = 'said \"N\",\nO'").count() == 26_666
    plan = records.records(records.scanned_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # lines are not dealt to meet their split
