"""What sources must not lose: decimals, broken cells, equal stems, quoted line breaks, file order, repeated names."""

import pytest

from wattloom.model import ROW_ID
from wattloom.sources import settings, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_whole_numbers_with_decimals_and_broken_cells(spark, tmp_path):
    path = write(tmp_path / "generators.csv", "name,build_year,close_year,p_nom\na,2015.0,2040.0,1.5\nb,,x,n/k\nc,2016,NaN,nan\nd,2016.5,2041,2\n")
    rows, rejects = tables.read_csv_checked(spark, path)
    got = [tuple(r) for r in rows.orderBy(ROW_ID).select("name", "build_year", "close_year", "p_nom").collect()]
    assert got == [("a", 2015, 2040, 1.5), ("b", None, None, None), ("c", 2016, None, None), ("d", None, 2041, 2.0)]
    assert sorted((r["column"], r.cell) for r in rejects.collect()) == [("build_year", "2016.5"), ("close_year", "x"), ("p_nom", "n/k")]


def test_network_keeps_its_rejects(spark, tmp_path):
    write(tmp_path / "buses.csv", "name,x,y\nb1,1,2\nb2,east,3\n")
    network = tables.read_network(spark, str(tmp_path))
    assert [(r["column"], r.cell) for r in network.rejects["buses"].collect()] == [("x", "east")]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "units.csv", 'name,address,p_nom\na,"first line\nsecond line",3\nb,plain,4\n')
    rows = tables.read_csv(spark, path).orderBy(ROW_ID).collect()
    assert [(r.name, r.address, r.p_nom) for r in rows] == [("a", "first line\nsecond line", 3.0), ("b", "plain", 4.0)]


@pytest.mark.parametrize("multi_line", [True, False])
def test_order_over_several_files(spark, tmp_path, multi_line):
    write(tmp_path / "in/1.csv", "name,p_nom\n" + "".join(f"a{i},{i}\n" for i in range(3)))
    write(tmp_path / "in/2.csv", "name,p_nom\n" + "".join(f"b{i:05},{i}\n" for i in range(20_000)))
    write(tmp_path / "in/3 x.csv", "name,p_nom\nc,1\n")
    rows = tables.read_csv(spark, str(tmp_path / "in"), multi_line=multi_line)
    names = [r.name for r in rows.orderBy(ROW_ID).select("name").collect()]
    assert names == ["a0", "a1", "a2", *[f"b{i:05}" for i in range(20_000)], "c"]
    assert rows.select(ROW_ID).distinct().count() == len(names)


def test_equal_stems_in_different_folders(spark, tmp_path):
    write(tmp_path / "in/a/u.csv", "name,p_nom\nx,1\n")
    write(tmp_path / "in/b/u.csv", "name,p_nom\ny,2\nz,3\n")
    out = tables.csv_dir_to_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"), recursive=True)
    assert sorted((r.table, r.rows) for r in out.collect()) == [("a/u", 1), ("b/u", 2)]
    both = tables.csv_dir_to_tables(spark, str(tmp_path / "in"), str(tmp_path / "one"), recursive=True, combined=True)
    assert both.head().rows == 3


def test_last_row_of_a_repeated_name_counts(spark):
    rows = spark.createDataFrame([(0, "z", "Place"), (1, "a", "Place"), (2, "a", "Other"), (3, None, "Place")], f"{ROW_ID} long, short string, official string")
    assert {r.k: r.short for r in settings.region_map(rows).collect()} == {"Place": "a", "Other": "a", "z": "z", "a": "a"}
    assert {r.k: r.v for r in settings.directed_region_map(rows, "to_official").collect()}["a"] == "Other"


def test_rules_without_a_cap(spark):
    rows = spark.range(20_000).selectExpr("concat('a', id) AS attribute", "CASE WHEN id % 2 = 0 THEN 'sum' END AS rule")
    assert settings.rules_frame(rows).count() == 10_000
    assert settings.rules_dict(rows, ["a0", "a1", "a4", "none"]) == {"a0": "sum", "a4": "sum"}


def test_series_round_trip_with_one_large_attribute(spark, tmp_path):
    rows = spark.range(5000).selectExpr(
        "'loads' AS component", "IF(id < 4900, 'p_set', 'q') AS attribute", "concat('n', id % 7) AS name",
        "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id)) AS snapshot", "double(id) AS value",
    )
    tables.write_series(rows, str(tmp_path / "s"))
    back = tables.read_series(spark, str(tmp_path / "s"))
    assert back.exceptAll(rows).count() == 0 and back.count() == 5000
