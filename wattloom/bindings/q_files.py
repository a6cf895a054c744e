"""Named queries: file formats, written from the given tables to shared scratch space and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ROW_ID
from ..session import written
from ..sources import settings, tables, trees
from .registry import query
from .views import Tables


def _csv(df, path: str, encoding: str = "UTF-8"):
    spark = df.sparkSession
    flag = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(flag, "false")
    spark.conf.set(flag, "true")
    try:
        df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)
    finally:
        spark.conf.set(flag, before)
    return path


def _folder(t: Tables) -> str:
    folder = t.scratch("network")
    _csv(t["f_buses"].drop(ROW_ID, "grp"), f"{folder}/buses.csv")
    units = t["f_generators"].select("name", "bus", "carrier", "province", "p_nom", "build_year", "cc_group", "control")
    # Whole numbers as decimals, the way a column with gaps is often written, and cells that are no numbers.
    year, broken = F.concat(F.col("build_year").cast("string"), F.lit(".0")), F.col("control") == "O"
    units = units.withColumns({"build_year": year, "p_nom": F.when(broken, "n/k").otherwise(F.col("p_nom").cast("string"))})
    _csv(units.drop("control"), f"{folder}/generators.csv")
    wide = t["f_series"].where(F.col("name").isin("u1", "u2")).groupBy("snapshot").pivot("name", ["u1", "u2"]).agg(F.max("value"))
    _csv(wide.withColumn("snapshot", F.date_format("snapshot", "dd/MM/yyyy HH:mm")), f"{folder}/loads-p_set.csv")
    return folder


@query(
    "scan_network",
    """
    SELECT name, bus, carrier, province, CASE WHEN control <> 'O' THEN round(p_nom, 4) END AS p_nom,
           CAST(build_year AS BIGINT) AS build_year, cc_group FROM f_generators
    """,
    "f_generators",
)
def _scan_network(t):
    return tables.read_network(t.spark, _folder(t))["generators"].drop(ROW_ID)


@query(
    "scan_network_rejects",
    "SELECT 'p_nom' AS \"column\", 'n/k' AS cell, count(*) AS n FROM f_generators WHERE control = 'O'",
    "f_generators",
)
def _scan_network_rejects(t):
    rejects = tables.read_network(t.spark, _folder(t)).rejects["generators"]
    return rejects.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_network_series",
    """
    , w AS (SELECT snapshot, n.name FROM (SELECT DISTINCT snapshot FROM f_series WHERE name IN ('u1', 'u2')) s, (VALUES ('u1'), ('u2')) n(name))
    SELECT 'loads' AS component, 'p_set' AS attribute, w.name, w.snapshot, round(f.value, 4) AS value
    FROM w LEFT JOIN f_series f ON w.name = f.name AND w.snapshot = f.snapshot
    """,
    "f_series",
)
def _scan_network_series(t):
    return tables.read_network(t.spark, _folder(t)).series


def _fact_file(t: Tables, label: str, view: str) -> str:
    rows = t[view].withColumn("snapshot", F.date_format("snapshot", "dd/MM/yyyy HH:mm"))
    return _csv(rows, f"{t.scratch(label)}/facts.csv")


@query(
    "scan_monthly",
    """
    SELECT make_timestamp(2024, month(snapshot), 1, 0, 0, 0) AS snapshot, carrier, region, aggregation, attribute, round(value, 2) AS value
    FROM f_facts WHERE year(snapshot) = 1997
    """,
    "f_facts",
    digits=2,
)
def _scan_monthly(t):
    good, _ = tables.read_monthly(t.spark, _fact_file(t, "monthly", "f_facts"), 1997, 2024)
    return good.drop(ROW_ID)


@query(
    "scan_monthly_rejects",
    "SELECT count(*) AS n FROM f_daily WHERE month(snapshot) = 2 AND day(snapshot) = 29 AND year(snapshot) = 1996",
    "f_daily",
)
def _scan_monthly_rejects(t):
    _, bad = tables.read_monthly(t.spark, _fact_file(t, "rejects", "f_daily"), 1996, 2023)
    return bad.agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_snapshot",
    """
    SELECT make_timestamp(2024, month(snapshot), day(snapshot), 0, 0, 0) AS snapshot, name, round(value, 2) AS value FROM f_daily
    WHERE year(snapshot) = 1998
    UNION ALL
    SELECT make_timestamp(2024, 2, 29, 0, 0, 0), name, round(value, 2) FROM f_daily
    WHERE year(snapshot) = 1998 AND month(snapshot) = 2 AND day(snapshot) = 28
    """,
    "f_daily",
    digits=2,
)
def _scan_snapshot(t):
    good, _ = tables.read_hourly(t.spark, _fact_file(t, "hourly", "f_daily"), 1998, 2024)
    return good.drop(ROW_ID)


@query(
    "scan_encoded_csv",
    "SELECT name, '울산 ' || province AS province, round(p_nom, 4) AS p_nom FROM f_generators",
    "f_generators",
)
def _scan_encoded_csv(t):
    rows = t["f_generators"].select("name", F.concat(F.lit("울산 "), "province").alias("province"), "p_nom")
    path = _csv(rows, f"{t.scratch('encoded')}/units.csv", "MS949")
    return tables.read_encoded_csv(t.spark, path, "cp949").drop(ROW_ID)


@query(
    "scan_unnamed_encoding",
    "SELECT name, CASE WHEN control = 'O' THEN '울산 ' ELSE 'café ' END || province AS province, round(p_nom, 4) AS p_nom FROM f_generators",
    "f_generators",
)
def _scan_unnamed_encoding(t):
    """Files in different encodings in one folder, none of them named."""
    folder = t.scratch("mixed")
    units = t["f_generators"].select("name", F.col("control") == "O", "province", "p_nom").toDF("name", "korean", "province", "p_nom")
    units = written(units, "units")  # joined once for both halves
    for word, korean, encoding in (("울산 ", True, "MS949"), ("café ", False, "UTF-8")):
        rows = units.where(F.col("korean") == korean).select("name", F.concat(F.lit(word), "province").alias("province"), "p_nom")
        _csv(rows, f"{folder}/{encoding}", encoding)
    return tables.read_encoded_csv(t.spark, [f"{folder}/MS949", f"{folder}/UTF-8"]).drop(ROW_ID)


@query("transcode_files", "SELECT CAST(count(*) AS BIGINT) AS lines, true AS ok FROM customer")
def _transcode_files(t):
    rows = t["customer"].select("c_custkey", F.concat(F.lit("부산 "), "c_name").alias("c_name"))
    path = _csv(rows.repartition(4, "c_custkey"), t.scratch("transcode"), "EUC-KR")
    report, lines = tables.transcoded(t.spark, path)
    count = lines.where(F.contains("line", F.lit("부산"))).agg(F.count(F.lit(1))).scalar()
    return report.agg(F.bool_and("ok").alias("ok")).select(count.cast("bigint").alias("lines"), "ok")


@query(
    "csv_dir_to_tables",
    """
    SELECT 'nations' AS "table", count(*) AS rows, CAST(3 AS BIGINT) AS cols FROM nation
    UNION ALL SELECT 'customers', count(*), CAST(2 AS BIGINT) FROM customer
    """,
)
def _csv_dir_to_tables(t):
    folder = t.scratch("csvdir")
    for name, df in (("nations", t["nation"]), ("customers", t["customer"].select("c_custkey", "c_name"))):
        _csv(df, f"{folder}/{name}")
    found = tables.csv_dir_to_tables(t.spark, folder, t.scratch("converted"), recursive=True)
    # The parts of a table are files of its folder.
    return found.groupBy(F.substring_index("table", "/", 1).alias("table")).agg(F.sum("rows").alias("rows"), F.max("cols").alias("cols"))


def _tree(t: Tables, label: str) -> trees.Tree:
    """Units as one file per carrier, with names that repeat inside and across files and line breaks in quoted cells."""
    folder = t.scratch(label)
    # Texts are made after the rows are dealt and sorted, which are shorter before.
    short = t["f_generators"].select("carrier", ROW_ID, (F.length("name") * 7 + F.col("build_year") % 900).alias("number"), "market", "control", "province")
    units = short.repartition("carrier").sortWithinPartitions("carrier", ROW_ID).select(
        "carrier", F.col(ROW_ID).cast("string").alias("unit"), F.concat(F.lit(" n"), F.col("number").cast("string")).alias("name"),
        F.concat(F.lit('said "'), "market", F.lit('",\n'), "control").alias("remark"), F.concat(F.col("province"), F.lit(" ")).alias("province"),
    )
    units.write.partitionBy("carrier").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder)
    return trees.read_tree(t.spark, folder)


def _unit(c: str, i: int):
    return F.get("cells", F.lit(i)).alias(c)


def _carrier():
    return F.regexp_extract("table", "carrier=([^/]*)/", 1).alias("carrier")


_TREE = """, u AS (SELECT carrier, CAST(row_id AS VARCHAR) AS unit, row_id, 'n' || CAST(length(name) * 7 + build_year % 900 AS VARCHAR) AS name,
                     'said "' || market || '",' || chr(10) || control AS remark, province FROM f_generators)"""


@query(
    "unique_names_tree",
    f"""{_TREE}, c AS (SELECT *, count(*) OVER (PARTITION BY carrier, name) AS n,
                         row_number() OVER (PARTITION BY carrier, name ORDER BY row_id) AS i FROM u)
    SELECT carrier, unit, CASE WHEN n > 1 THEN name || '_' || CAST(i AS VARCHAR) ELSE ' ' || name END AS name, remark FROM c
    """,
    "f_generators",
)
def _unique_names_tree(t):
    rows = trees.unique_names_tree(_tree(t, "unique").rows)
    return rows.select(_carrier(), _unit("unit", 0), _unit("name", 1), _unit("remark", 2))


@query(
    "unique_names_tree_report",
    f"""{_TREE}, c AS (SELECT carrier, name, count(*) AS n FROM u GROUP BY carrier, name)
    SELECT carrier, count(*) FILTER (n > 1) AS duplicates, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS modified FROM c GROUP BY carrier
    """,
    "f_generators",
)
def _unique_names_tree_report(t):
    found = trees.unique_names_report(_tree(t, "dry"))
    return found.select(_carrier(), "duplicates", "modified")


@query(
    "map_region_tree",
    f"""{_TREE} SELECT carrier, unit, coalesce(short, province || ' ') AS province FROM u LEFT JOIN f_region_map ON province = official""",
    "f_generators f_region_map",
)
def _map_region_tree(t):
    mapping = settings.directed_region_map(t["f_region_map"], "to_short")
    rows = trees.map_region_tree(_tree(t, "regions").rows, "province", mapping, "k", "v")
    return rows.select(_carrier(), _unit("unit", 0), _unit("province", 3))


@query(
    "map_region_tree_report",
    f"""{_TREE} SELECT carrier, count(short) AS changed, count(DISTINCT CASE WHEN short IS NULL THEN province END) AS unmapped
    FROM u LEFT JOIN f_region_map ON province = official GROUP BY carrier""",
    "f_generators f_region_map",
)
def _map_region_tree_report(t):
    mapping = settings.directed_region_map(t["f_region_map"], "to_short")
    found = trees.map_region_tree_report(_tree(t, "report"), "province", mapping, "k", "v")
    return found.select(_carrier(), "changed", "unmapped")


@query("write_table", "SELECT name, province, round(p_nom, 4) AS p_nom FROM f_generators", "f_generators")
def _write_table(t):
    path = t.scratch("sink")
    tables.write_table(t["f_generators"].select("name", "province", "p_nom"), path)
    return t.spark.read.parquet(path)


@query(
    "write_series",
    "SELECT component, attribute, name, snapshot, round(value, 6) AS value FROM f_network_series",
    "f_network_series",
    digits=6,
)
def _write_series(t):
    path = t.scratch("series")
    tables.write_series(t["f_network_series"], path)
    return tables.read_series(t.spark, path)


@query(
    "load_rules",
    """
    SELECT p_type AS attribute, CASE WHEN p_type < 'M' THEN 'sum' ELSE 'mean' END AS rule FROM part WHERE p_type <> 'SMALL' GROUP BY p_type
    """,
)
def _load_rules(t):
    rules = t["part"].groupBy(F.col("p_type").alias("attribute")).agg(
        F.when(F.max("p_type") == "SMALL", F.lit(None)).when(F.max("p_type") < "M", "sum").otherwise("mean").alias("rule")
    )
    path = _csv(rules, f"{t.scratch('rules')}/rules.csv")
    return settings.rules_frame(tables.read_csv(t.spark, path))


@query(
    "load_carrier_attrs",
    """
    SELECT carrier, p_min_pu, ramp_limit_up, min_up_time, max_cf, min_cf FROM f_carrier_attrs
    """,
    "f_carrier_attrs",
)
def _load_carrier_attrs(t):
    path = _csv(t["f_carrier_attrs"].withColumnRenamed("carrier", "carriers"), f"{t.scratch('attrs')}/attrs.csv")
    return settings.carrier_attributes(tables.read_csv(t.spark, path, infer=False))


@query(
    "load_region_map",
    "SELECT official AS k, short FROM f_region_map UNION SELECT short, short FROM f_region_map",
    "f_region_map",
)
def _load_region_map(t):
    path = _csv(t["f_region_map"].select("short", "official"), f"{t.scratch('regions')}/map.csv")
    return settings.read_region_map(t.spark, path)


@query("load_demand", "SELECT province, round(demand, 2) AS demand FROM f_demand", "f_demand", digits=2)
def _load_demand(t):
    total = t["f_demand"].agg(F.lit("합계").alias("province"), F.sum("demand").alias("demand"))
    path = _csv(t["f_demand"].unionByName(total), f"{t.scratch('demand')}/demand.csv")
    return settings.demand_table(tables.read_csv(t.spark, path)).drop(ROW_ID)
