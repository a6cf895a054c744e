"""Views that give the driver's tables the shapes of the domain. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..model import ROW_ID

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_FACT_TABLES = ("lineitem", "orders", "events", "documents", "pages", "conversations")
_SCHEMAS: dict[str, T.StructType] = {}

# name -> (views it reads, text). Every view has a `row_id` that stands for file order.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "f_buses": (
        (),
        """
        SELECT 'b' || CAST(s_suppkey AS STRING) AS name, n_name AS province, r_name AS grp, s_suppkey AS row_id,
               CAST(124.0 + ((s_suppkey * 7919) % 10000) / 2000.0 AS DOUBLE) AS x,
               CAST(33.0 + ((s_suppkey * 104729) % 10000) / 2000.0 AS DOUBLE) AS y,
               CAST(CASE s_suppkey % 3 WHEN 0 THEN 154 WHEN 1 THEN 345 ELSE 765 END AS DOUBLE) AS v_nom,
               'AC' AS carrier, 'KR' AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        """,
    ),
    "f_generators": (
        (),
        """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
                 || '-' || CAST(l_suppkey AS STRING) AS name,
               ((CAST(l_orderkey AS DECIMAL(38, 0)) * 10 + l_linenumber) * 1000000000000 + l_partkey) * 1000000000000
                 + l_suppkey AS row_id,
               'b' || CAST(l_suppkey AS STRING) AS bus, p_type AS carrier, n_name AS province, r_name AS grp,
               l_quantity AS p_nom, 1.0 - l_discount AS efficiency, l_tax AS marginal_cost,
               CAST(year(l_shipdate) AS INT) AS build_year,
               CASE WHEN l_linenumber % 3 = 0 THEN CAST(year(l_shipdate) AS INT) + 3 END AS close_year,
               CASE WHEN l_returnflag = 'A' THEN 'G' || CAST(l_orderkey AS STRING) END AS cc_group,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS capital_cost,
               l_returnflag AS market, l_linestatus AS control
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        """,
    ),
    "f_lines": (
        (),
        """
        SELECT 'l-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
                 || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS name,
               ((CAST(l_orderkey AS DECIMAL(38, 0)) * 10 + l_linenumber) * 1000000000000 + l_partkey) * 1000000000000
                 + l_suppkey AS row_id,
               'b' || CAST(l_suppkey AS STRING) AS bus0, 'b' || CAST(l_partkey % 10 AS STRING) AS bus1,
               CAST(CASE l_linenumber % 3 WHEN 0 THEN 154 WHEN 1 THEN 345 ELSE 765 END AS DOUBLE) AS v_nom,
               CAST(l_linenumber AS DOUBLE) AS num_parallel, l_extendedprice AS s_nom,
               l_discount AS r, l_tax AS x, CAST(0 AS DOUBLE) AS b, l_quantity AS length
        FROM lineitem
        """,
    ),
    "f_links": (
        ("f_lines",),
        """
        SELECT name, row_id, bus0, bus1, length AS p_nom, 1.0 - r AS efficiency, x AS marginal_cost,
               CASE WHEN num_parallel > 4 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p_min_pu, length, v_nom
        FROM f_lines
        """,
    ),
    "f_series": (
        (),
        """
        SELECT 'u' || CAST(user_id AS STRING) AS name, date_trunc('hour', ts) AS snapshot,
               round(avg(value), 6) AS value
        FROM events GROUP BY user_id, date_trunc('hour', ts)
        """,
    ),
    "f_items": (
        (),
        """
        SELECT 'u' || CAST(user_id AS STRING) AS name, user_id AS row_id, 'c' || CAST(user_id % 5 AS STRING) AS carrier,
               n_name AS province, r_name AS grp, CAST(10 + user_id % 90 AS DOUBLE) AS p_nom
        FROM (SELECT DISTINCT user_id FROM events) u JOIN nation ON user_id % 25 = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        """,
    ),
    # The series table of a network: several attributes over the same names.
    "f_network_series": (
        ("f_series",),
        """
        SELECT 'generators' AS component, 'p' AS attribute, name, snapshot, value FROM f_series
        UNION ALL SELECT 'generators', 'p_max_pu', name, snapshot, value / 1000 FROM f_series
        UNION ALL SELECT 'generators', 'fuel_cost', name, snapshot, value * 2 FROM f_series
        UNION ALL SELECT 'loads', 'p_set', name, snapshot, value + 1 FROM f_series
        UNION ALL SELECT 'storage_units', 'p', name, snapshot, value - 50 FROM f_series
        UNION ALL SELECT 'storage_units', 'state_of_charge', name, snapshot, value * 3 FROM f_series
        UNION ALL SELECT 'links', 'p0', name, snapshot, value - 40 FROM f_series
        UNION ALL SELECT 'lines', 'p0', name, snapshot, value - 60 FROM f_series
        """,
    ),
    "f_snapshots": (("f_series",), "SELECT DISTINCT snapshot FROM f_series"),
    # Edges that carry a flow series: between provinces, one per item.
    "f_edges": (
        ("f_items",),
        """
        SELECT name, row_id, 'NATION_' || CAST(row_id % 7 AS STRING) AS bus0,
               'NATION_' || CAST(row_id % 31 AS STRING) AS bus1, p_nom, p_nom * 2 AS s_nom,
               CAST(0.9 AS DOUBLE) AS efficiency,
               CASE WHEN row_id % 2 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p_min_pu
        FROM f_items
        """,
    ),
    "f_places": (
        ("f_buses",),
        "SELECT province AS name, avg(x) AS x, avg(y) AS y FROM f_buses GROUP BY province",
    ),
    "f_facts": (
        (),
        """
        SELECT date_trunc('month', o_orderdate) AS snapshot, 'c' || CAST(c_nationkey % 5 AS STRING) AS carrier,
               n_name AS region, 'province' AS aggregation, 'fuel_cost' AS attribute, max(o_totalprice) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3
        UNION ALL
        SELECT date_trunc('month', o_orderdate), 'c' || CAST(c_nationkey % 5 AS STRING), 'ALL', 'national', 'fuel_cost',
               max(o_totalprice)
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
        """,
    ),
    # Customers as the items that facts match: carrier and province follow the nation.
    "f_customers": (
        (),
        """
        SELECT 'k' || CAST(c_custkey AS STRING) AS name, 'generators' AS component, c_custkey AS row_id,
               'c' || CAST(c_nationkey % 5 AS STRING) AS carrier,
               CASE WHEN c_custkey % 10 <> 0 THEN n_name END AS province
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        """,
    ),
    # Facts by customer, one level below the province. Two of three customers have none and fall back to the province's.
    "f_named_facts": (
        (),
        """
        SELECT date_trunc('month', o_orderdate) AS snapshot, 'generators' AS component, 'generator' AS aggregation,
               'fuel_cost' AS attribute, 'c' || CAST(c_nationkey % 5 AS STRING) AS carrier, n_name AS region,
               'k' || CAST(c_custkey AS STRING) AS name, max(o_totalprice) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE c_custkey % 3 = 0 GROUP BY 1, 5, 6, 7
        """,
    ),
    "f_months": ((), "SELECT DISTINCT date_trunc('day', o_orderdate) AS snapshot FROM orders"),
    "f_demand": (
        (),
        """
        SELECT n_name AS province, round(sum(o_totalprice), 2) AS demand
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
        """,
    ),
    "f_names": ((), "SELECT p_partkey AS row_id, p_name AS name, p_type AS carrier, p_size AS p_nom FROM part"),
    "f_daily": (
        (),
        """
        SELECT CAST(o_orderdate AS TIMESTAMP) AS snapshot, 'o' AS name, round(sum(o_totalprice), 2) AS value
        FROM orders GROUP BY o_orderdate
        """,
    ),
    "f_carrier_map": (
        (),
        """
        SELECT DISTINCT p_type AS original_carrier,
               CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'cheap' WHEN p_type = 'SMALL' THEN 'SMALL' ELSE lower(p_type) END
                 AS mapped_carrier
        FROM part WHERE p_type <> 'LARGE'
        """,
    ),
    # Nations as regions: the official name is longer, the short name is the nation key.
    "f_region_map": (
        (),
        """
        SELECT n_name AS official, 'R' || CAST(n_nationkey AS STRING) AS short, r_name AS group1,
               CASE WHEN n_nationkey < 20 THEN 'main' END AS group2
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 22
        """,
    ),
    "f_carrier_attrs": (
        (),
        """
        SELECT p_type AS carrier, CASE WHEN p_type <> 'SMALL' THEN round(avg(p_size) / 50, 3) END AS p_min_pu,
               max(p_retailprice) AS ramp_limit_up, CAST(2.7 AS DOUBLE) AS min_up_time,
               CASE WHEN p_type < 'M' THEN CAST(0.8 AS DOUBLE) END AS max_cf, CAST(NULL AS DOUBLE) AS min_cf
        FROM part WHERE p_type <> 'PROMO' GROUP BY p_type
        UNION ALL
        SELECT 'default', 0.25, NULL, 4.0, 0.5, 0.1 FROM region WHERE r_regionkey = 0
        """,
    ),
    # Rows with an observed year, a group and a value that is sometimes missing.
    "f_gaps": (
        ("f_generators",),
        """
        SELECT row_id, name, carrier, province, build_year, control, p_nom, capital_cost FROM f_generators
        """,
    ),
    # Orders in row order, a third of their prices unknown.
    "f_order_gaps": (
        (),
        """
        SELECT o_orderkey AS row_id, o_orderpriority AS priority, o_orderstatus AS status,
               CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 50 = 0 THEN -o_totalprice ELSE o_totalprice END AS price
        FROM orders
        """,
    ),
    # Map features: polylines between a grid of spots, so that end points meet in clusters.
    "f_features": (
        (),
        """
        SELECT o_orderkey AS line_id,
               CASE WHEN o_orderkey % 97 = 0 THEN 'broken' ELSE
                 '[[' || CAST(1240 + (o_orderkey * 37) % 50 AS STRING) || '.5,' || CAST(330 + (o_custkey * 13) % 50 AS STRING)
                 || '.25],[' || CAST(1250 + (o_orderkey * 7) % 50 AS STRING) || '.125,'
                 || CAST(340 + (o_custkey * 3) % 50 AS STRING) || '.5]]' END AS lonlat,
               CASE o_orderkey % 4 WHEN 0 THEN '154000' WHEN 1 THEN '345 kV; 345000' WHEN 2 THEN '765000;345000'
                 ELSE NULL END AS voltage,
               CASE WHEN o_orderkey % 5 > 0 THEN CAST(1 + o_orderkey % 3 AS INT) END AS circuits
        FROM orders
        """,
    ),
    "f_substations": (
        (),
        """
        SELECT c_custkey AS substation_id, CAST(1240 + (c_custkey * 37) % 60 AS DOUBLE) + 0.46 AS lon,
               CAST(330 + (c_custkey * 13) % 60 AS DOUBLE) + 0.27 AS lat,
               CASE c_custkey % 3 WHEN 0 THEN '154 kV' WHEN 1 THEN 'unknown' ELSE '345' END AS voltage, c_name AS name
        FROM customer WHERE c_custkey % 5 = 0
        """,
    ),
    # Addresses in words, the last of which the gazetteer may not know.
    "f_addresses": (
        (),
        """
        SELECT c_custkey AS row_id,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE
                 r_name || '  ' || n_name || '군 ' || c_mktsegment || ' ' || CAST(c_custkey AS STRING) || ' (' || c_name || ')' END
                 AS address
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        """,
    ),
    "f_gazetteer": (
        (),
        """
        SELECT r_name || ' ' || n_name || '시' AS address, CAST(124 + n_nationkey AS DOUBLE) AS x,
               CAST(33 + n_regionkey AS DOUBLE) AS y
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT r_name || ' ' || n_name || '군 BUILDING', CAST(224 + n_nationkey AS DOUBLE), CAST(133 + n_regionkey AS DOUBLE)
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
        """,
    ),
    # Address parts at supplier coordinates, in the forms that occur: region, special city, city only, English.
    "f_address_parts": (
        ("f_buses",),
        """
        SELECT x, y,
               CASE row_id % 8 WHEN 0 THEN '강원특별자치도' WHEN 1 THEN 'Gangwon State' WHEN 2 THEN 'North Jeolla Province' END AS state,
               CASE row_id % 8 WHEN 3 THEN '전남' END AS province,
               CASE row_id % 8 WHEN 4 THEN 'Some Area' END AS region,
               CASE row_id % 8 WHEN 5 THEN 'Seoul' WHEN 6 THEN '수원시' WHEN 7 THEN 'Nowhere' WHEN 0 THEN '춘천시' END AS city,
               'county ' || province AS county, CAST(NULL AS STRING) AS municipality, 'district ' || grp AS district,
               'town' AS town, 'village' AS village, CAST(NULL AS STRING) AS suburb
        FROM f_buses
        """,
    ),
    # Short and official names of a few regions, for the address queries.
    "f_korea": (
        (),
        """
        SELECT * FROM (VALUES ('강원', '강원특별자치도'), ('경기', '경기도'), ('서울', '서울특별시'), ('전남', '전라남도'),
                              ('전북', '전북특별자치도')) AS t(short, official)
        """,
    ),
}


def needed(names: tuple[str, ...]) -> list[str]:
    """Views in an order in which each comes after those it reads."""
    out: list[str] = []
    for name in names:
        for dependency in needed(VIEWS[name][0]):
            if dependency not in out:
                out.append(dependency)
        if name not in out:
            out.append(name)
    return out


def with_views(names: tuple[str, ...], body: str) -> str:
    """SQL text with the views as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name][1].strip()})" for name in needed(names)]
    return f"WITH RECURSIVE {', '.join(parts)} {body.strip()}" if parts else body.strip()


class Tables:
    """The driver's tables and the views over them, for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A base table. The schema is looked up once per file and process."""
        if name not in self._cache:
            path = f"{self.folder}/{name}.parquet"
            if path not in _SCHEMAS:
                _SCHEMAS[path] = self.spark.read.parquet(path).schema
            self._cache[name] = self._spread(self.spark.read.schema(_SCHEMAS[path]).parquet(path), name)
        return self._cache[name]

    def _spread(self, df: DataFrame, name: str) -> DataFrame:
        """Share out a large table that sits in fewer splits than there are cores.

        A file of one row group is one task however many cores wait; tables of many files never get here.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if name not in _FACT_TABLES or df.rdd.getNumPartitions() >= cores:
            return df
        return df.repartition(cores)

    def __getitem__(self, name: str) -> DataFrame:
        """A base table, or a view with its `row_id` under the library's name and naive timestamps."""
        if name in BASE:
            return self.base(name)
        if name not in self._cache:
            text = with_views((name,), f"SELECT * FROM {name}")
            for table in set(re.findall(r"\w+", text)) & set(BASE):
                self.base(table).createOrReplaceTempView(table)
            df = self.spark.sql(text)
            stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
            df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df
            self._cache[name] = df.withColumnRenamed("row_id", ROW_ID)
        return self._cache[name]

    def scratch(self, label: str) -> str:
        """A new folder in the place the cluster shares, for queries that write and read files."""
        import tempfile
        import uuid

        shared = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not self.spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.gettempdir()
        return f"{shared}/wattloom-{label}-{uuid.uuid4().hex[:12]}"


def _rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled number: what SQL engines do with doubles, without going through decimals."""
    scale = float(10**digits)
    size = F.abs(x) * F.lit(scale)
    whole = F.rint(size)
    up = F.when(size - whole == 0.5, whole + 1).otherwise(whole)
    return F.when(size < 1e300, F.signum(x) * up / F.lit(scale) + F.lit(0.0)).otherwise(x)


def tidy(df: DataFrame, digits: int | dict[str, int] = 4) -> DataFrame:
    """Common output types: whole numbers as BIGINT, decimals rounded, timestamps naive, file order under `row_id`.

    `digits` may name columns; `""` then stands for all others.
    """
    places = digits if isinstance(digits, dict) else {"": digits}
    updates = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            updates[f.name] = _rounded(c.cast("double"), places.get(f.name, places[""]))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            updates[f.name] = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            updates[f.name] = c.cast("timestamp_ntz")
    df = df.withColumns(updates) if updates else df
    return df.withColumnRenamed(ROW_ID, "row_id")
