"""Named queries: names, coordinates, distinct values, unions and expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import DEGREES_PER_KM
from ..model import ROW_ID
from ..operators import quality, rollup
from .registry import query


@query("duplicate_names", "SELECT trim(name) AS name, count(*) AS n FROM f_names GROUP BY 1 HAVING count(*) > 1", "f_names")
def _duplicate_names(t):
    padded = t["f_names"].withColumn("name", F.concat(F.lit(" "), "name", F.lit("\t")))
    return quality.duplicate_names(padded)


@query(
    "duplicate_positions",
    "SELECT name, row_id AS position FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM f_names) WHERE n > 1",
    "f_names",
)
def _duplicate_positions(t):
    return quality.duplicate_positions(t["f_names"])


_MIXED = "mixed AS (SELECT row_id, CASE WHEN row_id % 9 = 0 THEN '' WHEN row_id % 7 = 0 THEN name || CAST(row_id AS STRING) ELSE name END AS name FROM f_names)"


def _mixed(t):
    n = F.col(ROW_ID)
    name = F.when(n % 9 == 0, "").when(n % 7 == 0, F.concat("name", n.cast("string"))).otherwise(F.col("name"))
    return t["f_names"].select(ROW_ID, name.alias("name"))


@query(
    "unique_names",
    f""", {_MIXED}
    SELECT row_id, CASE WHEN name <> '' AND count(*) OVER (PARTITION BY name) > 1
             THEN name || '_' || CAST(row_number() OVER (PARTITION BY name ORDER BY row_id) AS VARCHAR) ELSE name END AS name FROM mixed
    """,
    "f_names",
)
def _unique_names(t):
    return quality.unique_names(_mixed(t))


@query(
    "unique_names_count",
    f", {_MIXED} SELECT count(*) AS modified FROM (SELECT name, count(*) OVER (PARTITION BY name) AS n FROM mixed) WHERE n > 1 AND name <> ''",
    "f_names",
)
def _unique_names_count(t):
    return quality.unique_names_count(_mixed(t))


@query(
    "all_same_coordinates",
    "SELECT count(DISTINCT x) = 1 AND count(DISTINCT y) = 1 AS all_same FROM f_buses WHERE x IS NOT NULL AND y IS NOT NULL",
    "f_buses",
)
def _all_same_coordinates(t):
    return quality.all_same_coordinates(t["f_buses"])


def _moved_sql(x: str, y: str) -> str:
    """The offset from the digest of row, seed and purpose, as `jitter_offset` draws it."""
    unit = "CAST(CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':7:{}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"
    radius, angle = f"sqrt({unit.format('radius')}) * {2.0 * DEGREES_PER_KM!r}", f"{unit.format('angle')} * 2 * pi()"
    return f"SELECT name, round({x} + {radius} * cos({angle}), 6) AS x, round({y} + {radius} * sin({angle}), 6) AS y FROM f_buses"


@query("jitter", _moved_sql("x", "y"), "f_buses", digits=6)
def _jitter(t):
    moved = quality.jitter(t["f_buses"].select("name", "x", "y", ROW_ID), 2.0, ROW_ID, 7)
    return moved.select("name", "x", "y")


@query("jitter_if_same", "SELECT name, round(x, 4) AS x, round(y, 4) AS y FROM f_buses", "f_buses")
def _jitter_if_same(t):
    # The coordinates differ, so nothing moves.
    return quality.jitter_if_same(t["f_buses"].select("name", "x", "y", ROW_ID), 2.0, ROW_ID, 7).select("name", "x", "y")


@query("jitter_if_same_moves", _moved_sql("127.5", "36.25"), "f_buses", digits=6)
def _jitter_if_same_moves(t):
    same = t["f_buses"].select("name", F.lit(127.5).alias("x"), F.lit(36.25).alias("y"), ROW_ID)
    return quality.jitter_if_same(same, 2.0, ROW_ID, 7).select("name", "x", "y")


@query(
    "distinct_values",
    """
    SELECT DISTINCT 'carrier' AS "column", carrier AS value FROM f_generators UNION SELECT 'province', province FROM f_generators
    UNION SELECT 'cc_group', cc_group FROM f_generators WHERE cc_group IS NOT NULL
    """,
    "f_generators",
)
def _distinct_values(t):
    return quality.distinct_values(t["f_generators"], ["carrier", "province", "cc_group"])


@query("head_n", "SELECT row_id, name FROM f_names WHERE name LIKE '%anvil%' ORDER BY row_id LIMIT 10", "f_names")
def _head_n(t):
    return quality.head_rows(t["f_names"], F.contains("name", F.lit("anvil")), 10).select(ROW_ID, "name")


@query(
    "cc_samples",
    "SELECT name, cc_group FROM f_generators WHERE cc_group IS NOT NULL ORDER BY row_id LIMIT 5",
    "f_generators",
)
def _cc_samples(t):
    return rollup.cc_samples(t["f_generators"], 5)


@query(
    "concat_tables",
    """
    SELECT name, bus0, bus1, length, num_parallel, NULL AS p_nom FROM f_lines
    UNION ALL SELECT name, bus0, bus1, length, NULL, p_nom FROM f_links
    """,
    "f_lines f_links",
)
def _concat_tables(t):
    lines = t["f_lines"].select("name", "bus0", "bus1", "length", "num_parallel")
    return quality.concat_tables([lines, t["f_links"].select("name", "bus0", "bus1", "length", "p_nom")])


@query(
    "expand_mainland",
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT') THEN n_name ELSE o_orderpriority END AS region
    FROM orders LEFT JOIN nation ON o_orderpriority IN ('5-LOW', '1-URGENT') AND n_nationkey < 16
    """,
)
def _expand_mainland(t):
    rows = t["orders"].select("o_orderkey", F.concat(F.lit("  "), F.replace("o_orderpriority", F.lit(" "), F.lit("  "))).alias("region"))
    labels = quality.parse_mainland_labels(several="5-LOW, 1-URGENT")
    return quality.expand_mainland(rows, labels, [f"NATION_{i}" for i in range(16)])
