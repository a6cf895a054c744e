"""Named queries: buses, lines, links and loads rolled up to regions and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ROW_ID, Network
from ..operators import loads, series, topology
from ..plans import runs
from ..sources import settings
from .registry import query


def _regions(t):
    return topology.bus_regions(t["f_buses"], "province", settings.region_map(t["f_region_map"]))


_REG = "reg AS (SELECT name AS bus, coalesce(short, province) AS region FROM f_buses LEFT JOIN f_region_map ON province = official)"


@query(
    "agg_buses",
    f""", {_REG}
    SELECT region AS name, region AS province, round(avg(x), 9) AS x, round(avg(y), 9) AS y, max(v_nom) AS v_nom,
           'AC' AS carrier, 'KR' AS country FROM f_buses JOIN reg ON name = bus GROUP BY region
    """,
    "f_buses f_region_map",
    digits=9,
)
def _agg_buses(t):
    return topology.aggregate_buses(t["f_buses"], _regions(t)).drop(ROW_ID)


_EDGES = """placed AS (SELECT e.*, a.region AS region0, z.region AS region1 FROM {edges} e
                       JOIN reg a ON e.bus0 = a.bus JOIN reg z ON e.bus1 = z.bus WHERE a.region <> z.region)"""


@query(
    "edge_regions",
    f", {_REG}, {_EDGES.format(edges='f_lines')} SELECT name, region0, region1 FROM placed",
    "f_buses f_region_map f_lines",
)
def _edge_regions(t):
    return topology.edge_regions(t["f_lines"], _regions(t)).select("name", "region0", "region1")


_FIRST = "arg_min({c}, row_id)"


@query(
    "agg_lines",
    f""", {_REG}, {_EDGES.format(edges='f_lines')},
    g AS (SELECT region0, region1, v_nom, sum(num_parallel) AS num_parallel, {_FIRST.format(c='s_nom')} AS s_nom,
                 sum(r * num_parallel) / sum(num_parallel) AS r, sum(x * num_parallel) / sum(num_parallel) AS x,
                 sum(b * num_parallel) / sum(num_parallel) AS b, avg(length) AS length
          FROM placed GROUP BY region0, region1, v_nom)
    SELECT concat_ws('_', 'line', region0, region1, row_number() OVER (ORDER BY region0, region1, v_nom) - 1) AS name,
           region0 AS bus0, region1 AS bus1, v_nom, round(num_parallel, 4) AS num_parallel, round(s_nom, 4) AS s_nom,
           round(r, 9) AS r, round(x, 9) AS x, round(b, 9) AS b, round(length, 4) AS length
    FROM g
    """,
    "f_buses f_region_map f_lines",
    digits=9,
)
def _agg_lines(t):
    out = topology.aggregate_lines(t["f_lines"], _regions(t)).drop(ROW_ID)
    return out.withColumns({c: F.round(c, 4) for c in ("num_parallel", "s_nom", "length")})


@query(
    "agg_lines_scaled",
    f""", {_REG}, {_EDGES.format(edges='f_lines')}
    SELECT region0 AS bus0, region1 AS bus1, round(max(num_parallel), 4) AS num_parallel,
           round({_FIRST.format(c='s_nom')} * max(num_parallel), 4) AS s_nom, round(min(r), 4) AS r, round(min(x), 4) AS x,
           round(max(length), 4) AS length
    FROM placed GROUP BY region0, region1
    """,
    "f_buses f_region_map f_lines",
)
def _agg_lines_scaled(t):
    config = {
        "grouping": "ignore_voltage", "circuits_rule": "max", "s_nom_rule": "scale_by_circuits",
        "impedance_rule": "min", "length_rule": "max",
    }
    out = topology.aggregate_lines(t["f_lines"], _regions(t), config)
    return out.select("bus0", "bus1", "num_parallel", "s_nom", "r", "x", "length")


@query(
    "edge_numbering",
    f""", {_REG}, {_EDGES.format(edges='f_lines')}
    SELECT region0 AS bus0, region1 AS bus1, row_number() OVER (ORDER BY region0, region1) - 1 AS number
    FROM (SELECT DISTINCT region0, region1 FROM placed)
    """,
    "f_buses f_region_map f_lines",
)
def _edge_numbering(t):
    out = topology.aggregate_lines(t["f_lines"], _regions(t), {"grouping": "ignore_voltage"})
    return out.select("bus0", "bus1", F.col(ROW_ID).alias("number"))


@query(
    "agg_links",
    f""", {_REG}, {_EDGES.format(edges='f_links')},
    g AS (SELECT least(region0, region1) AS a, greatest(region0, region1) AS z, sum(p_nom) AS p_nom, avg(length) AS length
          FROM placed GROUP BY 1, 2)
    SELECT concat_ws('_', 'link', a, z, row_number() OVER (ORDER BY a, z) - 1) AS name, a AS bus0, z AS bus1,
           round(CASE WHEN p_nom = 0 THEN 1000000 ELSE p_nom END, 4) AS p_nom, round(length, 4) AS length,
           CAST(0.98 AS DOUBLE) AS efficiency, CAST(0.01 AS DOUBLE) AS marginal_cost, CAST(-1 AS DOUBLE) AS p_min_pu
    FROM g
    """,
    "f_buses f_region_map f_links",
)
def _agg_links(t):
    config = {"directional": False, "default_efficiency": 0.98, "marginal_cost": 0.01}
    return topology.aggregate_links(t["f_links"], _regions(t), config).drop(ROW_ID)


@query(
    "network_summary",
    """
    SELECT 'buses' AS section, 'all' AS key, count(*) AS n FROM f_buses
    UNION ALL SELECT 'lines', 'all', count(*) FROM f_lines
    UNION ALL SELECT 'v_nom', CAST(CAST(v_nom AS BIGINT) AS VARCHAR), count(*) FROM f_buses GROUP BY v_nom
    """,
    "f_buses f_lines",
)
def _network_summary(t):
    return topology.network_summary(t["f_buses"], t["f_lines"])


# --- loads --------------------------------------------------------------------------------------

_SHARES = """shares AS (SELECT coalesce(short, province) AS region, demand, demand / (SELECT sum(demand) FROM f_demand) AS share
                        FROM f_demand LEFT JOIN f_region_map ON province = official)"""
_PATTERN = """pattern AS (SELECT snapshot, sum(value) AS pattern FROM f_network_series
                          WHERE component = 'loads' AND attribute = 'p_set' GROUP BY snapshot)"""


@query(
    "allocate_load",
    f""", {_SHARES}, {_PATTERN}
    SELECT 'load_' || region AS name, snapshot, round(pattern * share, 4) AS value FROM pattern, shares
    """,
    "f_demand f_region_map f_network_series",
)
def _allocate_load(t):
    shares = loads.demand_shares(t["f_demand"], "province", settings.region_map(t["f_region_map"]))
    return loads.allocated_pattern(loads.base_pattern(t["f_network_series"]), shares).select("name", "snapshot", "value")


def _loads(t):
    """One load per item, on the bus of its province or, for some, on a bus that does not exist."""
    bus = F.when(F.col(ROW_ID) % 4 == 0, F.lit("gone")).otherwise(F.col("province"))
    place = F.when(F.col(ROW_ID) % 8 == 0, F.lit("nowhere")).otherwise(F.col("province"))
    return t["f_items"].select("name", bus.alias("bus"), place.alias("province"), F.col("p_nom").alias("p_set"), ROW_ID)


_LOADS = """l AS (SELECT name, CASE WHEN row_id % 4 = 0 THEN 'gone' ELSE province END AS bus,
                         CASE WHEN row_id % 8 = 0 THEN 'nowhere' ELSE province END AS province, p_nom AS p_set FROM f_items),
            fixed AS (SELECT l.name, coalesce(b.name, a.name) AS bus, l.p_set FROM l LEFT JOIN f_places b ON l.bus = b.name
                      LEFT JOIN f_places a ON l.province = a.name WHERE coalesce(b.name, a.name) IS NOT NULL)"""


@query("orphan_loads", f", {_LOADS} SELECT name, bus, p_set FROM fixed", "f_items f_places")
def _orphan_loads(t):
    return loads.repaired_loads(_loads(t), t["f_places"], "province").select("name", "bus", "p_set")


@query(
    "regional_loads",
    f""", {_LOADS}, {_PATTERN},
    shares AS (SELECT province AS region, demand / (SELECT sum(demand) FROM f_demand) AS share FROM f_demand
               WHERE province IN (SELECT name FROM f_places))
    SELECT name, bus, round(p_set, 4) AS p_set FROM fixed
    UNION ALL SELECT 'load_' || region, region, round((SELECT avg(pattern) FROM pattern) * share, 4) FROM shares
    """,
    "f_items f_places f_network_series f_demand",
)
def _regional_loads(t):
    out, _ = loads.regional_loads(_loads(t), t["f_network_series"], t["f_places"], t["f_demand"], "province")
    return out.select("name", "bus", "p_set")


@query(
    "regional_load_series",
    f""", {_LOADS}, {_PATTERN},
    shares AS (SELECT province AS region, demand / (SELECT sum(demand) FROM f_demand) AS share FROM f_demand
               WHERE province IN (SELECT name FROM f_places))
    SELECT name, snapshot, round(value, 4) AS value FROM f_network_series
    WHERE component = 'loads' AND name IN (SELECT name FROM fixed)
    UNION ALL SELECT 'load_' || region, snapshot, round(pattern * share, 4) FROM pattern, shares
    """,
    "f_items f_places f_network_series f_demand",
)
def _regional_load_series(t):
    _, out = loads.regional_loads(_loads(t), t["f_network_series"], t["f_places"], t["f_demand"], "province")
    return out.where("component = 'loads'").select("name", "snapshot", "value")


@query(
    "unallocated_share",
    """
    SELECT round(sum(demand) / (SELECT sum(demand) FROM f_demand), 6) AS unallocated_share FROM f_demand
    WHERE province NOT IN (SELECT official FROM f_region_map WHERE group2 IS NOT NULL)
    """,
    "f_demand f_region_map",
    digits=6,
)
def _unallocated_share(t):
    buses = t["f_region_map"].where("group2 IS NOT NULL").select(F.col("official").alias("name"))
    return loads.unallocated_share(t["f_demand"], buses, "province")


def _group_pairs(t):
    return t["f_items"].select(F.col("province").alias("bus"), F.col("grp").alias("region")).distinct()


@query(
    "group_loads",
    """
    , s AS (SELECT i.grp, n.snapshot, count(*) AS n, sum(CASE WHEN n.value < 200 THEN n.value END) AS total,
                   count(CASE WHEN n.value < 200 THEN 1 END) AS known
            FROM f_network_series n JOIN f_items i USING (name) WHERE component = 'loads' GROUP BY 1, 2),
    m AS (SELECT i.grp, count(DISTINCT i.name) AS members FROM f_network_series n JOIN f_items i USING (name)
          WHERE component = 'loads' GROUP BY 1)
    SELECT 'load_' || grp AS name, snapshot, round(CASE WHEN known = members THEN total END, 4) AS value FROM s JOIN m USING (grp)
    """,
    "f_network_series f_items",
)
def _group_loads(t):
    rows = t["f_network_series"].withColumn("value", F.when(F.col("value") < 200, F.col("value")))
    units = t["f_items"].select("name", F.col("province").alias("bus"), F.col("p_nom").alias("p_set"))
    groups = t["region"].select(F.col("r_name").alias("name"))
    _, out = loads.group_loads(units, rows, groups, _group_pairs(t))
    return out.where("component = 'loads'").select("name", "snapshot", "value")


@query(
    "group_loads_static",
    """
    SELECT 'load_' || r_name AS name, r_name AS bus, round(coalesce(sum(p_nom), 0), 4) AS p_set, 'load' AS carrier
    FROM region LEFT JOIN (SELECT * FROM f_items WHERE grp <> 'ASIA') ON r_name = grp GROUP BY r_name
    """,
    "f_items",
)
def _group_loads_static(t):
    units = t["f_items"].where("grp <> 'ASIA'").select("name", F.col("province").alias("bus"), F.col("p_nom").alias("p_set"))
    out, _ = loads.group_loads(units, None, t["region"].select(F.col("r_name").alias("name")), _group_pairs(t), "load")
    return out


# --- whole roll-ups -----------------------------------------------------------------------------

_UNIT_RULES = {
    "carrier": "carrier", "bus": "region", "province": "region", "group": "region", "p_nom": "sum", "efficiency": "mean",
    "others": "remove",
}


def _network(t) -> Network:
    return Network(
        {
            "buses": t["f_buses"].drop("grp"),
            "generators": t["f_generators"].select("name", "bus", "carrier", "province", "p_nom", "efficiency", ROW_ID),
            "lines": t["f_lines"],
            "links": t["f_links"],
            "loads": t["f_items"].select("name", F.lit("b1").alias("bus"), F.col("p_nom").alias("p_set"), ROW_ID),
        },
        t["f_network_series"].where("component = 'loads'"),
        series.snapshot_dimension(t["f_snapshots"]),
    )


def _settings(t, **extra):
    config = {"region_column": "province", "aggregate_by_carrier": True, "load_carrier": "load", **extra}
    return {
        "regional_aggregation": config,
        "region_map": t["f_region_map"],
        "region_demand": t["f_demand"],
        "generator_region_aggregator_rules": _UNIT_RULES,
    }


def _summed_up(net: Network):
    """(component, bus, n, total): each component of a rolled-up network, counted per bus."""
    parts = [
        net["buses"].groupBy(F.col("name").alias("bus")).agg(F.count(F.lit(1)).alias("n"), F.max("v_nom").alias("total")),
        net["generators"].groupBy("bus").agg(F.count(F.lit(1)).alias("n"), F.sum("p_nom").alias("total")),
        net["lines"].groupBy(F.col("bus0").alias("bus")).agg(F.count(F.lit(1)).alias("n"), F.sum("num_parallel").alias("total")),
        net["links"].groupBy(F.col("bus0").alias("bus")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_nom").alias("total")),
        net["loads"].groupBy("bus").agg(F.count(F.lit(1)).alias("n"), F.sum("p_set").alias("total")),
    ]
    out = None
    for name, part in zip(("buses", "generators", "lines", "links", "loads"), parts):
        part = part.select(F.lit(name).alias("component"), "bus", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


def _rollup_sql(reg: str, load_total: str) -> str:
    placed = _EDGES.format(edges="{e}")
    return f"""
    , {reg}, {placed.format(e='f_lines')}, {placed.format(e='f_links').replace('placed AS', 'joined AS')},
    gen AS (SELECT r.region, carrier, sum(p_nom) AS p_nom FROM f_generators g
            JOIN (SELECT DISTINCT b.province, x.region FROM f_buses b JOIN reg x ON b.name = x.bus) r USING (province) GROUP BY 1, 2),
    {_PATTERN},
    shares AS (SELECT r.region, sum(demand) / (SELECT sum(demand) FROM f_demand) AS share FROM f_demand
               JOIN (SELECT DISTINCT b.province, x.region FROM f_buses b JOIN reg x ON b.name = x.bus) r USING (province) GROUP BY 1)
    SELECT 'buses' AS component, region AS bus, CAST(1 AS BIGINT) AS n, round(max(v_nom), 2) AS total
    FROM f_buses JOIN reg ON name = bus GROUP BY region
    UNION ALL SELECT 'generators', region, count(*), round(sum(p_nom), 2) FROM gen GROUP BY region
    UNION ALL SELECT 'lines', region0, count(*), round(sum(t), 2) FROM
      (SELECT region0, region1, v_nom, sum(num_parallel) AS t FROM placed GROUP BY 1, 2, 3) GROUP BY region0
    UNION ALL SELECT 'links', region0, count(*), round(sum(t), 2) FROM
      (SELECT region0, region1, sum(p_nom) AS t FROM joined GROUP BY 1, 2) GROUP BY region0
    UNION ALL SELECT 'loads', region, 1, round({load_total} * share, 2) FROM shares
    """


@query(
    "aggregate_by_region",
    _rollup_sql(_REG, "(SELECT avg(pattern) FROM pattern)"),
    "f_buses f_region_map f_lines f_links f_generators f_demand f_network_series",
    digits=2,
)
def _aggregate_by_region(t):
    net = _network(t)
    # The old loads sit on a bus that the roll-up removes.
    return _summed_up(runs.aggregate_by_region(net, _settings(t)))


_GROUP_REG = """reg AS (SELECT name AS bus, group1 AS region FROM f_buses JOIN f_region_map ON province = official)"""


@query(
    "aggregate_by_group",
    _rollup_sql(_GROUP_REG, "(SELECT avg(pattern) FROM pattern)"),
    "f_buses f_region_map f_lines f_links f_generators f_demand f_network_series",
    digits=2,
)
def _aggregate_by_group(t):
    net = _network(t)
    out = runs.aggregate_by_region(net, _settings(t, aggregate_regions_by_group=True, region_groups="group1"))
    grouped = t["f_region_map"].select(F.col("group1").alias("bus")).distinct()
    # Units of regions without a group keep their bus; the comparison is about groups.
    return _summed_up(out).join(grouped, "bus", "left_semi").select("component", "bus", "n", "total")
