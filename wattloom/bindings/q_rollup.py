"""Named queries: merging and aggregating units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import leader_row
from ..model import ROW_ID
from ..operators import columns, rollup
from ..sources import settings
from .registry import query

CARRIER_RULES = {
    "carrier": "carrier",
    "province": "region",
    "bus": "region",
    "p_nom": "sum",
    "efficiency": "mean",
    "marginal_cost": "mean",
    "build_year": "oldest",
    "close_year": "newest",
    "capital_cost": "sum",
    "grp": "remove",
    "market": "M",
    "others": "p_nom",
}


@query(
    "agg_carrier_region",
    """
    , alive AS (SELECT * FROM f_generators WHERE build_year <= 1998 AND (close_year > 1998 OR close_year IS NULL)),
    led AS (SELECT *, row_number() OVER (PARTITION BY carrier, province ORDER BY p_nom DESC NULLS LAST, row_id) AS i FROM alive)
    SELECT carrier || '_' || province AS name, coalesce(max(short), province) AS bus, carrier, province,
           round(sum(p_nom), 4) AS p_nom, round(avg(efficiency), 9) AS efficiency,
           round(avg(marginal_cost), 9) AS marginal_cost, CAST(min(build_year) AS BIGINT) AS build_year,
           CAST(max(close_year) AS BIGINT) AS close_year, max(CASE WHEN i = 1 THEN cc_group END) AS cc_group,
           round(coalesce(sum(capital_cost), 0), 2) AS capital_cost, 'M' AS market,
           max(CASE WHEN i = 1 THEN control END) AS control
    FROM led LEFT JOIN f_region_map ON province = official
    GROUP BY carrier, province
    """,
    "f_generators f_region_map",
    digits={"capital_cost": 2, "": 9},
)
def _agg_carrier_region(t):
    alive = columns.lifecycle(t["f_generators"], 1998)
    regions = settings.region_map(t["f_region_map"])
    out = rollup.aggregate_by_carrier(alive, CARRIER_RULES, "province", regions)
    return out.drop(ROW_ID)


@query(
    "agg_carrier",
    """
    SELECT carrier || '_aggregated' AS name, carrier, round(sum(p_nom), 4) AS p_nom, CAST(min(build_year) AS BIGINT) AS build_year
    FROM f_generators GROUP BY carrier
    """,
    "f_generators",
)
def _agg_carrier(t):
    rules = {"carrier": "carrier", "p_nom": "sum", "build_year": "smallest", "others": "remove"}
    # No such region column: falls back to carriers alone.
    return rollup.aggregate_by_carrier(t["f_generators"], rules, "no_such_column").drop(ROW_ID)


CC_RULES = {
    "cc_group": "cc_group",
    "p_nom": "sum",
    "efficiency": "mean",
    "marginal_cost": "mean",
    "build_year": "oldest",
    "close_year": "newest",
    "capital_cost": "largest",
    "others": "p_nom",
}


@query(
    "merge_cc",
    """
    , sized AS (SELECT *, count(*) OVER (PARTITION BY cc_group) AS n,
                       row_number() OVER (PARTITION BY cc_group ORDER BY p_nom DESC NULLS LAST, row_id) AS i
                FROM f_generators WHERE cc_group IS NOT NULL),
    merged AS (
      SELECT cc_group || '_CC' AS name, max(CASE WHEN i = 1 THEN bus END) AS bus, max(CASE WHEN i = 1 THEN carrier END) AS carrier,
             max(CASE WHEN i = 1 THEN province END) AS province, sum(p_nom) AS p_nom, avg(efficiency) AS efficiency,
             avg(marginal_cost) AS marginal_cost, min(build_year) AS build_year, max(close_year) AS close_year, cc_group,
             max(capital_cost) AS capital_cost, max(CASE WHEN i = 1 THEN control END) AS control
      FROM sized WHERE n > 1 GROUP BY cc_group)
    SELECT name, bus, carrier, province, round(p_nom, 4) AS p_nom, round(efficiency, 9) AS efficiency,
           round(marginal_cost, 9) AS marginal_cost, CAST(build_year AS BIGINT) AS build_year,
           CAST(close_year AS BIGINT) AS close_year, cc_group, capital_cost, control
    FROM (SELECT * FROM merged UNION ALL
          SELECT g.name, g.bus, g.carrier, g.province, g.p_nom, g.efficiency, g.marginal_cost, g.build_year, g.close_year,
                 g.cc_group, g.capital_cost, g.control
          FROM f_generators g LEFT JOIN merged m ON g.cc_group = m.cc_group WHERE m.cc_group IS NULL)
    """,
    "f_generators",
    digits=9,
)
def _merge_cc(t):
    units = t["f_generators"].drop("grp", "market")
    return rollup.merge_cc(units, CC_RULES).drop(ROW_ID)


@query(
    "merge_cc_simple",
    """
    , led AS (SELECT *, row_number() OVER (PARTITION BY cc_group ORDER BY CASE WHEN contains(name, '7') THEN 0 ELSE 1 END, row_id) AS i
              FROM f_generators WHERE cc_group IS NOT NULL),
    merged AS (SELECT cc_group AS name, max(CASE WHEN i = 1 THEN bus END) AS bus, max(CASE WHEN i = 1 THEN carrier END) AS carrier,
                      sum(p_nom) AS p_nom, cc_group FROM led GROUP BY cc_group)
    SELECT name, bus, carrier, round(p_nom, 4) AS p_nom, cc_group FROM merged
    UNION ALL SELECT name, bus, carrier, round(p_nom, 4), cc_group FROM f_generators WHERE cc_group IS NULL
    """,
    "f_generators",
)
def _merge_cc_simple(t):
    # Names are made of digits here, so those with a 7 stand in for gas turbines.
    marked = t["f_generators"].withColumn("name", F.when(F.contains("name", F.lit("7")), F.concat("name", F.lit("GT"))).otherwise(F.col("name")))
    out = rollup.merge_cc_simple(marked.select("name", "bus", "carrier", "p_nom", "cc_group", ROW_ID))
    return out.withColumn("name", F.regexp_replace("name", "GT$", "")).drop(ROW_ID)


@query(
    "cc_summary",
    """
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS units, count(*) AS groups, max(n) AS largest
    FROM (SELECT cc_group, count(*) AS n FROM f_generators WHERE cc_group IS NOT NULL GROUP BY cc_group)
    """,
    "f_generators",
)
def _cc_summary(t):
    return rollup.cc_summary(t["f_generators"])


@query(
    "facility_rollup",
    """
    SELECT province || '_' || carrier AS name, carrier, province, market, round(sum(p_nom), 4) AS p_nom
    FROM f_generators GROUP BY carrier, province, market
    """,
    "f_generators",
)
def _facility_rollup(t):
    return rollup.facility_rollup(t["f_generators"], ["carrier", "province", "market"], "p_nom", ["province", "carrier"])


@query(
    "first_max_row",
    """
    SELECT province, name, p_nom FROM (
      SELECT *, row_number() OVER (PARTITION BY province ORDER BY p_nom DESC NULLS LAST, row_id) AS i FROM f_generators)
    WHERE i = 1
    """,
    "f_generators",
)
def _first_max_row(t):
    led = t["f_generators"].groupBy("province").agg(leader_row(["name", "p_nom"]).alias("l"))
    return led.select("province", "l.*")


_MEMBERS = "SELECT name, carrier || '_' || province AS new_name FROM f_items"


@query(
    "agg_generator_series",
    f"""
    , members AS ({_MEMBERS})
    SELECT 'generators' AS component, attribute, new_name AS name, snapshot,
           round(CASE attribute WHEN 'p' THEN sum(value) WHEN 'fuel_cost' THEN max(value) ELSE avg(value) END, 8) AS value
    FROM f_network_series JOIN members USING (name)
    WHERE component = 'generators' GROUP BY attribute, new_name, snapshot
    """,
    "f_network_series f_items",
    digits=8,
)
def _agg_generator_series(t):
    members = rollup.membership(t["f_items"], "province")
    rules = {"p": "sum", "fuel_cost": "max", "others": "no such rule"}
    out = rollup.aggregate_generator_series(t["f_network_series"], members, rules)
    return out.where(F.col("component") == "generators")


@query(
    "series_members",
    f"""
    , members AS ({_MEMBERS}),
    folded AS (SELECT attribute, new_name AS name, snapshot, sum(value) AS value FROM f_network_series JOIN members USING (name)
               WHERE component = 'generators' GROUP BY attribute, new_name, snapshot),
    size AS (SELECT new_name AS name, count(*) AS members FROM members GROUP BY new_name)
    SELECT name, members, attribute, count(value) AS snapshots, round(sum(value), 3) AS total
    FROM size LEFT JOIN folded USING (name) GROUP BY name, members, attribute
    """,
    "f_items f_network_series",
    digits=3,
)
def _series_members(t):
    members = rollup.membership(t["f_items"], "province")
    out = rollup.aggregate_generator_series(t["f_network_series"], members, {"others": "sum"}).where("component = 'generators'")
    per_unit = out.groupBy("name", "attribute").agg(F.count("value").alias("snapshots"), F.sum("value").alias("total"))
    size = members.groupBy(F.col("new_name").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    return size.join(per_unit, "name", "left").select(
        "name", "members", "attribute", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), "total"
    )


@query(
    "tag_cc_group",
    r"""
    , named AS (SELECT row_id, province || CASE row_id % 7 WHEN 0 THEN ' #5~8 GT_1' WHEN 1 THEN ' #5-8 ST 2' WHEN 2 THEN '#1 GT'
                  WHEN 3 THEN '  ST ' WHEN 4 THEN ' GT_x' WHEN 5 THEN '' ELSE ' A GT  12' END AS name,
                  CASE WHEN row_id % 3 = 0 THEN 'CC' WHEN row_id % 3 = 1 THEN ' 복합 ' ELSE 'ST' END AS type FROM f_customers),
    cut AS (SELECT row_id, name, type, trim(name) AS n, trim(type) AS ty FROM named)
    SELECT row_id, name, CASE WHEN ty IN ('CC', '복합') THEN coalesce(
             nullif(regexp_extract(n, '^(.+)\s+(GT|ST)_\d+$', 1), ''),
             nullif(regexp_extract(n, '^(.+)\s+(GT|ST)\s+\d+$', 1), ''),
             nullif(regexp_extract(n, '^(.*) (GT|ST)$', 1), '')) END AS cc_group
    FROM cut
    """,
    "f_customers",
)
def _tag_cc_group(t):
    n = F.col(ROW_ID) % 7
    ending = (
        F.when(n == 0, " #5~8 GT_1").when(n == 1, " #5-8 ST 2").when(n == 2, "#1 GT").when(n == 3, "  ST ")
        .when(n == 4, " GT_x").when(n == 5, "").otherwise(" A GT  12")
    )
    kind = F.when(F.col(ROW_ID) % 3 == 0, "CC").when(F.col(ROW_ID) % 3 == 1, " 복합 ").otherwise("ST")
    named = t["f_customers"].select(ROW_ID, F.concat("province", ending).alias("name"), kind.alias("type"))
    return columns.tag_cc_group(named).drop("type")
