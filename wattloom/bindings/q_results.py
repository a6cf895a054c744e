"""Named queries: result tables from solved series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Network
from ..operators import results, series
from .registry import query

_DISPATCH = "(SELECT * FROM f_network_series WHERE component = '{c}' AND attribute = '{a}')"
_P = _DISPATCH.format(c="generators", a="p")
_S = _DISPATCH.format(c="storage_units", a="p")
_SOC = _DISPATCH.format(c="storage_units", a="state_of_charge")
_LOAD = _DISPATCH.format(c="loads", a="p_set")
_LINK = _DISPATCH.format(c="links", a="p0")
_LINE = _DISPATCH.format(c="lines", a="p0")
_PU = _DISPATCH.format(c="generators", a="p_max_pu")
_BASE = "f_network_series f_items"


@query(
    "generation_by_carrier",
    f"SELECT snapshot, carrier, round(sum(value), 4) AS value FROM {_P} JOIN f_items USING (name) GROUP BY snapshot, carrier",
    _BASE,
)
def _generation_by_carrier(t):
    return results.generation_by_carrier(t["f_network_series"], t["f_items"])


_SPLIT = f"""
    SELECT snapshot, carrier, round(sum(greatest(value, 0)), 4) AS value, 'discharge' AS kind
    FROM {_S} JOIN f_items USING (name) GROUP BY snapshot, carrier
    UNION ALL SELECT snapshot, carrier || '_charge', round(sum(least(value, 0)), 4), 'charge'
    FROM {_S} JOIN f_items USING (name) GROUP BY snapshot, carrier
"""


@query("storage_split", _SPLIT, _BASE)
def _storage_split(t):
    return results.storage_split(t["f_network_series"], t["f_items"])


@query(
    "generation_and_storage",
    f"""{_SPLIT} UNION ALL SELECT snapshot, carrier, round(sum(value), 4), 'generation'
    FROM {_P} JOIN f_items USING (name) GROUP BY snapshot, carrier
    """,
    _BASE,
)
def _generation_and_storage(t):
    net = Network({"generators": t["f_items"], "storage_units": t["f_items"]}, t["f_network_series"])
    return results.generation_and_storage(net)


@query(
    "state_of_charge",
    f"SELECT snapshot, carrier, round(sum(value), 4) AS value FROM {_SOC} JOIN f_items USING (name) GROUP BY snapshot, carrier",
    _BASE,
)
def _state_of_charge(t):
    return results.state_of_charge(t["f_network_series"], t["f_items"])


@query(
    "load_vs_generation",
    f"""
    SELECT snapshot, 'Generation' AS kind, round(sum(value), 4) AS value FROM {_P} GROUP BY snapshot
    UNION ALL SELECT snapshot, 'Load', round(sum(value), 4) FROM {_LOAD} GROUP BY snapshot
    """,
    "f_network_series",
)
def _load_vs_generation(t):
    return results.load_vs_generation(t["f_network_series"])


@query(
    "carrier_order",
    """
    , named AS (SELECT DISTINCT carrier FROM f_items UNION SELECT DISTINCT carrier || '_charge' FROM f_items)
    SELECT carrier, CAST(CASE carrier WHEN 'c2' THEN 0 WHEN 'c2_charge' THEN 1 WHEN 'c4' THEN 2 WHEN 'c4_charge' THEN 3
      WHEN 'c0' THEN 4 WHEN 'c0_charge' THEN 5 ELSE 6 END AS BIGINT) AS position FROM named
    """,
    "f_items",
)
def _carrier_order(t):
    names = t["f_items"].select("carrier").union(t["f_items"].select(F.concat("carrier", F.lit("_charge"))))
    return results.carrier_order(names, ["c0", "c4", "c2"])


# --- flows --------------------------------------------------------------------------------------

_FLOWS = "f_network_series f_edges"
_ENERGY = "energy AS (SELECT name, sum(abs(value)) AS energy FROM {rows} GROUP BY name)"
_TOP = """top AS (SELECT e.name, e.bus0, e.bus1, x.energy FROM f_edges e JOIN energy x USING (name)
                  ORDER BY round(x.energy, 6) DESC, e.row_id LIMIT {n})"""


@query("flow_totals", f", {_ENERGY.format(rows=_LINE)} SELECT name, round(energy, 4) AS energy FROM energy", "f_network_series")
def _flow_totals(t):
    return results.flow_totals(t["f_network_series"], "lines")


@query(
    "top_flows",
    f", {_ENERGY.format(rows=_LINK)}, {_TOP.format(n=10)} SELECT name, bus0, bus1, round(energy, 4) AS energy FROM top",
    _FLOWS,
)
def _top_flows(t):
    return results.top_flows(t["f_network_series"], t["f_edges"], "links", 10).select("name", "bus0", "bus1", "energy")


@query(
    "flow_series_abs",
    f""", {_ENERGY.format(rows=_LINE)}, {_TOP.format(n=10)}
    SELECT snapshot, name, bus0 || ' → ' || bus1 AS route, round(abs(value), 4) AS value FROM {_LINE} JOIN top USING (name)
    """,
    _FLOWS,
)
def _flow_series_abs(t):
    return results.flow_series_abs(t["f_network_series"], t["f_edges"], "lines", 10)


@query(
    "flow_edges",
    f""", {_ENERGY.format(rows=_LINK)}
    SELECT e.name, round(a.x, 6) AS x0, round(a.y, 6) AS y0, round(z.x, 6) AS x1, round(z.y, 6) AS y1, round(energy, 4) AS energy
    FROM f_edges e JOIN energy USING (name) JOIN f_places a ON bus0 = a.name JOIN f_places z ON bus1 = z.name
    """,
    _FLOWS + " f_places",
    digits=6,
)
def _flow_edges(t):
    out = results.flow_map_edges(t["f_network_series"], t["f_edges"], t["f_places"], "links", None)
    return out.select("name", "x0", "y0", "x1", "y1", F.round("energy", 4).alias("energy"))


@query(
    "flow_map_edges",
    f""", {_ENERGY.format(rows=_LINE)}, {_TOP.format(n=20)}
    SELECT top.name, bus0, bus1, round(a.x, 6) AS x0, round(a.y, 6) AS y0, round(z.x, 6) AS x1, round(z.y, 6) AS y1,
           round(energy, 4) AS energy, round(1 + energy / (SELECT max(energy) FROM top) * 10, 6) AS width
    FROM top JOIN f_places a ON bus0 = a.name JOIN f_places z ON bus1 = z.name
    """,
    _FLOWS + " f_places",
    digits=6,
)
def _flow_map_edges(t):
    out = results.flow_map_edges(t["f_network_series"], t["f_edges"], t["f_places"], "lines", 20)
    return out.withColumn("energy", F.round("energy", 4))


@query(
    "flow_buses",
    f""", {_ENERGY.format(rows=_LINE)}, {_TOP.format(n=20)}
    SELECT name, round(x, 6) AS x, round(y, 6) AS y FROM f_places WHERE name IN (SELECT bus0 FROM top UNION SELECT bus1 FROM top)
    """,
    _FLOWS + " f_places",
    digits=6,
)
def _flow_buses(t):
    return results.flow_buses(t["f_network_series"], t["f_edges"], t["f_places"], "lines", 20)


@query(
    "flow_series_signed",
    f"""
    SELECT snapshot, name, 'Link: ' || bus0 || ' → ' || bus1 AS label, round(value, 4) AS value FROM {_LINK} JOIN f_edges USING (name)
    UNION ALL
    SELECT snapshot, name, 'Line: ' || bus0 || ' → ' || bus1, round(value, 4) FROM {_LINE} JOIN f_edges USING (name)
    """,
    _FLOWS,
)
def _flow_series_signed(t):
    return results.flow_series_signed(t["f_network_series"], t["f_edges"], t["f_edges"])


@query(
    "flow_stats",
    f"""
    SELECT name, bus0, bus1, s_nom AS capacity, round(avg(value), 9) AS mean_flow, round(max(value), 9) AS max_flow,
           round(min(value), 9) AS min_flow, round(max(abs(value)) / s_nom * 100, 9) AS utilization, min(value) < 0 AS reverse
    FROM {_LINE} JOIN f_edges USING (name) GROUP BY name, bus0, bus1, s_nom
    """,
    _FLOWS,
    digits=9,
)
def _flow_stats(t):
    return results.flow_stats(t["f_network_series"], t["f_edges"], "lines")


@query(
    "edge_config",
    """
    SELECT 'link' AS kind, name, bus0, bus1, p_nom AS capacity, round(efficiency, 4) AS efficiency, p_min_pu < 0 AS bidirectional FROM f_links
    UNION ALL SELECT 'line', name, bus0, bus1, s_nom, NULL, NULL FROM f_lines
    """,
    "f_links f_lines",
)
def _edge_config(t):
    return results.edge_config(t["f_links"], t["f_lines"])


# --- diagnostics --------------------------------------------------------------------------------


def _diagnosed(t) -> Network:
    units = t["f_items"].withColumns(
        {
            "e_sum_max": F.col("p_nom") * 10,
            "e_sum_min": F.col("p_nom") * 2,
            "ramp_limit_up": F.when(F.col("carrier") != "c4", F.col("p_nom") / 100),
        }
    )
    return Network({"generators": units}, t["f_network_series"], series.snapshot_dimension(t["f_snapshots"]))


@query(
    "network_diagnostics",
    f"""
    , c AS (SELECT carrier, sum(p_nom) AS p, avg(p_nom / 100) AS ramp FROM f_items GROUP BY carrier),
    l AS (SELECT snapshot, sum(value) AS load FROM {_LOAD} GROUP BY snapshot),
    pu AS (SELECT name, avg(value) AS a, max(value) AS x, min(value) AS n FROM {_PU} GROUP BY name)
    SELECT 'snapshots' AS section, 'all' AS key, 'count' AS metric, round(CAST(count(*) AS DOUBLE), 9) AS value FROM f_snapshots
    UNION ALL SELECT 'snapshots', 'all', 'step_hours', 1.0
    UNION ALL SELECT 'snapshots', 'all', 'total_hours', CAST(count(*) AS DOUBLE) FROM f_snapshots
    UNION ALL SELECT 'capacity', carrier, 'p_nom', round(p, 9) FROM c
    UNION ALL SELECT 'energy', carrier, 'e_sum_max', round(p * 10, 9) FROM c
    UNION ALL SELECT 'energy', carrier, 'e_sum_min', round(p * 2, 9) FROM c
    UNION ALL SELECT 'ramp', carrier, 'ramp_limit_up', round(ramp, 9) FROM c WHERE carrier <> 'c4'
    UNION ALL SELECT 'p_max_pu', name, 'mean', round(a, 9) FROM pu
    UNION ALL SELECT 'p_max_pu', name, 'max', round(x, 9) FROM pu
    UNION ALL SELECT 'p_max_pu', name, 'min', round(n, 9) FROM pu
    UNION ALL SELECT 'load', 'all', 'total', round(sum(load), 9) FROM l
    UNION ALL SELECT 'load', 'all', 'average', round(avg(load), 9) FROM l
    UNION ALL SELECT 'load', 'all', 'peak', round(max(load), 9) FROM l
    """,
    _BASE + " f_snapshots",
    digits=9,
)
def _network_diagnostics(t):
    return results.network_diagnostics(_diagnosed(t))


_FEW = "(SELECT snapshot FROM f_snapshots ORDER BY snapshot LIMIT 5)"


@query(
    "adequacy_check",
    f"""
    , pu AS (SELECT name, snapshot, value FROM {_PU} WHERE substr(name, 3, 1) = '' ),
    members AS (SELECT DISTINCT name FROM pu),
    w AS {_FEW},
    v AS (SELECT w.snapshot, sum(p_nom * value) AS s, count(value) AS n FROM w LEFT JOIN pu USING (snapshot)
          LEFT JOIN f_items USING (name) GROUP BY w.snapshot),
    l AS (SELECT w.snapshot, coalesce(sum(value), 0) AS load FROM w LEFT JOIN {_LOAD} USING (snapshot) GROUP BY w.snapshot),
    a AS (SELECT snapshot, CASE WHEN n = (SELECT count(*) FROM members) THEN coalesce(s, 0) +
            (SELECT sum(p_nom) FROM f_items WHERE name NOT IN (SELECT name FROM members)) END AS available FROM v)
    SELECT snapshot, round(available, 4) AS available, round(load, 4) AS load,
           round(CASE WHEN available < load THEN load - available END, 4) AS deficit
    FROM a JOIN l USING (snapshot)
    """,
    _BASE + " f_snapshots",
)
def _adequacy_check(t):
    # Only a few units keep a series, so that some snapshots are complete and others are not.
    short = (F.col("attribute") != "p_max_pu") | (F.length("name") < 3)
    net = Network(
        {"generators": t["f_items"]}, t["f_network_series"].where(short), series.snapshot_dimension(t["f_snapshots"])
    )
    return results.adequacy_check(net)


def _effect(hours: int, few: str) -> str:
    return f"""
    , pu AS (SELECT name, snapshot, value FROM {_PU} {few}), a AS (SELECT date_trunc('day', min(snapshot)) AS a FROM f_snapshots),
    o AS (SELECT name, avg(value) AS om, max(value) AS ox FROM pu GROUP BY name),
    b AS (SELECT name, date_diff('hour', (SELECT a FROM a), snapshot) // {hours} AS b, avg(value) AS m, max(value) AS x FROM pu GROUP BY 1, 2),
    f AS (SELECT name, avg(m) AS mm, max(m) AS mx, avg(x) AS xm, max(x) AS xx FROM b GROUP BY name)
    SELECT name, round(om, 13) AS original_mean, round(ox, 13) AS original_max, round(mm, 13) AS mean_rule_mean, round(mx, 13) AS mean_rule_max,
           round(xm, 13) AS max_rule_mean, round(xx, 13) AS max_rule_max, round((om - mm) / om * 100, 9) AS loss_percent
    FROM o JOIN f USING (name)
    """


@query("resample_effect", _effect(4, ""), "f_network_series f_snapshots", digits={"loss_percent": 9, "": 13})
def _resample_effect(t):
    return results.resample_effect(t["f_network_series"], series.snapshot_dimension(t["f_snapshots"]), 4, None)


@query(
    "resample_effect_report",
    _effect(6, "WHERE name IN (SELECT DISTINCT name FROM f_series ORDER BY name LIMIT 5)"),
    "f_network_series f_series f_snapshots",
    digits={"loss_percent": 9, "": 13},
)
def _resample_effect_report(t):
    return results.resample_effect(t["f_network_series"], series.snapshot_dimension(t["f_snapshots"]), 6, 5)
