"""Named queries: clustering, nearest sites, addresses and network extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ROW_ID
from ..operators import places, spatial
from ..plans import extraction
from ..sources import settings
from .registry import query

# Metres at which a fair share of the buses has a neighbour.
_TOL = 30_000.0


def _bus_points(t):
    return t["f_buses"].select(
        F.col(ROW_ID).alias("row_id"), "x", "y", F.col("v_nom").alias("voltage"),
        F.when(F.col(ROW_ID) % 3 == 0, F.col("name")).alias("name"),
    )


_EPS = _TOL / 111000.0
_SIDE = spatial.cell_side(_EPS)

# Every bus is compared with all others here, which only SQL on few buses can afford.
_NEAR = f"""
    , near AS (SELECT a.row_id AS a, b.row_id AS b FROM f_buses a, f_buses b
               WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= ({_TOL} / 111000.0) ** 2),
    reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
    c AS (SELECT a AS row_id, min(b) AS c FROM reach GROUP BY a)"""


@query(
    "eps_neighbours",
    f"""
    , p AS (SELECT DISTINCT x, y, CAST(floor(x / {_SIDE!r}) AS BIGINT) AS gx, CAST(floor(y / {_SIDE!r}) AS BIGINT) AS gy FROM f_buses)
    SELECT DISTINCT a.gx * 4294967296 + a.gy AS cell_a, b.gx * 4294967296 + b.gy AS cell_b FROM p a, p b
    WHERE (b.gx > a.gx OR (b.gx = a.gx AND b.gy > a.gy)) AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {_EPS * _EPS!r}
    """,
    "f_buses",
)
def _eps_neighbours(t):
    return spatial.eps_neighbours(t["f_buses"], _EPS)


@query("cluster_points", f"{_NEAR} SELECT row_id, c AS cluster FROM c", "f_buses")
def _cluster_points(t):
    # A cluster under the id of its first point.
    found = spatial.cluster_points(_bus_points(t), _TOL)
    first = found.groupBy("component").agg(F.min("row_id").alias("cluster"))
    return found.join(first, "component").select("row_id", "cluster")


# Reachability by repeated widening.
@query(
    "cluster_buses",
    f"""{_NEAR},
    g AS (SELECT c, avg(x) AS x, avg(y) AS y, max(v_nom) AS v_nom, count(*) AS cluster_size,
                 arg_min(CASE WHEN row_id % 3 = 0 THEN name END, row_id) FILTER (WHERE row_id % 3 = 0) AS sub
          FROM f_buses JOIN c USING (row_id) GROUP BY c)
    SELECT row_number() OVER (ORDER BY c) - 1 AS bus_id, coalesce(sub, 'bus_' || CAST(row_number() OVER (ORDER BY c) - 1 AS VARCHAR)) AS name,
           round(x, 6) AS x, round(y, 6) AS y, v_nom, cluster_size FROM g
    """,
    "f_buses",
    digits=6,
)
def _cluster_buses(t):
    return spatial.cluster_buses(_bus_points(t), _TOL)


@query(
    "nearest_bus",
    """
    , spots AS (SELECT DISTINCT 124.0 + (c_custkey * 31 % 977) * 0.00511 AS x, 33.0 + (c_custkey * 17 % 991) * 0.00507 AS y FROM customer)
    SELECT round(p.x, 5) AS x, round(p.y, 5) AS y, arg_min(b.row_id, (p.x - b.x) ** 2 + (p.y - b.y) ** 2) AS bus_id
    FROM (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM spots) p, f_buses b GROUP BY p.x, p.y
    """,
    "f_buses",
    digits=5,
)
def _nearest_bus(t):
    spots = t["customer"].select(
        (F.lit(124.0) + (F.col("c_custkey") * 31 % 977) * F.lit(0.00511)).alias("x"),
        (F.lit(33.0) + (F.col("c_custkey") * 17 % 991) * F.lit(0.00507)).alias("y"),
    )
    return spatial.nearest(spots, t["f_buses"].select("x", "y", F.col(ROW_ID).alias("bus_id")))


@query(
    "gazetteer_match",
    """
    , cut AS (SELECT row_id, address, regexp_split_to_array(trim(split_part(address, '(', 1)), '\\s+') AS w FROM f_addresses),
    c AS (SELECT row_id, 2 * (len(w) - n) + 1 AS priority, array_to_string(list_slice(w, 1, n), ' ') AS a FROM cut, range(2, 9) r(n) WHERE n <= len(w)),
    cand AS (SELECT * FROM c UNION ALL SELECT row_id, priority + 1, replace(a, '군', '시') FROM c WHERE contains(a, '군')),
    hit AS (SELECT row_id, arg_min(g.x, priority) AS x, arg_min(g.y, priority) AS y FROM cand JOIN f_gazetteer g ON cand.a = g.address GROUP BY row_id)
    SELECT f.row_id, f.address, hit.x, hit.y FROM f_addresses f LEFT JOIN hit USING (row_id)
    """,
    "f_addresses f_gazetteer",
)
def _gazetteer_match(t):
    return places.gazetteer_match(t["f_addresses"], t["f_gazetteer"])


_LEVELS = """levels AS (SELECT *, CASE row_id % 8 WHEN 0 THEN '강원' WHEN 1 THEN '강원' WHEN 2 THEN '전북' WHEN 3 THEN '전남' WHEN 4 THEN ''
                          WHEN 5 THEN '서울' WHEN 6 THEN '경기' WHEN 7 THEN '' END AS region_1,
               CASE row_id % 8 WHEN 0 THEN '춘천시' WHEN 5 THEN 'district ' || grp WHEN 6 THEN '수원시' WHEN 7 THEN 'Nowhere'
                 ELSE 'county ' || province END AS region_2 FROM f_buses)"""


@query("reverse_match", f", {_LEVELS} SELECT name, region_1, region_2 FROM levels", "f_buses f_address_parts f_korea")
def _reverse_match(t):
    mapping = settings.region_map(t["f_korea"])
    return places.reverse_match(t["f_buses"].select("name", "x", "y"), t["f_address_parts"], mapping).select(
        "name", "region_1", "region_2"
    )


@query(
    "strip_admin_suffix",
    """
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '강원' WHEN 1 THEN '강원' WHEN 2 THEN '전북' WHEN 3 THEN 'Atlantis' WHEN 4 THEN '서울' ELSE '강원' END AS region
    FROM customer
    """,
)
def _strip_admin_suffix(t):
    n = F.col("c_custkey") % 6
    raw = (
        F.when(n == 0, "강원특별자치도").when(n == 1, "Gangwon State").when(n == 2, " North Jeolla ").when(n == 3, "Atlantis")
        .when(n == 4, "서울시").otherwise("강원도")
    )
    lookup = places.region_lookup(settings.region_map(t["f_korea"]))
    return t["customer"].select("c_custkey", places.strip_admin_suffix(raw, lookup).alias("region"))


@query(
    "infer_province",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '경기' WHEN 1 THEN '강원' WHEN 2 THEN NULL ELSE '경기' END AS region FROM customer",
)
def _infer_province(t):
    n = F.col("c_custkey") % 4
    city = F.when(n == 0, " 수원시 ").when(n == 1, "Chuncheon").when(n == 2, "Nowhere").otherwise("Gwangju")
    lookup = places.region_lookup(settings.region_map(t["f_korea"]))
    return t["customer"].select("c_custkey", places.infer_region(city, lookup).alias("region"))


# --- extraction ---------------------------------------------------------------------------------

_PREPARED = r"""pts AS (SELECT line_id, TRY_CAST(regexp_extract(voltage, '(\d+)', 1) AS DOUBLE) / 1000 AS raw, coalesce(circuits, 1) AS circuits,
                        CASE WHEN lonlat LIKE '[%' THEN CAST(lonlat AS DOUBLE[][]) END AS p FROM f_features),
                prepared AS (SELECT line_id, raw AS voltage, CAST(circuits AS BIGINT) AS circuits, p[1][1] AS x0, p[1][2] AS y0, p[2][1] AS x1, p[2][2] AS y1,
                             sqrt((p[2][1] - p[1][1]) ** 2 + (p[2][2] - p[1][2]) ** 2) * 111.0 AS length FROM pts
                             WHERE raw >= 0.3 AND sqrt((p[2][1] - p[1][1]) ** 2 + (p[2][2] - p[1][2]) ** 2) > 0)"""


def _features(t):
    return t["f_features"]


@query(
    "prepare_lines",
    f""", {_PREPARED}
    SELECT line_id, round(voltage, 6) AS voltage, circuits, x0, y0, x1, y1, round(length, 6) AS length FROM prepared
    """,
    "f_features",
    digits=6,
)
def _prepare_lines(t):
    lines = extraction.prepared_lines(_features(t), 0.3)
    return lines.select(
        "line_id", "voltage", "circuits", F.col("start.x").alias("x0"), F.col("start.y").alias("y0"),
        F.col("end.x").alias("x1"), F.col("end.y").alias("y1"), "length",
    )


def _network(t):
    features = _features(t)
    halves = [features.where("line_id % 2 = 0"), features.where("line_id % 2 = 1").drop("circuits")]
    return extraction.build_network(halves, t["f_substations"], voltage_min_kv=0.3, tolerance=60_000.0)


_WIDE = 60_000.0 / 111000.0
_WIDE_SIDE = spatial.cell_side(_WIDE)

# Clusters are components of the cells of all points; every pair of spots in cells close to each other is measured.
_BUILT = f""", {_PREPARED},
    points AS (SELECT line_id * 2 AS row_id, x0 AS x, y0 AS y, voltage, CAST(NULL AS VARCHAR) AS name FROM prepared
               UNION ALL SELECT line_id * 2 + 1, x1, y1, voltage, NULL FROM prepared
               UNION ALL SELECT 2305843009213693952 + substation_id, lon, lat,
                 coalesce(TRY_CAST(trim(replace(voltage, 'kV', '')) AS DOUBLE), 220.0) / 1000, name FROM f_substations),
    spots AS (SELECT DISTINCT x, y, CAST(floor(x / {_WIDE_SIDE!r}) AS BIGINT) AS gx, CAST(floor(y / {_WIDE_SIDE!r}) AS BIGINT) AS gy FROM points),
    steps AS (SELECT dx, dy FROM range(-2, 3) a(dx), range(-2, 3) b(dy)),
    edges AS (SELECT DISTINCT a.gx * 4294967296 + a.gy AS a, b.gx * 4294967296 + b.gy AS b
              FROM spots a, steps JOIN spots b ON b.gx = a.gx + dx AND b.gy = a.gy + dy
              WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {_WIDE * _WIDE!r}),
    reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    labels AS (SELECT a AS cell, min(b) AS component FROM reach GROUP BY a),
    placed AS (SELECT p.*, component FROM points p JOIN spots s ON p.x = s.x AND p.y = s.y JOIN labels ON cell = gx * 4294967296 + gy),
    clusters AS (SELECT avg(x) AS x, avg(y) AS y, max(voltage) AS v_nom, count(*) AS cluster_size, min(row_id) AS first,
                   arg_min(name, row_id) FILTER (WHERE name <> '') AS sub FROM placed GROUP BY component),
    buses AS (SELECT row_number() OVER (ORDER BY first) - 1 AS bus_id, * FROM clusters),
    ends AS (SELECT x0 AS x, y0 AS y FROM prepared UNION SELECT x1, y1 FROM prepared),
    found AS (SELECT e.x, e.y, arg_min(bus_id, ROW((e.x - b.x) ** 2 + (e.y - b.y) ** 2, bus_id)) AS bus FROM ends e, buses b GROUP BY e.x, e.y)
"""


@query(
    "build_network",
    f"""{_BUILT}
    SELECT line_id, a.bus AS bus0, b.bus AS bus1, round(voltage, 6) AS voltage,
           CASE WHEN line_id % 2 = 0 THEN circuits ELSE 1 END AS circuits, round(length, 6) AS length
    FROM prepared JOIN found a ON a.x = x0 AND a.y = y0 JOIN found b ON b.x = x1 AND b.y = y1
    """,
    "f_features f_substations",
    digits=6,
)
def _build_network(t):
    _, lines = _network(t)
    return lines.select("line_id", "bus0", "bus1", "voltage", "circuits", "length")


@query(
    "build_network_buses",
    f"""{_BUILT}
    SELECT bus_id, coalesce(sub, 'bus_' || CAST(bus_id AS VARCHAR)) AS name, round(x, 6) AS x, round(y, 6) AS y,
           round(v_nom, 6) AS v_nom, cluster_size FROM buses
    """,
    "f_features f_substations",
    digits=6,
)
def _build_network_buses(t):
    buses, _ = _network(t)
    return buses


@query(
    "export_network",
    f""", {_PREPARED}
    SELECT CAST(line_id AS VARCHAR) AS name, 'b0' AS bus0, 'b1' AS bus1, round(length, 6) AS length, circuits,
           round(CASE WHEN voltage >= 380 THEN 0.05 WHEN voltage >= 220 THEN 0.1 ELSE 0.2 END * (length / circuits), 6) AS r,
           round(CASE WHEN voltage >= 380 THEN 0.25 WHEN voltage >= 220 THEN 0.3 ELSE 0.35 END * (length / circuits), 6) AS x,
           CAST(0 AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS s_nom, circuits AS num_parallel, round(voltage, 6) AS v_nom
    FROM prepared
    """,
    "f_features",
    digits=6,
)
def _export_network(t):
    lines = extraction.prepared_lines(_features(t), 0.3).withColumns({"bus0": F.lit("b0"), "bus1": F.lit("b1")})
    buses = t["f_buses"].select(F.col(ROW_ID).alias("bus_id"), "name", "x", "y", "v_nom")
    return extraction.export_network(buses, lines, "kr")["lines"]


@query(
    "export_network_meta",
    "SELECT 'KR_network' AS name, CAST(1 AS BIGINT) AS snapshots, (SELECT count(*) FROM f_buses) AS buses, (SELECT count(*) FROM f_lines) AS lines",
    "f_buses f_lines",
)
def _export_network_meta(t):
    buses = t["f_buses"].select(F.col(ROW_ID).alias("bus_id"), "name", "x", "y", "v_nom")
    lines = t["f_lines"].select(F.col("name").alias("line_id"), "bus0", "bus1", "length", F.col("num_parallel").alias("circuits"), F.col("v_nom").alias("voltage"))
    return extraction.export_network(buses, lines, "kr")["network"]
