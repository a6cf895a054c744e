"""Named queries: the series table, snapshots, years and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..model import Network
from ..operators import series
from ..plans import runs
from ..sources import tables
from .registry import query

_WIDE = """
    SELECT snapshot, max(CASE WHEN name = 'u1' THEN value END) AS u1, max(CASE WHEN name = 'u2' THEN value END) AS u2,
           max(CASE WHEN name = 'u3' THEN value END) AS u3 FROM f_series WHERE name IN ('u1', 'u2', 'u3') GROUP BY snapshot
"""
NAMES = ["u1", "u2", "u3"]


def _wide(t):
    return series.wide_export(t["f_series"], NAMES)


@query("wide_export", _WIDE, "f_series")
def _wide_export(t):
    return _wide(t)


@query("wide_export_all", "SELECT 'loads' AS component, 'p_set' AS attribute, name, snapshot, round(value, 4) AS value FROM f_series", "f_series")
def _wide_export_all(t):
    """All names in blocks of columns and back."""
    rows = t["f_series"].select("name", "snapshot", "value")
    slots = series.name_slots(rows, 50)
    back = series.from_wide_blocks(series.wide_blocks(rows, slots), slots, "loads", "p_set")
    # A name has a value at the snapshots it came with; blocks know all snapshots of their names.
    return back.join(rows.select("name", "snapshot"), ["name", "snapshot"], "left_semi").select("component", "attribute", "name", "snapshot", "value")


@query(
    "wide_files_all",
    "SELECT 'loads' AS component, 'p_set' AS attribute, name, snapshot, round(value, 4) AS value FROM f_series WHERE value IS NOT NULL",
    "f_series",
)
def _wide_files_all(t):
    """All names as CSV files of many columns, read back cell by cell."""
    folder = t.scratch("wide")
    tables.write_wide_series(t["f_series"].select("name", "snapshot", "value"), folder, 50)
    return tables.read_wide_series(t.spark, folder, "loads", "p_set", parts=True).where("value IS NOT NULL")


@query(
    "series_unpivot",
    f"""
    , wide AS ({_WIDE}), long AS (SELECT s.snapshot, n.name, w FROM wide s
      JOIN (VALUES ('u1'), ('u2'), ('u3')) n(name) ON TRUE, LATERAL (SELECT CASE n.name WHEN 'u1' THEN u1 WHEN 'u2' THEN u2 ELSE u3 END AS w))
    SELECT 'loads' AS component, 'p_set' AS attribute, name, snapshot, round(w, 4) AS value FROM long
    """,
    "f_series",
)
def _series_unpivot(t):
    wide = _wide(t).withColumn("snapshot", F.date_format("snapshot", "dd/MM/yyyy HH:mm"))
    return series.unpivot(wide, "loads", "p_set")


@query(
    "series_catalog",
    "SELECT component, attribute, count(DISTINCT name) AS n_names FROM f_network_series GROUP BY component, attribute",
    "f_network_series",
)
def _series_catalog(t):
    return series.catalog(t["f_network_series"])


_GAPPY = "gappy AS (SELECT name, snapshot, CASE WHEN hour(snapshot) % 3 > 0 THEN value END AS value FROM f_series)"


def _gappy(t):
    rows = t["f_series"].withColumn("value", F.when(F.hour("snapshot") % 3 > 0, F.col("value")))
    return rows.select(F.lit("loads").alias("component"), F.lit("p_set").alias("attribute"), "name", "snapshot", "value")


@query(
    "ffill_series",
    f""", {_GAPPY}
    SELECT name, snapshot, round(last_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY snapshot
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM gappy
    """,
    "f_series",
)
def _ffill_series(t):
    return series.forward_fill(_gappy(t)).select("name", "snapshot", "value")


@query(
    "limit_snapshots",
    """
    , kept AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) - 1 AS pos FROM f_snapshots
               WHERE snapshot >= TIMESTAMP '2024-01-05 07:00:00' ORDER BY snapshot LIMIT 100)
    SELECT s.name, s.snapshot, k.pos, round(s.value, 4) AS value FROM f_series s JOIN kept k ON s.snapshot = k.snapshot
    """,
    "f_series f_snapshots",
)
def _limit_snapshots(t):
    dimension = series.snapshot_dimension(t["f_snapshots"])
    kept = series.limited_snapshots(dimension, "05/01/2024 07:00", 100)
    return series.within(t["f_series"], kept).join(kept.select("snapshot", "pos"), "snapshot")


@query(
    "first_n_snapshots",
    "SELECT snapshot FROM f_snapshots ORDER BY snapshot LIMIT 48",
    "f_snapshots",
)
def _first_n_snapshots(t):
    return series.first_snapshots(series.snapshot_dimension(t["f_snapshots"]), 48).select("snapshot")


@query(
    "optimization_range",
    "SELECT snapshot FROM (SELECT snapshot, row_number() OVER (ORDER BY snapshot) - 1 AS pos FROM f_snapshots) WHERE pos >= 2 AND pos < 25",
    "f_snapshots",
)
def _optimization_range(t):
    return series.optimization_range(series.snapshot_dimension(t["f_snapshots"]), 10, 100, 4).select("snapshot")


@query("total_hours", "SELECT CAST(count(*) AS DOUBLE) AS total_hours FROM f_snapshots", "f_snapshots")
def _total_hours(t):
    return series.total_hours(series.snapshot_dimension(t["f_snapshots"]))


@query("sort_by_time", "SELECT name, snapshot, round(value, 4) AS value FROM f_series", "f_series")
def _sort_by_time(t):
    return series.ordered_output(t["f_series"])


# --- years --------------------------------------------------------------------------------------

_MOVED = "make_timestamp({year}, month(snapshot), {day}, hour(snapshot), minute(snapshot), second(snapshot))"


def _year(t, year):
    return series.base_year_rows(t["f_daily"], year)


@query(
    "shift_year",
    f"""
    SELECT {_MOVED.format(year=2024, day='day(snapshot)')} AS snapshot, name, value FROM f_daily WHERE year(snapshot) = 1997
    UNION ALL
    SELECT {_MOVED.format(year=2024, day='29')}, name, value FROM f_daily
    WHERE year(snapshot) = 1997 AND month(snapshot) = 2 AND day(snapshot) = 28
    """,
    "f_daily",
    digits=2,
)
def _shift_year(t):
    return series.shift_year(_year(t, 1997), 1997, 2024)


@query(
    "shift_year_drop",
    f"""
    SELECT {_MOVED.format(year=2023, day='day(snapshot)')} AS snapshot, name, value FROM f_daily
    WHERE year(snapshot) = 1996 AND NOT (month(snapshot) = 2 AND day(snapshot) = 29)
    """,
    "f_daily",
    digits=2,
)
def _shift_year_drop(t):
    return series.shift_year(_year(t, 1996), 1996, 2023)


@query(
    "leap_day_union",
    """
    SELECT count(*) AS n, sum(CASE WHEN month(snapshot) = 2 AND day(snapshot) = 28 THEN 1 ELSE 0 END) AS leap_rows FROM f_daily
    WHERE year(snapshot) = 1999
    """,
    "f_daily",
)
def _leap_day_union(t):
    moved = series.shift_year(_year(t, 1999), 1999, 2000)
    leap = F.count(F.when(temporal.is_feb29(F.col("snapshot")), 1))
    return moved.agg((F.count(F.lit(1)) - leap).alias("n"), leap.alias("leap_rows"))


@query(
    "has_feb29",
    """
    , years AS (SELECT CAST(year(snapshot) AS BIGINT) AS y, bool_or(month(snapshot) = 2 AND day(snapshot) = 29) AS has_feb29
                FROM f_daily GROUP BY 1)
    SELECT y, has_feb29, y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) AS is_leap FROM years
    """,
    "f_daily",
)
def _has_feb29(t):
    years = t["f_daily"].groupBy(F.year("snapshot").alias("y")).agg(F.bool_or(temporal.is_feb29(F.col("snapshot"))).alias("has_feb29"))
    return years.withColumn("is_leap", temporal.leap(F.col("y")))


@query(
    "parse_dayfirst",
    "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN date_trunc('minute', ts) END AS parsed FROM events",
)
def _parse_dayfirst(t):
    ts, n = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 5
    spelled = (
        F.when(n == 0, F.date_format(ts, "dd/MM/yyyy HH:mm")).when(n == 1, F.date_format(ts, "d/M/yyyy H:mm"))
        .when(n == 2, F.date_format(ts, "yyyy-MM-dd HH:mm")).when(n == 3, F.date_format(ts, "dd-MM-yyyy HH:mm:'00'")).otherwise("soon")
    )
    return t["events"].select("event_id", temporal.parse_dayfirst(spelled).alias("parsed"))


# --- resampling ---------------------------------------------------------------------------------


def _resample_sql(hours: int, value: str, where: str = "") -> str:
    return f"""
    , a AS (SELECT date_trunc('day', min(snapshot)) AS a, min(snapshot) AS lo, max(snapshot) AS hi FROM f_snapshots),
    spine AS (SELECT a + to_hours(CAST(i * {hours} AS BIGINT)) AS snapshot FROM a,
              range(CAST(date_diff('hour', a.a, a.lo) AS BIGINT) // {hours}, CAST(date_diff('hour', a.a, a.hi) AS BIGINT) // {hours} + 1) r(i)),
    b AS (SELECT component, attribute, name, (SELECT a FROM a) + to_hours(CAST(
            date_diff('hour', (SELECT a FROM a), snapshot) // {hours} * {hours} AS BIGINT)) AS snapshot, value FROM f_network_series {where}),
    v AS (SELECT component, attribute, name, snapshot, {value} AS value FROM b GROUP BY component, attribute, name, snapshot),
    g AS (SELECT k.component, k.attribute, k.name, spine.snapshot FROM (SELECT DISTINCT component, attribute, name FROM b) k, spine)
    """


@query(
    "resample_mean",
    _resample_sql(5, "avg(value)")
    + "SELECT component, attribute, name, snapshot, round(v.value, 8) AS value FROM g LEFT JOIN v USING (component, attribute, name, snapshot)",
    "f_network_series f_snapshots",
    digits=8,
)
def _resample_mean(t):
    return series.resample(t["f_network_series"], series.snapshot_dimension(t["f_snapshots"]), 5)


# Buckets as whole numbers, and the view read once.
_RULES = "CASE attribute WHEN 'p_max_pu' THEN max(value) WHEN 'p_set' THEN sum(value) WHEN 'fuel_cost' THEN min(value) END"


@query(
    "resample_rules",
    f"""
    , n AS MATERIALIZED (SELECT *, (component = 'generators' AND attribute IN ('p_max_pu', 'fuel_cost')) OR component = 'loads' AS touched
                         FROM f_network_series),
    days AS MATERIALIZED (SELECT CAST(min(snapshot) AS DATE) AS first, CAST(max(snapshot) AS DATE) - CAST(min(snapshot) AS DATE) AS last FROM n),
    b AS MATERIALIZED (SELECT component, attribute, name, CAST(snapshot AS DATE) - first AS day, {_RULES} AS value
                       FROM n, days WHERE touched GROUP BY component, attribute, name, CAST(snapshot AS DATE) - first),
    g AS (SELECT component, attribute, name, day FROM (SELECT DISTINCT component, attribute, name FROM b) k,
            (SELECT unnest(range(0, last + 1)) AS day FROM days))
    SELECT component, attribute, name, CAST(first + CAST(day AS INTEGER) AS TIMESTAMP) AS snapshot,
           round(CASE WHEN attribute = 'p_set' THEN coalesce(b.value, 0) ELSE b.value END, 6) AS value
    FROM g LEFT JOIN b USING (component, attribute, name, day), days
    UNION ALL SELECT component, attribute, name, snapshot, round(value, 6) FROM n WHERE NOT touched
    """,
    "f_network_series",
    digits=6,
)
def _resample_rules(t):
    rules = {
        ("generators", "p_max_pu"): "max",
        ("loads", "p_set"): "sum",
        ("generators", "fuel_cost"): "min",
        ("generators", "p"): "skip",
    }
    dimension = series.snapshot_dimension(t["f_snapshots"])
    return series.resample(t["f_network_series"], dimension, 24, rules, default=None)


@query(
    "resample_rules_by_carrier",
    """
    , n AS MATERIALIZED (SELECT * FROM f_network_series),
    days AS MATERIALIZED (SELECT CAST(min(snapshot) AS DATE) AS first, CAST(max(snapshot) AS DATE) - CAST(min(snapshot) AS DATE) AS last FROM n),
    b AS MATERIALIZED (SELECT n.component, n.attribute, n.name, CAST(snapshot AS DATE) - first AS day,
           CASE WHEN n.component = 'loads' THEN sum(value) WHEN n.component = 'generators' AND n.attribute = 'p' AND i.carrier = 'c1'
             THEN max(value) ELSE avg(value) END AS value
           FROM n JOIN f_items i USING (name), days GROUP BY 1, 2, 3, 4, i.carrier)
    SELECT component, attribute, name, CAST(first + CAST(day AS INTEGER) AS TIMESTAMP) AS snapshot,
           round(CASE WHEN component = 'loads' THEN coalesce(b.value, 0) ELSE b.value END, 8) AS value
    FROM (SELECT component, attribute, name, day FROM (SELECT DISTINCT component, attribute, name FROM b) k,
            (SELECT unnest(range(0, last + 1)) AS day FROM days)) LEFT JOIN b USING (component, attribute, name, day), days
    """,
    "f_network_series f_items",
    digits=8,
)
def _resample_rules_by_carrier(t):
    units = {"generators": t["f_items"].select("name", "carrier")}
    network = Network(units, t["f_network_series"], series.snapshot_dimension(t["f_snapshots"]))
    rules = [
        {"component": "loads_t", "attribute": "p_set", "rule": "sum"},
        {"component": "generators_t", "attribute": "p", "rule": "max", "carrier": "c1"},
    ]
    return runs.resampled(network, {"weights": 24, "resample_rules": rules}).series


@query(
    "resampled_snapshots",
    _resample_sql(7, "avg(value)") + "SELECT snapshot, row_number() OVER (ORDER BY snapshot) - 1 AS pos, CAST(7 AS DOUBLE) AS weighting FROM spine",
    "f_network_series f_snapshots",
)
def _resampled_snapshots(t):
    return series.resampled_snapshots(series.snapshot_dimension(t["f_snapshots"]), 7)
