"""Named queries: facts matched to items and laid over snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from .registry import query

_ITEMS = "f_customers"


def _facts(t):
    return t["f_facts"].withColumn("component", F.lit("generators"))


def _all_facts(t):
    return _facts(t).unionByName(t["f_named_facts"], allowMissingColumns=True)


_NATIONAL = """national AS (SELECT c.name, f.snapshot, f.value FROM f_facts f JOIN f_customers c ON f.carrier = c.carrier
                            WHERE f.aggregation = 'national' AND f.region = 'ALL')"""
_PROVINCE = """prov AS (SELECT c.name, f.snapshot, f.value FROM f_facts f
                        JOIN f_customers c ON f.carrier = c.carrier AND f.region = c.province WHERE f.aggregation = 'province')"""


@query("match_national", f", {_NATIONAL} SELECT name, snapshot, round(value, 2) AS value FROM national", "f_facts f_customers", digits=2)
def _match_national(t):
    return facts.match_national(_facts(t), t[_ITEMS], "ALL").select("name", "snapshot", "value")


@query("match_province", f", {_PROVINCE} SELECT name, snapshot, round(value, 2) AS value FROM prov", "f_facts f_customers", digits=2)
def _match_province(t):
    return facts.match_province(_facts(t), t[_ITEMS]).select("name", "snapshot", "value")


@query(
    "match_generator_fallback",
    """
    , named AS (SELECT c.name, f.snapshot, f.value FROM f_named_facts f JOIN f_customers c ON f.carrier = c.carrier AND f.name = c.name),
    rest AS (SELECT c.name, f.snapshot, f.value FROM f_named_facts f JOIN f_customers c ON f.carrier = c.carrier AND f.region = c.province
             WHERE c.name NOT IN (SELECT name FROM named))
    SELECT name, snapshot, count(*) AS n, round(max(value), 2) AS value
    FROM (SELECT * FROM named UNION ALL SELECT * FROM rest) GROUP BY name, snapshot
    """,
    "f_named_facts f_customers",
    digits=2,
)
def _match_generator_fallback(t):
    fold = {"n": F.count(F.lit(1)), "value": F.max("value")}
    rows = facts.match_generator(t["f_named_facts"], t[_ITEMS], fold)
    return rows.groupBy("name", "snapshot").agg(F.sum("n").alias("n"), F.max("value").alias("value"))


@query(
    "last_level_wins",
    f", {_PROVINCE} SELECT name, snapshot, round(value, 2) AS value, 'province' AS aggregation FROM prov",
    "f_facts f_customers",
    digits=2,
)
def _last_level_wins(t):
    return facts.matched(_all_facts(t), t[_ITEMS], "ALL").select("name", "snapshot", "value", "aggregation")


@query(
    "closest_level_wins",
    f""", {_NATIONAL}, {_PROVINCE},
    named AS (SELECT c.name, f.snapshot, f.value FROM f_named_facts f JOIN f_customers c ON f.carrier = c.carrier AND f.name = c.name),
    place AS (SELECT c.name, f.snapshot, f.value FROM f_named_facts f JOIN f_customers c ON f.carrier = c.carrier AND f.region = c.province),
    every AS (SELECT *, 'generator' AS aggregation, 4 AS s FROM named UNION ALL SELECT *, 'generator', 3 FROM place
              UNION ALL SELECT *, 'province', 2 FROM prov UNION ALL SELECT *, 'national', 1 FROM national),
    strongest AS (SELECT name, max(s) AS s FROM every GROUP BY name)
    SELECT name, snapshot, aggregation, count(*) AS n, round(min(value), 2) AS low, round(max(value), 2) AS high
    FROM every JOIN strongest USING (name, s) GROUP BY name, snapshot, aggregation
    """,
    "f_facts f_customers f_named_facts",
    digits=2,
)
def _closest_level_wins(t):
    fold = {"n": F.count(F.lit(1)), "low": F.min("value"), "high": F.max("value")}
    rows = facts.matched(_all_facts(t), t[_ITEMS], "ALL", mode="merge", fold=fold)
    return rows.groupBy("name", "snapshot", "aggregation").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


@query(
    "duplicate_facts",
    """
    , named AS (SELECT c.name, f.snapshot FROM f_named_facts f JOIN f_customers c ON f.carrier = c.carrier AND f.name = c.name),
    rest AS (SELECT c.name, f.snapshot FROM f_named_facts f JOIN f_customers c ON f.carrier = c.carrier AND f.region = c.province
             WHERE c.name NOT IN (SELECT name FROM named))
    SELECT name, snapshot AS period, count(*) AS n FROM (SELECT * FROM named UNION ALL SELECT * FROM rest)
    GROUP BY name, snapshot HAVING count(*) > 1
    """,
    "f_named_facts f_customers",
)
def _duplicate_facts(t):
    rows = facts.match_generator(t["f_named_facts"], t[_ITEMS], {"n": F.count(F.lit(1))})
    return facts.duplicate_facts(rows, ["name"], counts="n")


@query(
    "apply_monthly",
    f""", {_PROVINCE},
    days AS (SELECT snapshot FROM f_months),
    grid AS (SELECT DISTINCT p.name, d.m FROM prov p, (SELECT DISTINCT date_trunc('month', snapshot) AS m FROM days) d),
    filled AS (SELECT g.name, g.m, last_value(p.value IGNORE NULLS) OVER (PARTITION BY g.name ORDER BY g.m
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
               FROM grid g LEFT JOIN prov p ON g.name = p.name AND g.m = p.snapshot AND month(p.snapshot) % 3 <> 1)
    SELECT f.name, f.m AS month, count(*) AS days, count(f.value) AS known, round(min(f.value), 2) AS low,
           round(max(f.value), 2) AS high
    FROM filled f JOIN days d ON date_trunc('month', d.snapshot) = f.m GROUP BY f.name, f.m
    """,
    "f_facts f_customers f_months",
    digits=2,
)
def _apply_monthly(t):
    # Every third month has no facts, so values are carried over gaps and the first month stays open.
    gappy = _facts(t).withColumn("value", F.when(F.month("snapshot") % 3 != 1, F.col("value")))
    out, _ = facts.apply_facts(None, gappy, t[_ITEMS], t["f_months"], "ALL", monthly=True)
    return _per_month(out)


def _per_month(out):
    """All rows of the operator, counted per item and month."""
    return out.groupBy("name", F.date_trunc("month", "snapshot").cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.count("value").alias("known"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query(
    "apply_snapshot",
    """
    , days AS (SELECT snapshot FROM f_months UNION SELECT snapshot + INTERVAL 12 HOUR FROM f_months)
    SELECT c.name, date_trunc('month', d.snapshot) AS month, count(*) AS days, count(x.value) AS known,
           round(min(x.value), 2) AS low, round(max(x.value), 2) AS high
    FROM (SELECT name FROM f_customers WHERE carrier = 'c1') c, days d LEFT JOIN f_daily x ON d.snapshot = x.snapshot
    GROUP BY 1, 2
    """,
    "f_months f_daily f_customers",
    digits=2,
)
def _apply_snapshot(t):
    # Facts fall on midnight only, so the noon snapshots stay open.
    days = t["f_months"].unionByName(t["f_months"].select((F.col("snapshot") + F.expr("INTERVAL 12 HOUR")).alias("snapshot")))
    daily = t["f_daily"].select(
        F.lit("generators").alias("components"), F.lit("p_max_pu").alias("attribute"), F.lit("c1").alias("carrier"),
        F.lit("ALL").alias("region"), F.lit("national").alias("aggregation"), F.lit(True).alias("status"), "snapshot", "value",
    )
    out, _ = facts.apply_facts(None, daily, t[_ITEMS], days, "ALL", monthly=False)
    return _per_month(out)


@query(
    "replace_attributes",
    """
    SELECT component, attribute, name, snapshot, round(value, 6) AS value FROM f_network_series
    WHERE NOT (component = 'loads' AND attribute = 'p_set')
    UNION ALL SELECT 'loads', 'p_set', name, snapshot, round(value, 6) FROM f_series
    """,
    "f_network_series f_series",
    digits=6,
)
def _replace_attributes(t):
    new = t["f_series"].select(
        F.lit("loads").alias("component"), F.lit("p_set").alias("attribute"), "name", "snapshot", "value"
    )
    return facts.replace_attributes(t["f_network_series"], new)
