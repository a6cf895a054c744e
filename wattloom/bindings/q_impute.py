"""Named queries: imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ROW_ID
from ..operators import impute
from .registry import query

_OUT = ("name", "capital_cost")


def _gaps(t):
    return t["f_gaps"]


@query(
    "fill_group_mean",
    """
    SELECT name, round(coalesce(capital_cost, avg(capital_cost) OVER (PARTITION BY carrier, province)), 3) AS capital_cost FROM f_gaps
    """,
    "f_gaps",
    digits=3,
)
def _fill_group_mean(t):
    return impute.fill_missing(_gaps(t), "capital_cost", ["carrier", "province"], "group_mean").select(*_OUT)


@query(
    "fill_group_median",
    """
    , m AS (SELECT carrier, build_year, median(capital_cost) AS m FROM f_gaps GROUP BY carrier, build_year)
    SELECT name, round(coalesce(capital_cost, m), 3) AS capital_cost FROM f_gaps JOIN m USING (carrier, build_year)
    """,
    "f_gaps",
    digits=3,
)
def _fill_group_median(t):
    return impute.fill_missing(_gaps(t), "capital_cost", ["carrier", "build_year"], "group_median").select(*_OUT)


@query(
    "order_statistics",
    """
    , r AS (SELECT province, capital_cost, count(*) OVER (PARTITION BY province) AS n,
                   row_number() OVER (PARTITION BY province ORDER BY capital_cost) AS i FROM f_gaps WHERE capital_cost IS NOT NULL)
    SELECT province, n, max(CASE WHEN i = 1 + n // 10 THEN capital_cost END) AS low,
           max(CASE WHEN i = 1 + n // 2 THEN capital_cost END) AS mid FROM r GROUP BY province, n
    """,
    "f_gaps",
)
def _order_statistics(t):
    n = F.col("n")
    ranks = {"low": F.floor(n / 10), "mid": F.floor(n / 2)}
    return impute.order_statistics(_gaps(t), ["province"], "capital_cost", ranks)


@query(
    "fill_regression",
    """
    , f AS (SELECT regr_slope(capital_cost, p_nom) AS s, regr_intercept(capital_cost, p_nom) AS i FROM f_gaps)
    SELECT name, round(coalesce(capital_cost, greatest((SELECT s FROM f) * p_nom + (SELECT i FROM f), 0)), 2) AS capital_cost FROM f_gaps
    """,
    "f_gaps",
    digits=2,
)
def _fill_regression(t):
    return impute.fill_missing(_gaps(t), "capital_cost", ["carrier"], "regression", predictors=["p_nom"]).select(*_OUT)


@query(
    "fill_regression_gaps",
    """
    , f AS (SELECT regr_slope(capital_cost, p_nom) AS s, regr_intercept(capital_cost, p_nom) AS i FROM f_gaps WHERE control <> 'O')
    SELECT name, round(coalesce(capital_cost, CASE WHEN control <> 'O' THEN greatest((SELECT s FROM f) * p_nom + (SELECT i FROM f), 0)
           ELSE avg(capital_cost) OVER (PARTITION BY carrier) END), 2) AS capital_cost FROM f_gaps
    """,
    "f_gaps",
    digits=2,
)
def _fill_regression_gaps(t):
    # Units that lack the predictor get their group's mean; the others are fitted.
    rows = _gaps(t).withColumn("p_nom", F.when(F.col("control") != "O", F.col("p_nom")))
    return impute.fill_missing(rows, "capital_cost", ["carrier"], "regression", predictors=["p_nom"]).select(*_OUT)


@query(
    "fill_regression_text",
    """
    , k AS (SELECT carrier, row_number() OVER (ORDER BY carrier) - 1 AS code FROM (SELECT DISTINCT carrier FROM f_gaps WHERE capital_cost IS NOT NULL)),
    d AS (SELECT f_gaps.*, code FROM f_gaps JOIN k USING (carrier)),
    f AS (SELECT regr_slope(capital_cost, code) AS s, regr_intercept(capital_cost, code) AS i FROM d)
    SELECT name, round(coalesce(capital_cost, greatest((SELECT s FROM f) * code + (SELECT i FROM f), 0)), 2) AS capital_cost FROM d
    """,
    "f_gaps",
    digits=2,
)
def _fill_regression_text(t):
    return impute.fill_missing(_gaps(t), "capital_cost", ["carrier"], "regression").select(*_OUT)


@query(
    "fill_regression_two",
    """
    , o AS (SELECT capital_cost AS y, p_nom AS a, CAST(build_year AS DOUBLE) AS b FROM f_gaps WHERE capital_cost IS NOT NULL),
    s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy,
                 avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM o),
    f AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ka, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS kb, ma, mb, my FROM s)
    SELECT name, round(coalesce(capital_cost, greatest(my + ka * (p_nom - ma) + kb * (build_year - mb), 0)), 2) AS capital_cost FROM f_gaps, f
    """,
    "f_gaps",
    digits=2,
)
def _fill_regression_two(t):
    return impute.fill_missing(_gaps(t), "capital_cost", ["carrier"], "regression", predictors=["p_nom", "build_year"]).select(*_OUT)


@query(
    "regression_quality",
    """
    SELECT round(regr_slope(capital_cost, p_nom), 4) AS slope, round(regr_intercept(capital_cost, p_nom), 4) AS intercept,
           round(regr_r2(capital_cost, p_nom), 4) AS r2, CAST(regr_count(capital_cost, p_nom) AS BIGINT) AS n FROM f_gaps
    """,
    "f_gaps",
)
def _regression_quality(t):
    return impute.regression_quality(_gaps(t), "capital_cost", "p_nom")


def _recent_sql(pick: str) -> str:
    return f"""
    , years AS (SELECT DISTINCT carrier, control, build_year AS y FROM f_gaps),
    lists AS (SELECT y.carrier, y.control, y.y, list_sort(list(g.capital_cost)) AS v FROM years y
              JOIN f_gaps g ON g.carrier = y.carrier AND g.control = y.control AND g.build_year BETWEEN y.y - 2 AND y.y + 2
              AND g.capital_cost IS NOT NULL GROUP BY 1, 2, 3)
    SELECT name, round(coalesce(capital_cost, {pick}), 3) AS capital_cost
    FROM f_gaps LEFT JOIN lists ON f_gaps.carrier = lists.carrier AND f_gaps.control = lists.control AND build_year = y
    """


@query("fill_recent_mean", _recent_sql("list_avg(v)"), "f_gaps", digits=3)
def _fill_recent_mean(t):
    return impute.fill_missing(_gaps(t), "capital_cost", ["carrier", "control", "build_year"], "recent_mean", time_window=5).select(*_OUT)


@query("fill_recent_trimmed", _recent_sql("list_avg(list_slice(v, 4, len(v) - 3))"), "f_gaps", digits=3)
def _fill_recent_trimmed(t):
    return impute.fill_missing(
        _gaps(t), "capital_cost", ["carrier", "control"], "recent_mean", time_window=4, year_column="build_year", exclude_outliers=3
    ).select(*_OUT)


@query("fill_recent_median", _recent_sql("list_median(v)"), "f_gaps", digits=3)
def _fill_recent_median(t):
    return impute.fill_missing(
        _gaps(t), "capital_cost", ["carrier", "control", "build_year"], "recent_median", time_window=5, exclude_outliers=2
    ).select(*_OUT)


@query(
    "recent_window_join",
    """
    , y AS (SELECT build_year AS y, sum(capital_cost) AS s, count(capital_cost) AS n FROM f_gaps GROUP BY 1)
    SELECT name, round(coalesce(capital_cost, (SELECT sum(s) / sum(n) FROM y WHERE abs(y.y - f_gaps.build_year) <= 1)), 3) AS capital_cost FROM f_gaps
    """,
    "f_gaps",
    digits=3,
)
def _recent_window_join(t):
    return impute.fill_recent(_gaps(t), "capital_cost", ["build_year"], "mean", time_window=3).select(*_OUT)


def _neighbour_sql(function: str, frame: str) -> str:
    return f"""
    SELECT row_id, round(CASE WHEN v < 0 THEN 0 ELSE v END, 2) AS price FROM (
      SELECT row_id, {function}(price IGNORE NULLS) OVER (PARTITION BY priority, status ORDER BY row_id ROWS BETWEEN {frame}) AS v FROM f_order_gaps)
    """


@query("fill_forward", _neighbour_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), "f_order_gaps", digits=2)
def _fill_forward(t):
    return impute.fill_missing(t["f_order_gaps"], "price", ["priority", "status"], "forward_fill").select(ROW_ID, "price")


@query("fill_backward", _neighbour_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"), "f_order_gaps", digits=2)
def _fill_backward(t):
    return impute.fill_missing(t["f_order_gaps"], "price", ["priority", "status"], "backward_fill").select(ROW_ID, "price")


@query(
    "imputation_stats",
    """
    , m AS (SELECT carrier, province, avg(capital_cost) AS m FROM f_gaps GROUP BY carrier, province),
    f AS (SELECT capital_cost, m FROM f_gaps JOIN m USING (carrier, province))
    SELECT count(*) AS total_rows, count(*) - count(capital_cost) AS missing_before,
           count(CASE WHEN capital_cost IS NULL THEN m END) AS filled, count(CASE WHEN capital_cost IS NULL AND m IS NULL THEN 1 END) AS remaining,
           round(min(CASE WHEN capital_cost IS NULL THEN m END), 3) AS filled_min, round(max(CASE WHEN capital_cost IS NULL THEN m END), 3) AS filled_max,
           round(avg(CASE WHEN capital_cost IS NULL THEN m END), 3) AS filled_mean, (SELECT count(*) FROM m) AS group_count
    FROM f
    """,
    "f_gaps",
    digits=3,
)
def _imputation_stats(t):
    groups = ["carrier", "province"]
    after = impute.fill_missing(_gaps(t), "capital_cost", groups, "group_mean")
    return impute.imputation_stats(_gaps(t), after, "capital_cost", groups)
