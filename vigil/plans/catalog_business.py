"""Catalog: business-impact metrics (d01-d11) and the join they rest on (c01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import business as B
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources.fixture_sql import with_views

_CELLS = """
    count(*) FILTER (WHERE coalesce(prediction = 1, false) AND coalesce(actual = 1, false))::BIGINT AS tp,
    count(*) FILTER (WHERE coalesce(prediction = 1, false) AND coalesce(actual = 0, false))::BIGINT AS fp,
    count(*) FILTER (WHERE coalesce(prediction = 0, false) AND coalesce(actual = 1, false))::BIGINT AS fn,
    count(*) FILTER (WHERE coalesce(prediction = 0, false) AND coalesce(actual = 0, false))::BIGINT AS tn"""

_JOIN = "predictions p JOIN actuals a USING (customer_id)"


@query("c01_predictions_actuals_join", doubles=("probability",), oracle=with_views(
    f"SELECT customer_id, prediction, probability, actual FROM {_JOIN}", "predictions", "actuals"))
def c01(t):
    return B.confusion_join(fx.predictions(t), fx.actuals(t))


@query("d01_revenue_impact", doubles=("value", "revenue_from_tp", "cost_from_fp", "cost_from_fn"),
       oracle=with_views(f"""
SELECT 'revenue_impact' AS metric, (tp * 1000.0 - fp * 100.0 - fn * 2000.0) AS value, 'BRL' AS unit,
       'actual' AS kind, tp, fp, fn, tn, tp * 1000.0 AS revenue_from_tp, fp * 100.0 AS cost_from_fp,
       fn * 2000.0 AS cost_from_fn
FROM (SELECT {_CELLS} FROM {_JOIN}) c""", "predictions", "actuals"))
def d01(t):
    """Revenue impact from the confusion cells of predictions joined with actuals."""
    return B.revenue_impact(fx.predictions(t), fx.actuals(t))


@query("d02_revenue_estimated", doubles=("value", "assumed_precision"), oracle=with_views("""
SELECT 'revenue_impact' AS metric, n * 1000.0 * 0.8 AS value, 'BRL' AS unit, 'estimated' AS kind,
       n AS n_positive_predictions, 0.8 AS assumed_precision
FROM (SELECT count(*) FILTER (WHERE coalesce(prediction = 1, false))::BIGINT AS n FROM predictions) c""",
                                                                                       "predictions"))
def d02(t):
    return B.revenue_impact(fx.predictions(t), None)


@query("d03_churn_rate", doubles=("value",), oracle=with_views("""
SELECT 'churn_rate' AS metric, coalesce(avg(CASE WHEN coalesce(actual = 1, false) THEN 1.0 ELSE 0.0 END) * 100, 0.0)
           AS value, 'percentage' AS unit, count(*)::BIGINT AS total_customers,
       count(*) FILTER (WHERE coalesce(actual = 1, false))::BIGINT AS churned_customers
FROM actuals""", "actuals"))
def d03(t):
    return B.churn_rate(fx.actuals(t).withColumnRenamed("actual", "churned"), "churned")


@query("d04_cost_reduction",
       doubles=("value", "baseline_total_cost", "model_total_cost", "cost_reduction_pct"),
       oracle=with_views("""
SELECT 'cost_reduction' AS metric, n * 50.0 - n * 10.0 AS value, 'BRL' AS unit, n AS n_customers,
       n * 50.0 AS baseline_total_cost, n * 10.0 AS model_total_cost,
       CASE WHEN n * 50.0 > 0 THEN (n * 50.0 - n * 10.0) / (n * 50.0) * 100 ELSE 0.0 END AS cost_reduction_pct
FROM (SELECT count(*)::BIGINT AS n FROM predictions) c""", "predictions"))
def d04(t):
    return B.cost_reduction(fx.predictions(t), 50.0, 10.0)


@query("d05_roi", doubles=("value", "revenue_impact", "total_cost", "development_cost", "operational_cost"),
       oracle=with_views(f"""
SELECT 'roi' AS metric, (v - 105000.0) / 105000.0 * 100 AS value, 'percentage' AS unit,
       v AS revenue_impact, 105000.0 AS total_cost, 100000.0 AS development_cost,
       5000.0 AS operational_cost, 1 AS months_in_production
FROM (SELECT tp * 1000.0 - fp * 100.0 - fn * 2000.0 AS v FROM (SELECT {_CELLS} FROM {_JOIN}) c) r""",
                                                                   "predictions", "actuals"))
def d05(t):
    rev = B.revenue_impact(fx.predictions(t), fx.actuals(t))
    return B.roi(rev, 100000.0, 5000.0, 1)


@query("d06_satisfaction", doubles=("value", "std", "min", "max"), oracle=with_views("""
SELECT 'customer_satisfaction' AS metric, avg(nps_score) AS value, 'score' AS unit,
       'nps_score' AS score_type, stddev_samp(nps_score) AS std, min(nps_score)::DOUBLE AS min,
       max(nps_score)::DOUBLE AS max, count(*)::BIGINT AS n_responses
FROM feedback""", "feedback"))
def d06(t):
    return B.satisfaction(fx.feedback(t))


@query("d07_process_efficiency", doubles=("value", "time_saved_per_process", "efficiency_gain_pct"),
       oracle=with_views("""
SELECT 'process_efficiency_gain' AS metric, coalesce(saved, 0.0) AS value, 'hours' AS unit,
       coalesce(saved / nullif(n, 0), 0.0) AS time_saved_per_process,
       CASE WHEN before_total > 0 THEN saved / before_total * 100 ELSE 0.0 END AS efficiency_gain_pct,
       n AS n_processes
FROM (SELECT sum(before_h - after_h) AS saved, sum(before_h) AS before_total, count(*)::BIGINT AS n
      FROM processes) a""", "processes"))
def d07(t):
    return B.process_efficiency(fx.processes(t))


AS_OF = "2024-01-30 00:00:00"


@query("d08_metric_summary", doubles=("mean", "std", "min", "max"), oracle=with_views(f"""
SELECT name, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
       count(value)::BIGINT AS count
FROM metric_history WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY name""", "metric_history"))
def d08(t):
    """Per-metric summary over the last 7 days of the metric history (as-of is a parameter)."""
    return B.metric_summary(fx.metric_history(t), AS_OF, 7)


@query("d09_combined_run", doubles=("value",), oracle=with_views("""
SELECT 'revenue_impact' AS metric, rev AS value, 'BRL' AS unit FROM r
UNION ALL SELECT 'cost_reduction', n * 50.0 - n * 10.0, 'BRL' FROM n
UNION ALL SELECT 'roi', (rev - 105000.0) / 105000.0 * 100, 'percentage' FROM r""",
    "predictions", "actuals",
    ctes=[("c", f"SELECT {_CELLS} FROM {_JOIN}"), ("n", "SELECT count(*)::BIGINT AS n FROM predictions"),
          ("r", "SELECT tp * 1000.0 - fp * 100.0 - fn * 2000.0 AS rev FROM c")]))
def d09(t):
    return B.combined_run(fx.predictions(t), fx.actuals(t))


@query("d10_health_score", doubles=("health_score",), oracle=with_views("""
SELECT ((tp * 1000.0 - fp * 100.0 - fn * 2000.0) + (n * 50.0 - n * 10.0)) / 100000.0 AS health_score
FROM c, n""", "predictions", "actuals",
    ctes=[("c", f"SELECT {_CELLS} FROM {_JOIN}"), ("n", "SELECT count(*)::BIGINT AS n FROM predictions")]))
def d10(t):
    return B.health_score(B.combined_run(fx.predictions(t), fx.actuals(t)))


_SEG_BODY = f"""
SELECT CASE WHEN GROUPING(c_mktsegment) = 1 THEN '__total__' ELSE c_mktsegment END AS segment,
       count(*)::BIGINT AS n, {_CELLS},
       avg(CASE WHEN coalesce(actual = 1, false) THEN 1.0 ELSE 0.0 END) AS actual_rate
FROM {_JOIN} JOIN customer ON customer.c_custkey = p.customer_id
GROUP BY ROLLUP (c_mktsegment)"""


@query("d11_segment_impact", doubles=("actual_rate", "precision", "revenue_impact", "lift"),
       oracle=with_views("""
SELECT segment, n, tp, fp, fn, tn, actual_rate,
       tp::DOUBLE / nullif(tp + fp, 0) AS precision,
       (tp * 1000.0 - fp * 100.0 - fn * 2000.0) AS revenue_impact,
       (tp::DOUBLE / nullif(tp + fp, 0)) / nullif((SELECT actual_rate FROM s WHERE segment = '__total__'), 0) AS lift
FROM s""", "predictions", "actuals", ctes=[("s", _SEG_BODY)]))
def d11(t):
    """Segment drill-down (rollup with a total row) with conversion lift vs the overall rate."""
    seg = (B.confusion_join(fx.predictions(t), fx.actuals(t))
           .join(t.customer.select(F.col("c_custkey").alias("customer_id"), "c_mktsegment"), "customer_id"))
    return B.with_lift(B.segment_impact(seg, "c_mktsegment"))
