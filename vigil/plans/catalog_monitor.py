"""Catalog: drift, performance, decisions, alerts (k01-k12) and release comparison (n01-n04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import monitor as K
from vigil.operators import release as N
from vigil.operators.evaluation import latest_versions
from vigil.operators.scoring import logistic_model
from vigil.plans.catalog_eval import _B, _P, _W
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources import io
from vigil.sources.fixture_sql import chi2_sf, ks_pvalue, md5u, norm_cdf, with_views

NUMC, CATC = ["user_id", "value"], ["event_type"]


def _ks_sql(ref: str, cur: str, cols: list[str]) -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, '{side}' AS side FROM {view} WHERE {c} IS NOT NULL"
        for c in cols for side, view in (("ref", ref), ("cur", cur)))
    return f"""SELECT feature, 'ks' AS test, d AS statistic, {ks_pvalue('d', 'tr', 'tc')} AS p_value,
       tr::BIGINT AS n_ref, tc::BIGINT AS n_cur
FROM (SELECT feature, max(abs(cr / tr - cc / tc)) AS d, max(tr) AS tr, max(tc) AS tc FROM (
  SELECT feature, sum(nr) OVER (PARTITION BY feature ORDER BY v) AS cr, sum(nc) OVER (PARTITION BY feature ORDER BY v) AS cc,
         sum(nr) OVER (PARTITION BY feature) AS tr, sum(nc) OVER (PARTITION BY feature) AS tc
  FROM (SELECT feature, v, count(*) FILTER (WHERE side = 'ref') AS nr, count(*) FILTER (WHERE side = 'cur') AS nc
        FROM ({long}) l GROUP BY feature, v) c) w GROUP BY feature) k"""


def _chi_sql(ref: str, cur: str, cols: list[str]) -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, '{side}' AS side FROM {view} WHERE {c} IS NOT NULL"
        for c in cols for side, view in (("ref", ref), ("cur", cur)))
    er, ec = "((nr + nc) * tr / (tr + tc))", "((nr + nc) * tc / (tr + tc))"
    return f"""SELECT feature, 'chi2' AS test, stat AS statistic, {chi2_sf('stat', 'lv - 1')} AS p_value,
       tr::BIGINT AS n_ref, tc::BIGINT AS n_cur
FROM (SELECT feature, sum(pow(nr - {er}, 2) / {er} + pow(nc - {ec}, 2) / {ec}) AS stat, max(tr) AS tr, max(tc) AS tc,
             max(lv) AS lv FROM (
  SELECT feature, nr, nc, sum(nr) OVER (PARTITION BY feature) AS tr, sum(nc) OVER (PARTITION BY feature) AS tc,
         count(*) OVER (PARTITION BY feature) AS lv
  FROM (SELECT feature, v, count(*) FILTER (WHERE side = 'ref') AS nr, count(*) FILTER (WHERE side = 'cur') AS nc
        FROM ({long}) l GROUP BY feature, v) c) w GROUP BY feature) k"""


def _drift_sql(cur: str) -> str:
    return f"SELECT *, p_value < 0.05 AS drifted FROM ({_ks_sql('ref', cur, NUMC)}\nUNION ALL\n{_chi_sql('ref', cur, CATC)}) u"


@query("k01_column_drift", doubles=("statistic", "p_value"), oracle=with_views(_drift_sql("cur"), "ref", "cur"))
def k01(t):
    """Per-column drift, events before vs from 16 Jan (KS for numeric, chi-square for categorical)."""
    ref, cur = fx.drift_frames(t)
    return K.column_drift(ref, cur, NUMC, CATC)


def _dataset_sql(cur: str) -> str:
    return f"""SELECT n_drifted, n_columns, n_drifted / n_columns AS drift_share,
       n_drifted / n_columns >= 0.5 AS dataset_drift, (n_drifted / n_columns >= 0.5)::INTEGER::DOUBLE AS drift_score,
       ((n_drifted / n_columns >= 0.5)::INTEGER > 0.05 OR n_drifted / n_columns * 100 > 20) AS drift_detected
FROM (SELECT count(*) FILTER (WHERE drifted)::BIGINT AS n_drifted, count(*)::BIGINT AS n_columns
      FROM ({_drift_sql(cur)}) d) a"""


@query("k01_dataset_drift", doubles=("drift_share", "drift_score"), oracle=with_views(_dataset_sql("cur"), "ref", "cur"))
def k01d(t):
    ref, cur = fx.drift_frames(t)
    return K.dataset_drift(K.column_drift(ref, cur, NUMC, CATC))


@query("k01_planted_shift", doubles=("statistic", "p_value"),
       oracle=with_views(_drift_sql("cur_shift"), "ref", "cur_shift"))
def k01s(t):
    """Planted drift: current values scaled by 1.5 -- only ``value`` may be flagged."""
    ref, cur = fx.drift_frames(t, shift=1.5)
    return K.column_drift(ref, cur, NUMC, CATC)


def _dist_sql() -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, '{side}' AS side FROM {view} WHERE {c} IS NOT NULL"
        for c in NUMC for side, view in (("ref", "ref"), ("cur", "cur")))
    qs = ", ".join(str(i / 10) for i in range(1, 10))
    return f"""
WITH l AS ({long}),
cuts AS (SELECT feature, quantile_cont(v, [{qs}]) AS q FROM l WHERE side = 'ref' GROUP BY feature),
h AS (SELECT l.feature, len(list_filter(q, lambda c: v > c)) AS bin, count(*) FILTER (WHERE side = 'ref') AS r,
             count(*) FILTER (WHERE side = 'cur') AS c FROM l JOIN cuts USING (feature) GROUP BY ALL),
p AS (SELECT feature, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q FROM h),
d AS (SELECT feature, sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4))) AS psi,
             sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js FROM p GROUP BY feature),
cc AS (SELECT feature, v, count(*) FILTER (WHERE side = 'ref') AS nr, count(*) FILTER (WHERE side = 'cur') AS nc
       FROM l GROUP BY feature, v),
w AS (SELECT feature, sum(coalesce(abs(cr / tr - ccur / tc) * (nv - v), 0.0)) AS wasserstein FROM (
        SELECT feature, v, lead(v) OVER (PARTITION BY feature ORDER BY v) AS nv,
               sum(nr) OVER (PARTITION BY feature ORDER BY v) AS cr, sum(nc) OVER (PARTITION BY feature ORDER BY v) AS ccur,
               sum(nr) OVER (PARTITION BY feature) AS tr, sum(nc) OVER (PARTITION BY feature) AS tc FROM cc) x GROUP BY feature)
SELECT d.feature, psi, js, wasserstein FROM d JOIN w USING (feature)"""


@query("k02_drift_distances", doubles=("psi", "js", "wasserstein"), oracle=with_views(_dist_sql(), "ref", "cur"))
def k02(t):
    ref, cur = fx.drift_frames(t)
    return K.drift_distances(ref, cur, NUMC)


@query("k03_prediction_drift", doubles=("statistic", "p_value"), oracle=with_views(
    "SELECT *, p_value < 0.05 AS drifted FROM (" + _ks_sql("pr", "pc", ["probability"]) + ") k",
    "train_rows", "test_rows", ctes=[("pr", f"SELECT {_P} AS probability FROM train_rows"),
                                     ("pc", f"SELECT {_P} AS probability FROM test_rows")]))
def k03(t):
    """Drift of the model's probability between the training period and later rows."""
    m = logistic_model(_W, _B)
    ref = m.transform(fx.train_rows(t)).select("probability")
    cur = m.transform(fx.test_rows(t)).select("probability")
    return K.column_drift(ref, cur, ["probability"], [])


@query("k04_new_data_check", doubles=("growth_pct",), oracle=with_views("""
SELECT n_new, n_old, (n_new - n_old) * 100.0 / n_old AS growth_pct, CAST(d_old AS VARCHAR) AS max_date_old,
       CAST(d_new AS VARCHAR) AS max_date_new, (n_new - n_old) * 100.0 / n_old >= 10 AS has_new_data
FROM (SELECT count(*)::BIGINT AS n_old, max(date) AS d_old FROM feature_store WHERE date <= DATE '2000-12-31') o,
     (SELECT count(*)::BIGINT AS n_new, max(date) AS d_new FROM feature_store) n""", "feature_store"))
def k04(t):
    fs = fx.feature_store(t)
    old = fs.where(F.col("date") <= F.lit(fx.SPLIT_DATE_2).cast("date"))
    return K.new_data_check(old, fs, "date")


def _svc_sql(by_stage: bool = False) -> str:
    return """SELECT model_version, count(*)::BIGINT AS n, avg(is_error::DOUBLE) AS error_rate,
       avg(is_correct::DOUBLE) AS accuracy, quantile_cont(latency_ms, 0.5) AS latency_p50,
       quantile_cont(latency_ms, 0.95) AS latency_p95, quantile_cont(latency_ms, 0.99) AS latency_p99
FROM service_log GROUP BY model_version
UNION ALL SELECT '__total__', count(*)::BIGINT, avg(is_error::DOUBLE), avg(is_correct::DOUBLE),
       quantile_cont(latency_ms, 0.5), quantile_cont(latency_ms, 0.95), quantile_cont(latency_ms, 0.99) FROM service_log"""


_RULES = [("error_rate", ">", 0.01, "warning"), ("error_rate", ">", 0.05, "critical"),
          ("latency_p95", ">", 100.0, "warning"), ("latency_p95", ">", 200.0, "critical"),
          ("accuracy", "<", 0.95, "warning"), ("accuracy", "<", 0.90, "critical")]


@query("k05_alert_evaluation", doubles=("limit", "value"), oracle=with_views(f"""
WITH m AS ({_svc_sql()}),
l AS (SELECT model_version, 'error_rate' AS metric, error_rate AS value FROM m UNION ALL
      SELECT model_version, 'latency_p95', latency_p95 FROM m UNION ALL SELECT model_version, 'accuracy', accuracy FROM m),
r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in _RULES)}) r(metric, op, "limit", severity)),
f AS (SELECT l.model_version, l.metric, r.severity, r.op, r."limit", l.value,
             CASE r.severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS rk
      FROM l JOIN r USING (metric)
      WHERE (op = '>' AND value > "limit") OR (op = '<' AND value < "limit"))
SELECT model_version, metric, severity, op, "limit", value FROM f
QUALIFY row_number() OVER (PARTITION BY model_version, metric ORDER BY rk DESC, "limit" DESC, op DESC) = 1""", "service_log"))
def k05(t):
    """Alert rules x per-version service metrics; the worst firing severity per metric."""
    m = N.service_metrics(fx.service_log(t))
    long = m.unpivot(["model_version"], ["error_rate", "latency_p95", "accuracy"], "metric", "value")
    rules = t.spark.createDataFrame(_RULES, "metric string, op string, limit double, severity string")
    return K.evaluate_alerts(long, rules, ["model_version"])


def _deg_sql() -> str:
    return f"""SELECT b AS baseline_accuracy, c AS current_accuracy, b - c AS drop_abs, (b - c) * 100 / nullif(b, 0) AS drop_pct,
       b - c > 0.05 AS degraded_abs, (b - c) * 100 / nullif(b, 0) > 5 AS degraded_pct
FROM (SELECT avg(is_correct::DOUBLE) AS b FROM service_log WHERE ts < TIMESTAMP '2024-01-16') x,
     (SELECT avg(is_correct::DOUBLE) AS c FROM service_log WHERE ts >= TIMESTAMP '2024-01-16') y"""


@query("k06_performance_degradation", doubles=("baseline_accuracy", "current_accuracy", "drop_abs", "drop_pct"),
       oracle=with_views(_deg_sql(), "service_log"))
def k06(t):
    log = fx.service_log(t)
    cut = F.lit(fx.DRIFT_CUT).cast("timestamp_ntz")
    return K.degradation(log.where(F.col("ts") < cut), log.where(F.col("ts") >= cut))


@query("k07_retrain_decision", doubles=("growth_pct", "drift_score", "drop_pct"), oracle=with_views(f"""
WITH g AS (SELECT (n_new - n_old) * 100.0 / n_old AS growth_pct FROM
             (SELECT count(*) AS n_old FROM feature_store WHERE date <= DATE '2000-12-31') o,
             (SELECT count(*) AS n_new FROM feature_store) n),
d AS ({_dataset_sql("cur")}),
p AS ({_deg_sql()})
SELECT growth_pct, drift_score, drop_pct, date_diff('day', DATE '2024-01-01', DATE '2024-02-01')::INTEGER AS days_since_training,
       growth_pct >= 10 OR drift_score > 0.05 OR drop_pct > 5
           OR date_diff('day', DATE '2024-01-01', DATE '2024-02-01') >= 30 AS retrain,
       concat_ws(',', CASE WHEN growth_pct >= 10 THEN 'new_data' END, CASE WHEN drift_score > 0.05 THEN 'drift' END,
                 CASE WHEN drop_pct > 5 THEN 'performance' END,
                 CASE WHEN date_diff('day', DATE '2024-01-01', DATE '2024-02-01') >= 30 THEN 'schedule' END) AS reasons
FROM g, d, p""", "feature_store", "ref", "cur", "service_log"))
def k07(t):
    """Retrain decision from the three monitors plus the schedule (last training 2024-01-01)."""
    fs = fx.feature_store(t)
    nd = K.new_data_check(fs.where(F.col("date") <= F.lit(fx.SPLIT_DATE_2).cast("date")), fs, "date")
    ref, cur = fx.drift_frames(t)
    dd = K.dataset_drift(K.column_drift(ref, cur, NUMC, CATC))
    log = fx.service_log(t)
    cut = F.lit(fx.DRIFT_CUT).cast("timestamp_ntz")
    perf = K.degradation(log.where(F.col("ts") < cut), log.where(F.col("ts") >= cut))
    return K.retrain_decision(nd, dd, perf, "2024-01-01", "2024-02-01")


@query("k08_promotion_decision", doubles=("candidate", "production", "improvement"), oracle=with_views("""
WITH l AS (SELECT * FROM runs
           QUALIFY row_number() OVER (PARTITION BY model, stage ORDER BY CAST(version AS INTEGER) DESC, run_id DESC) = 1),
c AS (SELECT model, recall AS candidate, version AS candidate_version FROM l WHERE stage = 'Staging'),
p AS (SELECT model, recall AS production, version AS production_version FROM l WHERE stage = 'Production')
SELECT model, candidate_version, production_version, candidate, production, candidate - production AS improvement,
       CASE WHEN production IS NULL THEN 'promote' WHEN candidate IS NULL THEN 'keep'
            WHEN candidate - production >= 0.01 THEN 'promote' ELSE 'keep' END AS decision
FROM c FULL OUTER JOIN p USING (model)""", "runs"))
def k08(t):
    r = fx.runs(t)
    cand = latest_versions(r.where(F.col("stage") == "Staging"), "model", "version")
    prod = latest_versions(r.where(F.col("stage") == "Production"), "model", "version")
    return K.promotion_decision(cand, prod, "model", "recall")


@query("k09_rolling_accuracy", doubles=("accuracy",), oracle=with_views("""
SELECT CAST(ws AS VARCHAR) AS window_start, CAST(ws + INTERVAL 7 DAY AS VARCHAR) AS window_end,
       avg(is_correct::DOUBLE) AS accuracy, count(*)::BIGINT AS n
FROM (SELECT is_correct, date_trunc('day', ts) - k * INTERVAL 1 DAY AS ws FROM service_log, range(0, 7) r(k)) x
GROUP BY ws""", "service_log"))
def k09(t):
    return K.rolling_accuracy(fx.service_log(t))


@query("k10_pipeline_health", doubles=("lag_hours", "success_rate_1h", "success_rate_1d", "mean_duration_s"),
       oracle=with_views("""
SELECT dag, CAST(max(CASE WHEN status = 'success' THEN end_ts END) AS VARCHAR) AS last_success,
       date_diff('second', max(CASE WHEN status = 'success' THEN end_ts END), TIMESTAMP '2001-08-02 00:00:00') / 3600.0
           AS lag_hours,
       coalesce(date_diff('second', max(CASE WHEN status = 'success' THEN end_ts END), TIMESTAMP '2001-08-02 00:00:00')
                / 3600.0 > 2.0, true) AS lag_alert,
       count(*) FILTER (WHERE end_ts > TIMESTAMP '2001-08-01 23:00:00' AND status = 'success')
           / nullif(count(*) FILTER (WHERE end_ts > TIMESTAMP '2001-08-01 23:00:00'), 0) AS success_rate_1h,
       count(*) FILTER (WHERE end_ts > TIMESTAMP '2001-08-01 00:00:00' AND status = 'success')
           / nullif(count(*) FILTER (WHERE end_ts > TIMESTAMP '2001-08-01 00:00:00'), 0) AS success_rate_1d,
       avg(date_diff('second', start_ts, end_ts)) AS mean_duration_s, count(*)::BIGINT AS n_runs
FROM pipeline_runs WHERE end_ts <= TIMESTAMP '2001-08-02 00:00:00' GROUP BY dag""", "pipeline_runs"))
def k10(t):
    return K.pipeline_health(fx.pipeline_runs(t), "2001-08-02 00:00:00")


@query("k11_reference_roll_forward", doubles=("value",), oracle=with_views("SELECT * FROM cur", "cur"))
def k11(t):
    """After promotion the current window becomes the reference (new versioned folder)."""
    _, cur = fx.drift_frames(t)
    path = K.roll_forward_reference(cur, io.work_path(t.spark, "refs"), "2")
    return t.spark.read.parquet(path)


@query("k12_incident_classification", doubles=("accuracy", "latency_p95", "error_rate", "accuracy_drop_pct"),
       oracle=with_views(f"""
WITH m AS ({_svc_sql()}),
b AS (SELECT accuracy AS base FROM m WHERE model_version = '__total__')
SELECT model_version, accuracy, latency_p95, error_rate, (base - accuracy) * 100 / base AS accuracy_drop_pct,
       CASE WHEN (base - accuracy) * 100 / base > 10 OR latency_p95 / 100.0 > 2 OR error_rate > 0.05 THEN 'performance'
            ELSE 'none' END AS incident_type,
       CASE WHEN error_rate >= 0.5 THEN 'P0' WHEN (base - accuracy) * 100 / base > 20 THEN 'P1'
            WHEN (base - accuracy) * 100 / base > 10 OR latency_p95 / 100.0 > 2 OR error_rate > 0.05 THEN 'P2'
            ELSE 'P3' END AS severity
FROM m, b""", "service_log"))
def k12(t):
    """Incident type / severity per version against the all-traffic accuracy and a 100 ms SLA."""
    m = N.service_metrics(fx.service_log(t))
    base = m.where(F.col("model_version") == N.TOTAL).select("accuracy").scalar()
    x = m.select("model_version", "accuracy", "latency_p95", "error_rate",
                 ((base - F.col("accuracy")) * 100 / base).alias("accuracy_drop_pct"))
    return K.classify_incidents(x, F.col("accuracy_drop_pct"), F.col("latency_p95") / 100.0, F.col("error_rate"))


# ---------------------------------------------------------------- release comparison

@query("n01_service_metrics", doubles=("error_rate", "accuracy", "latency_p50", "latency_p95", "latency_p99"),
       oracle=with_views(_svc_sql(), "service_log"))
def n01(t):
    return N.service_metrics(fx.service_log(t))


def _verdict_sql(src: str, by: str | None = None) -> str:
    g = f"c.{by}, " if by else ""
    on = f"ON c.{by} = p.{by}" if by else "ON true"
    return f"""SELECT {g}c.error_rate AS c_error_rate, p.error_rate AS p_error_rate, c.latency_p95 AS c_latency_p95,
       c.accuracy AS c_accuracy, p.accuracy AS p_accuracy, p.accuracy - c.accuracy AS accuracy_drop,
       coalesce(CASE WHEN c.error_rate > 0.05 THEN 'error_rate' END, CASE WHEN c.latency_p95 > 200.0 THEN 'latency_p95' END,
                CASE WHEN p.accuracy - c.accuracy > 0.03 THEN 'accuracy_drop' END,
                CASE WHEN c.error_rate > 2.0 * p.error_rate THEN 'error_vs_production' END) AS failed_check,
       coalesce(CASE WHEN c.error_rate > 0.05 THEN 'error_rate' END, CASE WHEN c.latency_p95 > 200.0 THEN 'latency_p95' END,
                CASE WHEN p.accuracy - c.accuracy > 0.03 THEN 'accuracy_drop' END,
                CASE WHEN c.error_rate > 2.0 * p.error_rate THEN 'error_vs_production' END) IS NULL AS healthy
FROM (SELECT * FROM {src} WHERE model_version = 'v2') c JOIN (SELECT * FROM {src} WHERE model_version = 'v1') p {on}"""


@query("n02_health_verdict", doubles=("c_error_rate", "p_error_rate", "c_latency_p95", "c_accuracy", "p_accuracy",
                                      "accuracy_drop"), oracle=with_views(_verdict_sql("m"), "service_log",
                                                                          ctes=[("m", _svc_sql())]))
def n02(t):
    return N.health_verdict(N.service_metrics(fx.service_log(t), percentiles=(0.95,)), "v2", "v1")


def _stage_sql() -> str:
    stage_rows = f"""SELECT s.stage, l.* FROM service_log l, (VALUES (5), (10), (25), (50), (100)) s(stage)
        WHERE l.model_version = 'v1' OR floor({md5u('l.event_id')} * 100) < s.stage"""
    m = f"""SELECT stage, model_version, count(*)::BIGINT AS n, avg(is_error::DOUBLE) AS error_rate,
        avg(is_correct::DOUBLE) AS accuracy, quantile_cont(latency_ms, 0.95) AS latency_p95
        FROM ({stage_rows}) x GROUP BY stage, model_version"""
    return f"""SELECT *, min(healthy::INTEGER) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1
       AS promoted_through FROM ({_verdict_sql("sm", "stage")}) v"""


@query("n03_staged_rollout", doubles=("c_error_rate", "p_error_rate", "c_latency_p95", "c_accuracy", "p_accuracy",
                                      "accuracy_drop"), oracle=with_views(_stage_sql(), "service_log", ctes=[(
    "sm", f"""SELECT stage, model_version, count(*)::BIGINT AS n, avg(is_error::DOUBLE) AS error_rate,
        avg(is_correct::DOUBLE) AS accuracy, quantile_cont(latency_ms, 0.95) AS latency_p95
        FROM (SELECT s.stage, l.* FROM service_log l, (VALUES (5), (10), (25), (50), (100)) s(stage)
              WHERE l.model_version = 'v1' OR floor({md5u('l.event_id')} * 100) < s.stage) x GROUP BY stage, model_version""")]))
def n03(t):
    """Replay a 5/10/25/50/100 % canary rollout of v2 against v1; stop at the first failing stage."""
    return N.staged_rollout(fx.service_log(t), "event_id", "v2", "v1")


@query("n04_ab_significance", doubles=("rate_a", "rate_b", "z", "p_value"), oracle=with_views(f"""
WITH m AS (SELECT model_version, avg(is_error::DOUBLE) AS r, count(*) AS n FROM service_log GROUP BY model_version),
a AS (SELECT r AS p1, n AS n1 FROM m WHERE model_version = 'v1'), b AS (SELECT r AS p2, n AS n2 FROM m WHERE model_version = 'v2'),
z AS (SELECT p1, p2, (p1 - p2) / nullif(sqrt(((p1 * n1 + p2 * n2) / (n1 + n2)) * (1 - (p1 * n1 + p2 * n2) / (n1 + n2))
        * (1.0 / n1 + 1.0 / n2)), 0) AS z FROM a, b)
SELECT 'v1' AS version_a, 'v2' AS version_b, p1 AS rate_a, p2 AS rate_b, z, 2 * (1 - {norm_cdf('abs(z)')}) AS p_value,
       2 * (1 - {norm_cdf('abs(z)')}) < 0.05 AS significant FROM z""", "service_log"))
def n04(t):
    return N.two_proportion_test(N.service_metrics(fx.service_log(t), percentiles=()), "v1", "v2")


@query("c04_metric_rule_join", doubles=("limit", "value"), oracle=with_views(f"""
WITH m AS ({_svc_sql()}),
l AS (SELECT model_version, 'error_rate' AS metric, error_rate AS value FROM m UNION ALL
      SELECT model_version, 'latency_p95', latency_p95 FROM m UNION ALL SELECT model_version, 'accuracy', accuracy FROM m),
r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in _RULES)}) r(metric, op, "limit", severity))
SELECT l.model_version, l.metric, l.value, r.op, r."limit", r.severity,
       (op = '>' AND value > "limit") OR (op = '<' AND value < "limit") AS fired
FROM l JOIN r USING (metric)""", "service_log"))
def c04(t):
    """Metric rows joined with the (broadcast, fixed-size) alert-rule table and the rule predicate."""
    m = N.service_metrics(fx.service_log(t))
    long = m.unpivot(["model_version"], ["error_rate", "latency_p95", "accuracy"], "metric", "value")
    rules = t.spark.createDataFrame(_RULES, "metric string, op string, limit double, severity string")
    j = long.join(F.broadcast(rules), "metric")
    fired = (F.when(F.col("op") == ">", F.col("value") > F.col("limit"))
             .when(F.col("op") == "<", F.col("value") < F.col("limit")).otherwise(F.lit(False)))
    return j.select("model_version", "metric", "value", "op", "limit", "severity", fired.alias("fired"))
