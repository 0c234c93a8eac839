"""Catalog: training, tuning, evaluation (i01-i15) and batch scoring (j01-j05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import boosting as B
from vigil.operators import evaluation as V
from vigil.operators import scoring as J
from vigil.operators import training as T
from vigil.operators.features import stratified_kfold
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources import io
from vigil.sources.fixture_sql import with_views
from vigil.session import cut_lineage

NUM = ["f_total", "f_items", "f_disc"]


def _weighted_sql(src: str, by: str | None = None) -> str:
    """Support-weighted P/R/F1 + accuracy from confusion cells (``src`` has y, p[, seg])."""
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    return f"""
WITH cells AS (SELECT {g}y, p, count(*) AS cnt FROM ({src}) s GROUP BY {g}y, p),
roles AS (SELECT {g}y AS c, cnt, y = p AS hit, true AS is_true FROM cells
          UNION ALL SELECT {g}p AS c, cnt, y = p AS hit, false FROM cells),
per AS (SELECT {g}c, sum(CASE WHEN is_true THEN cnt ELSE 0 END) AS support,
               sum(CASE WHEN NOT is_true THEN cnt ELSE 0 END) AS predicted,
               sum(CASE WHEN is_true AND hit THEN cnt ELSE 0 END) AS tp FROM roles GROUP BY {g}c),
m AS (SELECT {g}support, tp, coalesce(tp / nullif(predicted, 0), 0.0) AS pc,
             coalesce(tp / nullif(support, 0), 0.0) AS rc FROM per)
SELECT {g}sum(support)::BIGINT AS n, sum(tp) / sum(support) AS accuracy,
       sum(support * pc) / sum(support) AS precision, sum(support * rc) / sum(support) AS recall,
       sum(support * coalesce(2 * pc * rc / nullif(pc + rc, 0), 0.0)) / sum(support) AS f1
FROM m {gb}"""


def _auc_sql(src: str, by: str | None = None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {g}CASE WHEN sum(yy) > 0 AND count(*) - sum(yy) > 0 THEN
       (sum(CASE WHEN yy = 1 THEN rk END) - sum(yy) * (sum(yy) + 1) / 2.0) / (sum(yy) * (count(*) - sum(yy)))
       END AS auc
FROM (SELECT {g}y AS yy, rank() OVER ({part}ORDER BY s) + (count(*) OVER ({part.replace('PARTITION BY ', 'PARTITION BY s, ') if by else 'PARTITION BY s '}) - 1) / 2.0 AS rk
      FROM ({src}) x WHERE s IS NOT NULL) r {gb}"""


@query("i03_classification_metrics", doubles=("accuracy", "precision", "recall", "f1"),
       oracle=with_views(_weighted_sql("SELECT y_true AS y, y_pred AS p FROM scored"), "scored"))
def i03(t):
    return V.classification_metrics(fx.scored(t))


@query("i04_roc_auc", doubles=("auc",), oracle=with_views(_auc_sql("SELECT y_true AS y, y_prob AS s FROM scored"),
                                                          "scored"))
def i04(t):
    return V.auc(fx.scored(t))


@query("i05_confusion_matrix", oracle=with_views(
    "SELECT y_true AS y, y_pred AS p, count(*)::BIGINT AS count FROM scored GROUP BY y_true, y_pred", "scored"))
def i05(t):
    return V.confusion(fx.scored(t))


@query("i06_metrics_by_segment", doubles=("accuracy", "precision", "recall", "f1", "auc"), oracle=with_views(
    "SELECT m.*, a.auc FROM (" + _weighted_sql("SELECT lang AS segment, y_true AS y, y_pred AS p FROM scored "
                                               "UNION ALL SELECT '__all__', y_true, y_pred FROM scored", "segment")
    + ") m LEFT JOIN (" + _auc_sql("SELECT lang AS segment, y_true AS y, y_prob AS s FROM scored "
                                   "UNION ALL SELECT '__all__', y_true, y_prob FROM scored", "segment")
    + ") a USING (segment)", "scored"))
def i06(t):
    return V.metrics_by_segment(fx.scored(t), "lang")


_TH = [0.3, 0.5, 0.7]


@query("i07_threshold_sweep", doubles=("threshold", "precision", "recall", "f1", "accuracy", "positive_rate"),
       oracle=with_views("""
SELECT threshold, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
       coalesce(2 * (coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0))
                / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0) AS f1,
       (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, (tp + fp) / nullif(tp + fp + fn + tn, 0) AS positive_rate
FROM (SELECT t.threshold,
        count(*) FILTER (WHERE y_prob >= t.threshold AND y_true = 1)::BIGINT AS tp,
        count(*) FILTER (WHERE y_prob >= t.threshold AND y_true <> 1)::BIGINT AS fp,
        count(*) FILTER (WHERE y_prob < t.threshold AND y_true = 1)::BIGINT AS fn,
        count(*) FILTER (WHERE y_prob < t.threshold AND y_true <> 1)::BIGINT AS tn
      FROM scored, (VALUES (0.3), (0.5), (0.7)) t(threshold) WHERE y_prob IS NOT NULL GROUP BY t.threshold) c""",
                                                    "scored"))
def i07(t):
    return V.threshold_sweep(fx.scored(t), _TH)


@query("i11_regression_metrics", doubles=("rmse", "mae", "mape", "r2"), oracle=with_views("""
SELECT sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
       avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100 AS mape,
       1 - sum((y - yhat) * (y - yhat)) / (count(y) * var_pop(y)) AS r2, count(*)::BIGINT AS n FROM y_reg""", "y_reg"))
def i11(t):
    return V.regression_metrics(fx.y_reg(t))


@query("i12_ranking_metrics", doubles=("ndcg_at_10", "map", "mrr"), oracle=with_views("""
WITH r AS (SELECT source, id, y_true::DOUBLE AS rel,
                  row_number() OVER (PARTITION BY source ORDER BY y_prob DESC, id) AS rank,
                  row_number() OVER (PARTITION BY source ORDER BY y_true DESC, id) AS irank FROM scored),
h AS (SELECT *, sum((rel > 0)::INTEGER) OVER (PARTITION BY source ORDER BY rank) AS hits FROM r),
q AS (SELECT source, sum(CASE WHEN rank <= 10 THEN (pow(2.0, rel) - 1) / log2(rank + 1) ELSE 0.0 END) AS dcg,
             sum(CASE WHEN irank <= 10 THEN (pow(2.0, rel) - 1) / log2(irank + 1) ELSE 0.0 END) AS idcg,
             count(*) FILTER (WHERE rel > 0) AS n_rel,
             sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0.0 END) AS ap_sum,
             min(CASE WHEN rel > 0 THEN rank END) AS first_rel FROM h GROUP BY source)
SELECT avg(dcg / nullif(idcg, 0)) AS ndcg_at_10, avg(coalesce(ap_sum / nullif(n_rel, 0), 0.0)) AS map,
       avg(coalesce(1.0 / first_rel, 0.0)) AS mrr, count(*)::BIGINT AS n_queries FROM q""", "scored"))
def i12(t):
    """Ranking quality per source (query = source, items ranked by probability, relevance = quality)."""
    return V.ranking_metrics(fx.scored(t), "source", "id", "y_prob", "y_true", 10)


@query("i13_approval_gate", doubles=("value", "minimum"), oracle=with_views(f"""
WITH m AS ({_weighted_sql("SELECT y_true AS y, y_pred AS p FROM scored")})
SELECT metric, value, minimum, passed, 'training' AS gate,
       (SELECT bool_and(passed) FROM (SELECT accuracy >= 0.70 AS passed FROM m UNION ALL SELECT f1 >= 0.65 FROM m)) AS approved
FROM (SELECT 'accuracy' AS metric, accuracy AS value, 0.70 AS minimum, accuracy >= 0.70 AS passed FROM m
      UNION ALL SELECT 'f1', f1, 0.65, f1 >= 0.65 FROM m) g""", "scored"))
def i13(t):
    return V.approval_gate(V.classification_metrics(fx.scored(t)), "training")


@query("i14_leaderboard", doubles=("recall", "accuracy"), oracle=with_views(
    "SELECT * FROM runs WHERE stage <> 'Archived' ORDER BY recall DESC, run_id LIMIT 10", "runs"))
def i14(t):
    """Experiment leaderboard: top-10 non-archived runs by recall (a top-k report)."""
    return V.leaderboard(fx.runs(t), "recall", 10, F.col("stage") != "Archived")


@query("i14_compare_runs", doubles=("1", "2", "3"), oracle=with_views("""
SELECT metric, max(CASE WHEN run_id = 1 THEN value END) AS "1", max(CASE WHEN run_id = 2 THEN value END) AS "2",
       max(CASE WHEN run_id = 3 THEN value END) AS "3"
FROM (SELECT run_id, 'recall' AS metric, recall AS value FROM runs UNION ALL
      SELECT run_id, 'accuracy', accuracy FROM runs) l WHERE run_id IN (1, 2, 3) GROUP BY metric""", "runs"))
def i14c(t):
    return V.compare_runs(fx.runs(t), [1, 2, 3], ["recall", "accuracy"])


@query("i15_latest_versions", doubles=("recall", "accuracy"), oracle=with_views("""
SELECT model, run_id, version, stage, recall, accuracy, ts FROM runs WHERE stage = 'Production'
QUALIFY row_number() OVER (PARTITION BY model ORDER BY CAST(version AS INTEGER) DESC, run_id DESC) = 1""", "runs"))
def i15(t):
    """Latest Production version per model (numeric max of the version text)."""
    return V.latest_versions(fx.runs(t).where(F.col("stage") == "Production"), "model", "version")


# ---------------------------------------------------------------- trained models (rows-only)

def _scores(pred):
    """The columns that the metrics read, predicted once."""
    return cut_lineage(pred.select("target", "prediction", "probability_1"))


def _trained(t, kind: str):
    train, test = fx.train_rows(t), fx.test_rows(t)
    model = (T.train_random_forest(train, NUM, "target") if kind == "rf"
             else T.train_boosted_trees(train, NUM, "target"))
    return model, T.predict(model, test, NUM, "target")


@query("i01_random_forest")
def i01(t):
    """Random forest (100 trees, depth 10, seed 42) trained before 2000, evaluated after."""
    pred = _scores(_trained(t, "rf")[1])
    return V.classification_metrics(pred, "target", "prediction").withColumn(
        "auc", V.auc(pred, "target", "probability_1").scalar())


@query("i02_boosted_trees")
def i02(t):
    pred = _scores(_trained(t, "gbt")[1])
    return V.classification_metrics(pred, "target", "prediction").withColumn(
        "auc", V.auc(pred, "target", "probability_1").scalar())


@query("i02_newton_trees")
def i02_newton(t):
    """The second boosted variant: Newton steps on histograms, best-first growth (20 trees, rate 0.3)."""
    model = B.train_newton_trees(fx.train_rows(t), NUM, "target", rounds=20, rate=0.3)
    pred = model.predict(fx.test_rows(t))
    return V.classification_metrics(pred, "target", "prediction").withColumn(
        "auc", V.auc(pred, "target", "probability_1").scalar())


@query("i08_grid_search_cv")
def i08(t):
    folds = stratified_kfold(fx.train_rows(t), "id", "target", 5)
    return T.grid_search_cv(folds, NUM, "target", "fold")


@query("i09_learning_curve")
def i09(t):
    folds = stratified_kfold(fx.train_rows(t), "id", "target", 5)
    return T.learning_curve(folds, NUM, "target", "id", "fold")


@query("i10_feature_importance")
def i10(t):
    model, _ = _trained(t, "rf")
    return T.feature_importance(model, NUM)


# ---------------------------------------------------------------- scoring

_W = {"f_total": 1.0e-5, "f_items": 0.1, "f_disc": -5.0}
_B = -2.0
_Z = " + ".join(f"{w!r} * coalesce(CAST({c} AS DOUBLE), 0.0)" for c, w in _W.items())
_P = f"1.0 / (1.0 + exp(-({_B!r} + {_Z})))"


@query("j01_batch_score", doubles=("f_total", "f_disc", "probability"), oracle=with_views(f"""
SELECT id, date, customer_id, f_total, f_items, f_disc, priority, {_P} AS probability,
       ({_P} >= 0.5)::INTEGER AS prediction, TIMESTAMP '2001-08-02 00:00:00' AS prediction_timestamp,
       'logit-1' AS model_version
FROM feature_store""", "feature_store"))
def j01(t):
    """Score a batch with an expression model, stamp version and time, write partitioned, read back."""
    scored = J.score_batch(fx.feature_store(t), J.logistic_model(_W, _B), "logit-1", "2001-08-02 00:00:00")
    path = J.write_predictions(scored.withColumn("month", F.date_format("date", "yyyy-MM")),
                               io.work_path(t.spark, "j01"), ["month"])
    return t.spark.read.parquet(path).drop("month")


@query("j02_append_predictions", doubles=("probability",), oracle=with_views(f"""
SELECT id, {_P} AS probability, ({_P} >= 0.5)::INTEGER AS prediction, 'logit-1' AS model_version
FROM feature_store""", "feature_store"))
def j02(t):
    """Two scoring runs appended to one predictions table (read back)."""
    fs = fx.feature_store(t)
    path = io.work_path(t.spark, "j02")
    m = J.logistic_model(_W, _B)
    for lo, hi in (("1900-01-01", "2000-12-31"), ("2001-01-01", "2999-12-31")):
        b = fs.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
        J.write_predictions(J.score_batch(b, m, "logit-1", "2001-08-02").select(
            "id", "probability", "prediction", "model_version"), path, None, "append")
    return t.spark.read.parquet(path)


@query("j03_foreign_model", doubles=("probability",), oracle=with_views(f"""
SELECT id, {_P} AS probability, ({_P} >= 0.5)::INTEGER AS prediction FROM feature_store_nulls""",
                                                                        "feature_store_nulls"))
def j03(t):
    """A plain Python model object (predict on pandas) applied as a pandas UDF over Arrow batches."""
    m = J.PandasModel(J.LinearScorer(_W, _B), list(_W), 0.5)
    return m.transform(fx.feature_store_nulls(t).select("id", *_W)).select("id", "probability", "prediction")


@query("j04_prediction_log_report", oracle=with_views("""
SELECT coalesce(sum(num_samples), 0)::BIGINT AS total_predictions, count(*)::BIGINT AS total_requests,
       count(DISTINCT model_version)::BIGINT AS n_versions,
       string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS model_versions,
       CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts
FROM service_log WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""", "service_log"))
def j04(t):
    return J.prediction_log_report(fx.service_log(t), "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("j05_volume_spikes", doubles=("trailing_mean",), oracle=with_views("""
SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_mean,
       coalesce(n > 2.0 * avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), false) AS spike
FROM (SELECT date AS day, count(*)::BIGINT AS n FROM feature_store GROUP BY date) d""", "feature_store"))
def j05(t):
    """Daily scoring volume of the feature store against its trailing 7-day mean."""
    return J.volume_spikes(fx.feature_store(t).withColumn("ts", F.col("date")), "ts")
