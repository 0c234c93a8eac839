"""Model evaluation, tuning bookkeeping and run logs (i03-i07, i11-i15).

Classification metrics are computed from the confusion cells
``groupBy(y, p).count()`` (a handful of rows), never from per-class scans;
ranking AUC from distributed cumulative counts; segments and the overall row
come from one ``groupingSets`` pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.exprs import safe_div
from vigil.functions.ranks import cumulative, ordered_running_sums

ALL = "__all__"


def confusion(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """i05: confusion cells (by..., y, p, count)."""
    return df.groupBy(*(by or []), F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("count"))


def _metrics_from_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (0 on zero division)."""
    as_true = cells.select(*by, F.col("y").alias("c"), "count", (F.col("y") == F.col("p")).alias("hit"),
                           F.lit(True).alias("is_true"))
    as_pred = cells.select(*by, F.col("p").alias("c"), "count", (F.col("y") == F.col("p")).alias("hit"),
                           F.lit(False).alias("is_true"))
    per = as_true.unionByName(as_pred).groupBy(*by, "c").agg(
        F.sum(F.when(F.col("is_true"), F.col("count")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_true"), F.col("count")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("is_true") & F.col("hit"), F.col("count")).otherwise(0)).alias("tp"))
    prec = safe_div("tp", "predicted", 0.0)
    rec = safe_div("tp", "support", 0.0)
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    per = per.select(*by, "support", "tp", prec.alias("pc"), rec.alias("rc"), f1.alias("fc"))
    return per.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("support") * F.col("pc")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("support") * F.col("rc")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("support") * F.col("fc")) / F.sum("support")).alias("f1"))


def classification_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """i03: accuracy and weighted precision / recall / F1 in one row."""
    cells = confusion(df, y, p).withColumn("_g", F.lit(ALL))
    return _metrics_from_cells(cells, ["_g"]).drop("_g")


def binary_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", positive=1) -> DataFrame:
    """Precision / recall / F1 of the positive class (binary averaging)."""
    c = df.agg(F.count_if((F.col(y) == positive) & (F.col(p) == positive)).alias("tp"),
               F.count_if((F.col(y) != positive) & (F.col(p) == positive)).alias("fp"),
               F.count_if((F.col(y) == positive) & (F.col(p) != positive)).alias("fn"),
               F.count("*").alias("n"))
    prec = safe_div("tp", F.col("tp") + F.col("fp"), 0.0)
    rec = safe_div("tp", F.col("tp") + F.col("fn"), 0.0)
    return c.select("n", prec.alias("precision"), rec.alias("recall"),
                    F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"))


def auc(df: DataFrame, y: str = "y_true", score: str = "y_prob", by: list[str] | None = None,
        buckets: int | None = None) -> DataFrame:
    """i04: ROC AUC = (sum of positives' average ranks - P(P+1)/2) / (P N); ties averaged.
    NULL unless both classes are present."""
    by = by or []
    cells = (df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
             .groupBy(*by, F.col(score).cast("double").alias("s"))
             .agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("n_pos")))
    return _auc_from_cells(cells, by, buckets)


def _auc_from_cells(cells: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    keys = by or ["_g"]
    if not by:
        cells = cells.withColumn("_g", F.lit(ALL))
    cum = cumulative(cells, keys, "s", ["n"], buckets)
    rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    a = cum.groupBy(*keys).agg(F.sum(F.col("n_pos") * rank).alias("r"), F.sum("n_pos").alias("P"),
                               (F.sum("n") - F.sum("n_pos")).alias("Q"))
    P, Q = F.col("P").cast("double"), F.col("Q").cast("double")
    val = F.when((P > 0) & (Q > 0), (F.col("r") - P * (P + 1) / 2) / (P * Q))
    out = a.select(*keys, val.alias("auc"))
    return out if by else out.drop("_g")


def auc_mllib(df: DataFrame, y: str = "y_true", score: str = "y_prob") -> float:
    """Cross-check through BinaryClassificationEvaluator (returns a number: driver-side API)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    d = df.select(F.col(y).cast("double").alias("label"), F.col(score).cast("double").alias("rawPrediction"))
    return BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(d)


def metrics_by_segment(df: DataFrame, segment: str, y: str = "y_true", p: str = "y_pred",
                       score: str | None = "y_prob") -> DataFrame:
    """i06: i03 (+ i04) per segment plus the overall row, from single grouping-sets passes."""
    seg = F.coalesce(F.col(segment).cast("string"), F.lit("__null__"))
    d = df.withColumn("_seg", seg)
    cells = (d.groupingSets([["_seg", y, p], [y, p]], "_seg", y, p)
             .agg(F.count("*").alias("count"), F.grouping_id().alias("_gid")))
    cells = cells.select(F.when(F.col("_gid") > 0, F.lit(ALL)).otherwise(F.col("_seg")).alias("segment"),
                         F.col(y).alias("y"), F.col(p).alias("p"), "count")
    m = _metrics_from_cells(cells, ["segment"])
    if score is None:
        return m
    sc = (d.where(F.col(score).isNotNull()).groupingSets([["_seg", score], [score]], "_seg", score)
          .agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"), F.grouping_id().alias("_gid")))
    sc = sc.select(F.when(F.col("_gid") > 0, F.lit(ALL)).otherwise(F.col("_seg")).alias("segment"),
                   F.col(score).cast("double").alias("s"), "n", "n_pos")
    return m.join(_auc_from_cells(sc, ["segment"]), "segment", "left")


def threshold_sweep(df: DataFrame, thresholds: list[float], y: str = "y_true", score: str = "y_prob") -> DataFrame:
    """i07: confusion counts at every threshold (score >= t is positive) in ONE aggregate
    (4 conditional counts per threshold), then one row per threshold."""
    aggs = []
    for i, t in enumerate(thresholds):
        pos = F.col(score) >= t
        aggs += [F.count_if(pos & (F.col(y) == 1)).alias(f"tp{i}"), F.count_if(pos & (F.col(y) != 1)).alias(f"fp{i}"),
                 F.count_if(~pos & (F.col(y) == 1)).alias(f"fn{i}"), F.count_if(~pos & (F.col(y) != 1)).alias(f"tn{i}")]
    a = df.where(F.col(score).isNotNull()).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"), F.col(f"tn{i}").alias("tn"))
                     for i, t in enumerate(thresholds)])
    x = a.select(F.inline(rows))
    prec = safe_div("tp", F.col("tp") + F.col("fp"), 0.0)
    rec = safe_div("tp", F.col("tp") + F.col("fn"), 0.0)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return x.select("threshold", "tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"),
                    F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
                    safe_div(F.col("tp") + F.col("tn"), n).alias("accuracy"),
                    safe_div(F.col("tp") + F.col("fp"), n).alias("positive_rate"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """i11: rmse, mae, mape (%, rows with y != 0), r2 = 1 - SSE / (n var_pop(y))."""
    e = F.col(y) - F.col(yhat)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  (F.avg(F.when(F.col(y) != 0, F.abs(e) / F.abs(F.col(y)))) * 100).alias("mape"),
                  (1 - F.sum(e * e) / (F.count(y) * F.var_pop(y))).alias("r2"),
                  F.count("*").alias("n"))


def regression_metrics_mllib(df: DataFrame, y: str = "y", yhat: str = "yhat", metric: str = "rmse") -> float:
    from pyspark.ml.evaluation import RegressionEvaluator
    return RegressionEvaluator(labelCol=y, predictionCol=yhat, metricName=metric).evaluate(df)


def ranking_metrics(df: DataFrame, query: str, item: str, score: str, rel: str, k: int = 10) -> DataFrame:
    """i12: mean NDCG@k, MAP and MRR over queries (binary or graded relevance).

    Ranks are per query (score descending, ties by item); queries without relevant items
    score 0 for AP / RR and NULL NDCG (skipped in the mean).

    A query can hold a large share of the rows, so nothing runs one window per query:
    DCG@k / IDCG@k need only each query's top k (``row_number() <= k``, limited per
    partition before the shuffle), and the full ranks that AP and MRR need come from
    ``ordered_running_sums`` (range slices of the composite order)."""
    items = df.select(F.col(query).alias("_q"), F.col(item).alias("_i"),
                      F.col(score).alias("_s"), F.col(rel).cast("double").alias("rel"))
    items = items.withColumn("_one", F.lit(1)).withColumn("_hit", (F.col("rel") > 0).cast("int"))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    disc = lambda c: F.lit(1.0) / F.log2(F.col(c) + 1)

    w = Window.partitionBy("_q").orderBy(F.col("_s").desc(), F.col("_i"))
    wi = Window.partitionBy("_q").orderBy(F.col("rel").desc(), F.col("_i"))
    top = items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    itop = items.withColumn("_r", F.row_number().over(wi)).where(F.col("_r") <= k)
    dcg = top.groupBy("_q").agg(F.sum(gain * disc("_r")).alias("dcg"))
    idcg = itop.groupBy("_q").agg(F.sum(gain * disc("_r")).alias("idcg"))

    ranked = ordered_running_sums(items, ["_q"], [F.col("_s").desc(), F.col("_i")], ["_one", "_hit"])
    per_q = ranked.groupBy("_q").agg(
        F.sum("_hit").alias("n_rel"),
        F.sum(F.when(F.col("_hit") == 1, F.col("cum__hit") / F.col("cum__one")).otherwise(0.0)).alias("ap_sum"),
        F.min(F.when(F.col("_hit") == 1, F.col("cum__one"))).alias("first_rel"))
    q = per_q.join(dcg, "_q").join(idcg, "_q")  # one row per query on every side
    return q.agg(F.avg(safe_div("dcg", "idcg")).alias(f"ndcg_at_{k}"),
                 F.avg(F.coalesce(safe_div("ap_sum", "n_rel"), F.lit(0.0))).alias("map"),
                 F.avg(F.coalesce(safe_div(F.lit(1.0), "first_rel"), F.lit(0.0))).alias("mrr"),
                 F.count("*").alias("n_queries"))


# Approval gates (training pipeline; canary; production config).
GATES = {
    "training": (("accuracy", 0.70), ("f1", 0.65)),
    "canary": (("accuracy", 0.75),),
    "production": (("accuracy", 0.80), ("precision", 0.75), ("recall", 0.70), ("f1", 0.72)),
}


def approval_gate(metrics: DataFrame, gate: str = "training") -> DataFrame:
    """i13: metric row x threshold table -> per-check rows and an ``approved`` flag."""
    checks = GATES[gate]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                              F.lit(th).alias("minimum"), (F.col(m) >= th).alias("passed")) for m, th in checks])
    long = metrics.select(F.inline(rows))
    ok = long.agg(F.bool_and("passed")).scalar()
    return long.withColumn("gate", F.lit(gate)).withColumn("approved", ok)


def leaderboard(runs: DataFrame, metric: str, k: int = 10, where: Column | None = None,
                key: str = "run_id") -> DataFrame:
    """i14: top-k runs by a metric (a top-k report)."""
    r = runs.where(where) if where is not None else runs
    return r.orderBy(F.col(metric).desc(), F.col(key)).limit(k)


def compare_runs(runs: DataFrame, run_ids: list, metrics: list[str], key: str = "run_id") -> DataFrame:
    """i14: selected runs x metrics, metrics as rows and runs as columns (pivot with known ids)."""
    long = runs.where(F.col(key).isin(run_ids)).select(key, *metrics).unpivot(key, metrics, "metric", "value")
    return long.groupBy("metric").pivot(key, run_ids).agg(F.first("value"))


def latest_versions(versions: DataFrame, model: str = "model", version: str = "version",
                    stage: str | None = None, stage_col: str = "stage", tie: str = "run_id") -> DataFrame:
    """i15: latest version per model (numeric max of the version text, then the largest ``tie``), optional stage."""
    v = versions.where(F.col(stage_col) == stage) if stage else versions
    others = [c for c in v.columns if c != model]
    return (v.groupBy(model).agg(F.max_by(F.struct(*others), F.struct(F.col(version).cast("int"), F.col(tie))).alias("_r"))
            .select(model, *[F.col(f"_r.{c}").alias(c) for c in others]))
