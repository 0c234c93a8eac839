"""Drift, performance, decisions and alerts (k01-k12).

Reference and current data are unioned into one side-tagged long table and
collapsed to (feature, value, n_ref, n_cur) cells; every drift statistic is
a pass over those cells.  Decisions are one-row projections over one-row
aggregates combined through scalar subqueries (no cross joins).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.exprs import chi2_sf, count_true, ks_pvalue, safe_div
from vigil.functions.ranks import cumulative, quantiles_from_cells


@dataclass(frozen=True)
class DriftParams:
    p_value: float = 0.05          # column drifts when p < this
    dataset_share: float = 0.5     # dataset drift when this share of columns drift
    score_limit: float = 0.05      # reference rule: drift score > 0.05 ...
    share_limit_pct: float = 20.0  # ... or drifted share > 20 %


def _sided(ref: DataFrame, cur: DataFrame, cols: list[str], kind: str) -> DataFrame:
    cast = "double" if kind == "num" else "string"
    def one(df, side):
        return (df.select(*[F.col(c).cast(cast).alias(c) for c in cols])
                .unpivot([], cols, "feature", "value").where(F.col("value").isNotNull())
                .withColumn("side", F.lit(side)))
    return one(ref, "ref").unionByName(one(cur, "cur"))


def _cells(long: DataFrame) -> DataFrame:
    return long.groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("n_ref"),
                                                F.count_if(F.col("side") == "cur").alias("n_cur"))


def ks_two_sample(ref: DataFrame, cur: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """Two-sample KS per numeric column: D = max |F_ref - F_cur| over distinct values."""
    cells = _cells(_sided(ref, cur, cols, "num"))
    cum = cumulative(cells, ["feature"], "value", ["n_ref", "n_cur"], buckets, max_groups=len(cols))
    tot = cells.groupBy("feature").agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    j = cum.join(F.broadcast(tot), "feature")  # one row per feature
    d = F.abs(safe_div("cum_n_ref", "_r") - safe_div("cum_n_cur", "_c"))
    a = j.groupBy("feature").agg(F.max(d).alias("statistic"), F.first("_r").alias("n_ref"),
                                 F.first("_c").alias("n_cur"))
    return a.select("feature", F.lit("ks").alias("test"), "statistic",
                    ks_pvalue("statistic", "n_ref", "n_cur").alias("p_value"), "n_ref", "n_cur")


def chi_square_homogeneity(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """Chi-square test of homogeneity per categorical column (levels x {ref, cur})."""
    cells = _cells(_sided(ref, cur, cols, "cat"))
    tot = cells.groupBy("feature").agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"),
                                       F.count("*").alias("_levels"))
    j = cells.join(F.broadcast(tot), "feature")  # one row per feature
    n = F.col("_r") + F.col("_c")
    row = F.col("n_ref") + F.col("n_cur")
    e_ref, e_cur = row * F.col("_r") / n, row * F.col("_c") / n
    term = (F.pow(F.col("n_ref") - e_ref, 2) / e_ref) + (F.pow(F.col("n_cur") - e_cur, 2) / e_cur)
    a = j.groupBy("feature").agg(F.sum(term).alias("statistic"), F.first("_levels").alias("levels"),
                                 F.first("_r").alias("n_ref"), F.first("_c").alias("n_cur"))
    return a.select("feature", F.lit("chi2").alias("test"), "statistic",
                    chi2_sf("statistic", F.col("levels") - 1).alias("p_value"), "n_ref", "n_cur")


def column_drift(ref: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str],
                 params: DriftParams = DriftParams()) -> DataFrame:
    """k01 per column: KS for numeric, chi-square for categorical; drifted when p < limit."""
    parts = []
    if numeric:
        parts.append(ks_two_sample(ref, cur, numeric))
    if categorical:
        parts.append(chi_square_homogeneity(ref, cur, categorical))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("drifted", F.col("p_value") < params.p_value)


def dataset_drift(columns: DataFrame, params: DriftParams = DriftParams()) -> DataFrame:
    """k01 dataset level: drifted count / total, flag, score (flag as 0/1) and the reference's
    retrain rule: score > 0.05 or drifted share > 20 %."""
    a = columns.agg(count_true(F.col("drifted")).alias("n_drifted"), F.count("*").alias("n_columns"))
    share = F.col("n_drifted") / F.col("n_columns")
    flag = share >= params.dataset_share
    score = flag.cast("double")
    return a.select("n_drifted", "n_columns", share.alias("drift_share"), flag.alias("dataset_drift"),
                    score.alias("drift_score"),
                    ((score > params.score_limit) | (share * 100 > params.share_limit_pct)).alias("drift_detected"))


def drift_distances(ref: DataFrame, cur: DataFrame, cols: list[str], bins: int = 10,
                    floor: float = 1e-4, buckets: int | None = None) -> DataFrame:
    """k02: PSI and Jensen-Shannon (log2) over reference-quantile bins, and 1-D Wasserstein.

    Bins: (-inf, c1], (c1, c2], ..., (c9, inf) with c_i the exact reference deciles.
    PSI = sum (q - p) ln(q / p), proportions floored at 1e-4.
    W1 = sum over distinct values of |F_ref - F_cur| * (next value - value).
    """
    # one (feature, value) -> (n_ref, n_cur) table feeds the deciles, the bins and W1: the
    # rows are aggregated once (map-side), every later step works on distinct values
    cells = _cells(_sided(ref, cur, cols, "num"))
    refc = cells.where(F.col("n_ref") > 0).select("feature", "value", F.col("n_ref").alias("n"))
    cuts = quantiles_from_cells(refc, ["feature"], "value", [i / bins for i in range(1, bins)],
                                max_groups=len(cols))
    cut_arr = cuts.groupBy("feature").agg(F.array_sort(F.collect_list("value_q")).alias("_cuts"))  # bins-1 each
    tagged = cells.join(F.broadcast(cut_arr), "feature")  # one row per feature
    b = tagged.select("feature", "n_ref", "n_cur",
                      F.size(F.filter("_cuts", lambda c: F.col("value") > c)).alias("bin"))
    h = b.groupBy("feature", "bin").agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))
    tot = h.groupBy("feature").agg(F.sum("r").alias("_R"), F.sum("c").alias("_C"))
    h = h.join(F.broadcast(tot), "feature")
    p, q = F.col("r") / F.col("_R"), F.col("c") / F.col("_C")
    pf, qf = F.greatest(p, F.lit(floor)), F.greatest(q, F.lit(floor))
    m = (p + q) / 2
    js_term = (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)) / 2
    dist = h.groupBy("feature").agg(F.sum((qf - pf) * F.log(qf / pf)).alias("psi"), F.sum(js_term).alias("js"))
    cum = cumulative(cells, ["feature"], "value", ["n_ref", "n_cur"], buckets, with_next=True,
                     max_groups=len(cols))
    ct = cells.groupBy("feature").agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    cw = cum.join(F.broadcast(ct), "feature")
    gap = F.abs(F.col("cum_n_ref") / F.col("_r") - F.col("cum_n_cur") / F.col("_c"))
    w1 = cw.groupBy("feature").agg(F.sum(F.coalesce(gap * (F.col("next_value") - F.col("value")), F.lit(0.0)))
                                   .alias("wasserstein"))
    return dist.join(w1, "feature")


def new_data_check(old: DataFrame, new: DataFrame, date_col: str, min_growth_pct: float = 10.0) -> DataFrame:
    """k04: row growth % of the current table over the last training snapshot, max dates."""
    o = old.agg(F.count("*").alias("n_old"), F.max(date_col).alias("max_date_old"))
    n = new.agg(F.struct(F.count("*").alias("n"), F.max(date_col).alias("d"))).scalar()
    growth = (n.getField("n") - F.col("n_old")) / F.col("n_old") * 100
    return o.select(n.getField("n").alias("n_new"), "n_old", growth.alias("growth_pct"),
                    F.col("max_date_old").cast("string").alias("max_date_old"),
                    n.getField("d").cast("string").alias("max_date_new"),
                    (growth >= min_growth_pct).alias("has_new_data"))


# Severity order of alert levels.
SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}


def evaluate_alerts(metrics: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """k05: metric rows (key..., metric, value) x rules (metric, op, limit, severity); keep the
    worst firing severity per key and metric, of equal ones the greatest limit and then operator.
    The caller's rule table carries no hint: Spark broadcasts it while it is small."""
    j = metrics.join(rules, "metric")
    fired = (F.when(F.col("op") == ">", F.col("value") > F.col("limit"))
             .when(F.col("op") == ">=", F.col("value") >= F.col("limit"))
             .when(F.col("op") == "<", F.col("value") < F.col("limit"))
             .when(F.col("op") == "<=", F.col("value") <= F.col("limit")).otherwise(F.lit(False)))
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    f = j.where(fired).withColumn("_rank", rank)
    return (f.groupBy(*key, "metric").agg(F.max(F.struct("_rank", "limit", "op", "severity", "value")).alias("_w"))
            .select(*key, "metric", F.col("_w.severity").alias("severity"), F.col("_w.op").alias("op"),
                    F.col("_w.limit").alias("limit"), F.col("_w.value").alias("value")))


def degradation(baseline: DataFrame, current: DataFrame, correct: str = "is_correct",
                abs_limit: float = 0.05, pct_limit: float = 5.0) -> DataFrame:
    """k06: accuracy now vs baseline; the gate tests the absolute drop > 0.05, the decision the
    relative drop > 5 % -- both are emitted."""
    b = baseline.agg(F.avg(F.col(correct).cast("double")).alias("baseline_accuracy"))
    c = current.agg(F.avg(F.col(correct).cast("double"))).scalar()
    drop = F.col("baseline_accuracy") - c
    drop_pct = safe_div(drop * 100, "baseline_accuracy")
    return b.select("baseline_accuracy", c.alias("current_accuracy"), drop.alias("drop_abs"),
                    drop_pct.alias("drop_pct"), (drop > abs_limit).alias("degraded_abs"),
                    (drop_pct > pct_limit).alias("degraded_pct"))


def retrain_decision(new_data: DataFrame, drift: DataFrame, perf: DataFrame, last_training, as_of,
                     min_growth: float = 10.0, drift_limit: float = 0.05, perf_limit_pct: float = 5.0,
                     max_age_days: int = 30) -> DataFrame:
    """k07: any of new data >= 10 %, drift score > 0.05, degradation > 5 %, >= 30 days since the
    last training -> retrain, with the list of reasons (one row, scalar subqueries)."""
    g = new_data.select("growth_pct").scalar()
    ds = drift.select("drift_score").scalar()
    dp = perf.select("drop_pct").scalar()
    age = F.datediff(F.lit(as_of).cast("date"), F.lit(last_training).cast("date"))
    conds = [(g >= min_growth, "new_data"), (ds > drift_limit, "drift"),
             (dp > perf_limit_pct, "performance"), (age >= max_age_days, "schedule")]
    any_ = F.lit(False)
    for c, _ in conds:
        any_ = any_ | F.coalesce(c, F.lit(False))
    reasons = F.concat_ws(",", *[F.when(c, F.lit(name)) for c, name in conds])  # NULLs skipped
    base = new_data.sparkSession.range(1)
    return base.select(g.alias("growth_pct"), ds.alias("drift_score"), dp.alias("drop_pct"),
                       age.alias("days_since_training"), any_.alias("retrain"), reasons.alias("reasons"))


def promotion_decision(candidate: DataFrame, production: DataFrame, key: str, metric: str,
                       min_improvement: float = 0.01) -> DataFrame:
    """k08: promote when candidate - production >= 0.01 (absolute); otherwise keep / rollback."""
    c = candidate.select(key, F.col(metric).alias("candidate"), F.col("version").alias("candidate_version"))
    p = production.select(key, F.col(metric).alias("production"), F.col("version").alias("production_version"))
    j = c.join(p, key, "full_outer")
    imp = F.col("candidate") - F.col("production")
    return j.select(key, "candidate_version", "production_version", "candidate", "production",
                    imp.alias("improvement"),
                    F.when(F.col("production").isNull(), "promote")
                     .when(F.col("candidate").isNull(), "keep")
                     .when(imp >= min_improvement, "promote").otherwise("keep").alias("decision"))


def rolling_accuracy(log: DataFrame, ts: str = "ts", correct: str = "is_correct",
                     length: str = "7 days", slide: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """k09: sliding-window online accuracy (window aggregate: partial aggregation per window)."""
    w = F.window(F.col(ts), length, slide)  # TIMESTAMP_NTZ windows: no session-zone shift
    a = log.groupBy(*(by or []), w.alias("w")).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"),
                                                   F.count("*").alias("n"))
    return a.select(*(by or []), F.col("w.start").cast("string").alias("window_start"),
                    F.col("w.end").cast("string").alias("window_end"), "accuracy", "n")


def pipeline_health(runs: DataFrame, as_of, dag: str = "dag", start: str = "start_ts", end: str = "end_ts",
                    status: str = "status", max_lag_hours: float = 2.0) -> DataFrame:
    """k10: per pipeline: lag since the last success (> 2 h alert), success rates over the
    last hour and day before ``as_of``, mean duration."""
    asof = F.lit(as_of).cast("timestamp_ntz")
    ok = F.col(status) == "success"
    h1 = F.col(end) > F.timestamp_add("HOUR", F.lit(-1), asof)
    d1 = F.col(end) > F.timestamp_add("DAY", F.lit(-1), asof)
    past = F.col(end) <= asof
    dur = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    a = runs.where(past).groupBy(dag).agg(
        F.max(F.when(ok, F.col(end))).alias("last_success"),
        safe_div(count_true(h1 & ok), count_true(h1)).alias("success_rate_1h"),
        safe_div(count_true(d1 & ok), count_true(d1)).alias("success_rate_1d"),
        F.avg(dur).alias("mean_duration_s"), F.count("*").alias("n_runs"))
    lag = F.timestamp_diff("SECOND", F.col("last_success"), asof) / 3600.0
    return a.select(dag, F.col("last_success").cast("string").alias("last_success"), lag.alias("lag_hours"),
                    F.coalesce(lag > max_lag_hours, F.lit(True)).alias("lag_alert"),
                    "success_rate_1h", "success_rate_1d", "mean_duration_s", "n_runs")


def roll_forward_reference(current: DataFrame, base_path: str, version: str) -> str:
    """k11: the current data becomes the new reference, written to a new versioned folder
    (never overwriting the reference a running job may read)."""
    path = f"{base_path.rstrip('/')}/reference_v={version}"
    current.write.mode("overwrite").parquet(path)
    return path


def classify_incidents(m: DataFrame, accuracy_drop_pct: Column, latency_ratio: Column, error_rate: Column,
                       parity_gap: Column | None = None, disparate_impact: Column | None = None) -> DataFrame:
    """k12: incident type and severity from metric deltas (governance thresholds).

    performance: accuracy drop > 10 %, latency > 2x SLA or error rate > 5 %;
    fairness: parity gap > 0.15 or disparate impact < 0.7;
    severity P0 service down (error rate >= 50 %), P1 degradation > 20 % or fairness,
    P2 degradation 10-20 % (or latency / errors), P3 otherwise.
    """
    perf = (accuracy_drop_pct > 10) | (latency_ratio > 2) | (error_rate > 0.05)
    fair = F.lit(False)
    if parity_gap is not None:
        fair = fair | (parity_gap > 0.15)
    if disparate_impact is not None:
        fair = fair | (disparate_impact < 0.7)
    kind = F.when(fair, "fairness").when(perf, "performance").otherwise("none")
    sev = (F.when(error_rate >= 0.5, "P0").when(fair | (accuracy_drop_pct > 20), "P1")
           .when(perf, "P2").otherwise("P3"))
    return m.withColumns({"incident_type": kind, "severity": sev})
