"""Release comparison (n01-n04), re-aimed from the canary rollout manager.

Service metrics per model version come from the durable prediction log: one
grouping-sets pass gives the per-version and the traffic-weighted total rows,
exact latency percentiles come from distributed cumulative counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.exprs import md5_uniform, norm_cdf, safe_div
from vigil.functions.ranks import join_null_safe, quantiles_from_cells
from vigil.roles import ReleaseLimits

TOTAL = "__total__"


def service_metrics(log: DataFrame, version: str = "model_version", latency: str = "latency_ms",
                    error: str = "is_error", correct: str = "is_correct", by: list[str] | None = None,
                    with_total: bool = True, percentiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """n01: per version error rate, latency p50 / p95 / p99 (exact; only those asked for), accuracy, requests;
    plus a total row over all traffic (grouping sets, one pass).  NULL is a version like any other."""
    by = by or []
    keys = [*by, version]
    sets = [keys, by] if with_total else [keys]
    g = F.grouping_id()
    a = (log.groupingSets(sets, *keys)
         .agg(F.count("*").alias("n"), F.avg(F.col(error).cast("double")).alias("error_rate"),
              F.avg(F.col(correct).cast("double")).alias("accuracy"), g.alias("_gid")))
    a = a.withColumn(version, F.when(F.col("_gid") > 0, F.lit(TOTAL)).otherwise(F.col(version))).drop("_gid")
    if not percentiles:
        return a
    cells = (log.where(F.col(latency).isNotNull())
             .groupingSets([[*keys, latency], [*by, latency]] if with_total else [[*keys, latency]], *keys, latency)
             .agg(F.count("*").alias("n"), F.grouping_id().alias("_gid")))
    cells = cells.withColumn(version, F.when(F.col("_gid") > 0, F.lit(TOTAL)).otherwise(F.col(version))).drop("_gid")
    q = quantiles_from_cells(cells, keys, latency, list(percentiles))
    qw = q.groupBy(*keys).pivot("q", list(percentiles)).agg(F.first("value_q")) \
        .toDF(*keys, *[f"latency_p{round(100 * p)}" for p in percentiles])
    return join_null_safe(a, qw, keys, "left")


def health_verdict(metrics: DataFrame, canary: str, production: str, version: str = "model_version",
                   by: list[str] | None = None, limits: ReleaseLimits = ReleaseLimits()) -> DataFrame:
    """n02: canary vs production; first failing check in the reference's order."""
    by = by or []
    return verdict(metrics.where(F.col(version) == canary), metrics.where(F.col(version) == production),
                   by, by, limits)


def verdict(canary_m: DataFrame, production_m: DataFrame, by: list[str], production_by: list[str],
            limits: ReleaseLimits = ReleaseLimits()) -> DataFrame:
    """Checks of one canary metric row per ``by`` key against production metrics; when the
    production side has no key (one row) it enters as a scalar subquery, not a join."""
    c = canary_m.select(*by, *[F.col(x).alias(f"c_{x}") for x in ("error_rate", "latency_p95", "accuracy", "n")])
    p = production_m.select(*production_by, *[F.col(x).alias(f"p_{x}") for x in
                                              ("error_rate", "latency_p95", "accuracy")])
    if production_by:
        j = c.join(p, production_by)
    else:
        prow = p.select(F.struct("p_error_rate", "p_latency_p95", "p_accuracy")).scalar()
        j = c.select("*", *[prow.getField(f).alias(f) for f in ("p_error_rate", "p_latency_p95", "p_accuracy")])
    fail = F.coalesce(
        F.when(F.col("c_error_rate") > limits.max_error_rate, F.lit("error_rate")),
        F.when(F.col("c_latency_p95") > limits.max_latency_p95_ms, F.lit("latency_p95")),
        F.when(F.col("p_accuracy") - F.col("c_accuracy") > limits.max_accuracy_drop, F.lit("accuracy_drop")),
        F.when(F.col("c_error_rate") > limits.error_ratio_vs_production * F.col("p_error_rate"),
               F.lit("error_vs_production")))
    return j.select(*by, "c_error_rate", "p_error_rate", "c_latency_p95", "c_accuracy", "p_accuracy",
                    (F.col("p_accuracy") - F.col("c_accuracy")).alias("accuracy_drop"),
                    fail.alias("failed_check"), fail.isNull().alias("healthy"))


def staged_rollout(log: DataFrame, key: str, canary: str, production: str, version: str = "model_version",
                   limits: ReleaseLimits = ReleaseLimits()) -> DataFrame:
    """n03: replay the rollout.  Traffic bucket = floor(100 * u(key)) (deterministic); at a stage
    of pct %, canary serves its requests with bucket < pct.  Per stage: n01 -> n02, then a
    running AND over stages: the rollout stops at the first failing stage."""
    stages = F.array(*[F.lit(s) for s in limits.stages])
    bucket = F.floor(md5_uniform(key) * 100)
    # canary rows join every stage whose share covers their bucket (1.9x canary rows in all);
    # production serves the rest at every stage: it enters once (stage -1), its metric row is
    # then repeated for the five stage rows -- one metrics pass for both versions.
    c = (log.where(F.col(version) == canary).withColumn("_b", bucket)
         .select("*", F.explode(stages).alias("stage")).where(F.col("_b") < F.col("stage")).drop("_b"))
    p = log.where(F.col(version) == production).withColumn("stage", F.lit(-1))
    # the per-(stage, version) metric table is tiny and read by several branches: computed once
    # and checkpointed into the shared folder
    from vigil.session import cut_lineage
    m = cut_lineage(service_metrics(c.unionByName(p), version, by=["stage"], with_total=False, percentiles=(0.95,)))
    mp = m.where(F.col("stage") == -1).drop("stage").select("*", F.explode(stages).alias("stage"))
    v = verdict(m.where(F.col("stage") >= 0), mp, ["stage"], ["stage"], limits)
    w = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)  # five stage rows
    return v.withColumn("promoted_through", F.min(F.col("healthy").cast("int")).over(w) == 1)


def two_proportion_test(metrics: DataFrame, a: str, b: str, rate: str = "error_rate",
                        version: str = "model_version") -> DataFrame:
    """n04: two-proportion z test between versions a and b on a rate column."""
    ra = metrics.where(F.col(version) == a).select(F.col(rate).alias("p1"), F.col("n").alias("n1"))
    rb = metrics.where(F.col(version) == b).select(F.struct(F.col(rate).alias("p"), F.col("n").alias("n"))).scalar()
    p2, n2 = rb.getField("p"), rb.getField("n")
    pool = (F.col("p1") * F.col("n1") + p2 * n2) / (F.col("n1") + n2)
    se = F.sqrt(pool * (1 - pool) * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / n2))
    z = safe_div(F.col("p1") - p2, se)
    return ra.select(F.lit(a).alias("version_a"), F.lit(b).alias("version_b"), F.col("p1").alias("rate_a"),
                     p2.alias("rate_b"), z.alias("z"), (2 * (1 - norm_cdf(F.abs(z)))).alias("p_value"),
                     ((2 * (1 - norm_cdf(F.abs(z)))) < 0.05).alias("significant"))
