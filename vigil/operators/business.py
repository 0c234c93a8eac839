"""Business-impact metrics (d01-d11).

Each metric is one fused aggregate over the scored table, returned as a
typed one-row (or one-row-per-segment) DataFrame.  Nothing is collected:
ROI, combined runs and health scores are projections over the aggregate
row, so the whole report is a single job with one scan per input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.exprs import count_true, is_one, safe_div


@dataclass(frozen=True)
class RevenueParams:
    # Fixed values (defaults of the reference's revenue model).
    revenue_per_tp: float = 1000.0
    cost_per_fp: float = 100.0
    cost_per_fn: float = 2000.0
    assumed_precision: float = 0.8
    unit: str = "BRL"


@dataclass(frozen=True)
class CombinedParams:
    # Fixed values used by the reference's combined business run.
    baseline_cost_per_customer: float = 50.0
    model_cost_per_customer: float = 10.0
    development_cost: float = 100000.0
    operational_cost_monthly: float = 5000.0
    months_in_production: int = 1
    health_divisor: float = 100000.0


def confusion_join(predictions: DataFrame, actuals: DataFrame, key: str = "customer_id") -> DataFrame:
    """c01: inner equi-join of predictions and actuals (duplicate keys multiply, as a merge does)."""
    return predictions.join(actuals, on=key, how="inner")


def _confusion_cells(pred="prediction", actual="actual"):
    p1, a1 = is_one(pred), is_one(actual)
    p0 = F.coalesce(F.col(pred) == 0, F.lit(False))
    a0 = F.coalesce(F.col(actual) == 0, F.lit(False))
    return [count_true(p1 & a1).alias("tp"), count_true(p1 & a0).alias("fp"),
            count_true(p0 & a1).alias("fn"), count_true(p0 & a0).alias("tn")]


def _revenue_cols(p: RevenueParams):
    rev = F.col("tp") * F.lit(p.revenue_per_tp)
    cfp = F.col("fp") * F.lit(p.cost_per_fp)
    cfn = F.col("fn") * F.lit(p.cost_per_fn)
    return rev, cfp, cfn


def revenue_impact(predictions: DataFrame, actuals: DataFrame | None = None,
                   key: str = "customer_id", params: RevenueParams = RevenueParams()) -> DataFrame:
    """d01 (with actuals) / d02 (estimated from positive predictions)."""
    if actuals is None:
        agg = predictions.agg(count_true(is_one("prediction")).alias("n_positive_predictions"))
        return agg.select(
            F.lit("revenue_impact").alias("metric"),
            (F.col("n_positive_predictions") * F.lit(params.revenue_per_tp)
             * F.lit(params.assumed_precision)).cast("double").alias("value"),
            F.lit(params.unit).alias("unit"), F.lit("estimated").alias("kind"),
            "n_positive_predictions",
            F.lit(params.assumed_precision).alias("assumed_precision"))
    agg = confusion_join(predictions, actuals, key).agg(*_confusion_cells())
    rev, cfp, cfn = _revenue_cols(params)
    return agg.select(
        F.lit("revenue_impact").alias("metric"),
        (rev - cfp - cfn).cast("double").alias("value"),
        F.lit(params.unit).alias("unit"), F.lit("actual").alias("kind"),
        "tp", "fp", "fn", "tn",
        rev.cast("double").alias("revenue_from_tp"),
        cfp.cast("double").alias("cost_from_fp"),
        cfn.cast("double").alias("cost_from_fn"))


def churn_rate(customers: DataFrame, churned: str = "churned") -> DataFrame:
    """d03: % of rows with churned == 1 (NULL counts as not churned)."""
    return customers.agg(
        (F.avg(is_one(churned).cast("double")) * 100).alias("value"),
        F.count("*").alias("total_customers"),
        count_true(is_one(churned)).alias("churned_customers"),
    ).select(F.lit("churn_rate").alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"),
             F.lit("percentage").alias("unit"), "total_customers", "churned_customers")


def _cost_cols(n, baseline: float, model: float):
    base = n * F.lit(float(baseline))
    mod = n * F.lit(float(model))
    red = base - mod
    pct = F.when(base > 0, red / base * 100).otherwise(F.lit(0.0))
    return base, mod, red, pct


def cost_reduction(predictions: DataFrame, baseline_cost_per_customer: float,
                   model_cost_per_customer: float, unit: str = "BRL") -> DataFrame:
    """d04: (baseline - model) cost over all scored rows; % is 0 when baseline <= 0."""
    agg = predictions.agg(F.count("*").alias("n_customers"))
    base, mod, red, pct = _cost_cols(F.col("n_customers"), baseline_cost_per_customer,
                                     model_cost_per_customer)
    return agg.select(F.lit("cost_reduction").alias("metric"), red.cast("double").alias("value"),
                      F.lit(unit).alias("unit"), "n_customers",
                      base.cast("double").alias("baseline_total_cost"),
                      mod.cast("double").alias("model_total_cost"),
                      pct.cast("double").alias("cost_reduction_pct"))


def _roi_cols(revenue, dev: float, op_monthly: float, months: int):
    total = F.lit(float(dev) + float(op_monthly) * months)
    roi = F.when(total == 0, F.lit(0.0)).otherwise((revenue - total) / total * 100)
    return total, roi


def roi(revenue: DataFrame, development_cost: float, operational_cost_monthly: float,
        months_in_production: int = 1, value_col: str = "value") -> DataFrame:
    """d05: ROI % over a revenue row; 0 when the total cost is 0."""
    total, r = _roi_cols(F.col(value_col), development_cost, operational_cost_monthly,
                         months_in_production)
    return revenue.select(
        F.lit("roi").alias("metric"), r.cast("double").alias("value"),
        F.lit("percentage").alias("unit"),
        F.col(value_col).cast("double").alias("revenue_impact"),
        total.cast("double").alias("total_cost"),
        F.lit(float(development_cost)).alias("development_cost"),
        F.lit(float(operational_cost_monthly) * months_in_production).alias("operational_cost"),
        F.lit(int(months_in_production)).alias("months_in_production"))


def satisfaction(feedback: DataFrame, score: str = "nps_score") -> DataFrame:
    """d06: mean, sample std, min, max and n (n counts NULL scores, like len())."""
    return feedback.agg(
        F.avg(score).alias("value"), F.stddev_samp(score).alias("std"),
        F.min(score).cast("double").alias("min"), F.max(score).cast("double").alias("max"),
        F.count("*").alias("n_responses"),
    ).select(F.lit("customer_satisfaction").alias("metric"), "value", F.lit("score").alias("unit"),
             F.lit(score).alias("score_type"), "std", "min", "max", "n_responses")


def process_efficiency(processes: DataFrame, before: str = "before_h", after: str = "after_h") -> DataFrame:
    """d07: hours saved summed over processes; gain % = saved / before-hours (0 when <= 0)."""
    agg = processes.agg(F.sum(F.col(before) - F.col(after)).alias("saved"),
                        F.sum(before).alias("before_total"), F.count("*").alias("n_processes"))
    return agg.select(
        F.lit("process_efficiency_gain").alias("metric"),
        F.coalesce("saved", F.lit(0.0)).cast("double").alias("value"), F.lit("hours").alias("unit"),
        safe_div("saved", "n_processes", 0.0).alias("time_saved_per_process"),
        F.when(F.col("before_total") > 0, F.col("saved") / F.col("before_total") * 100)
         .otherwise(F.lit(0.0)).cast("double").alias("efficiency_gain_pct"),
        "n_processes")


def metric_summary(history: DataFrame, as_of, last_n_days: int = 7,
                   name: str = "name", value: str = "value", ts: str = "ts") -> DataFrame:
    """d08 (with b07): per metric name mean / sample std / min / max / count over the last N days."""
    cutoff = F.timestamp_add("DAY", F.lit(-int(last_n_days)), F.lit(as_of).cast("timestamp_ntz"))
    return (history.where(F.col(ts) >= cutoff)
            .groupBy(name)
            .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                 F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count")))


def combined_run(predictions: DataFrame, actuals: DataFrame | None, key: str = "customer_id",
                 rp: RevenueParams = RevenueParams(), cp: CombinedParams = CombinedParams()) -> DataFrame:
    """d09: revenue, cost reduction and ROI rows from one aggregate pass."""
    if actuals is None:
        agg = predictions.agg(count_true(is_one("prediction")).alias("n_pos"),
                              F.count("*").alias("n_rows"))
        revenue = F.col("n_pos") * F.lit(rp.revenue_per_tp * rp.assumed_precision)
        n = F.col("n_rows")
    else:
        # The cost rows count every scored row, the revenue row only the joined ones:
        # the row count is a scalar subquery, not a second pass over the join.
        agg = confusion_join(predictions, actuals, key).agg(*_confusion_cells())
        n_rows = predictions.agg(F.count("*")).scalar()
        rev, cfp, cfn = _revenue_cols(rp)
        revenue = rev - cfp - cfn
        n = n_rows
    _, _, red, _ = _cost_cols(n, cp.baseline_cost_per_customer, cp.model_cost_per_customer)
    _, r = _roi_cols(revenue, cp.development_cost, cp.operational_cost_monthly, cp.months_in_production)
    rows = F.array(
        F.struct(F.lit("revenue_impact").alias("metric"), revenue.cast("double").alias("value"),
                 F.lit(rp.unit).alias("unit")),
        F.struct(F.lit("cost_reduction").alias("metric"), red.cast("double").alias("value"),
                 F.lit(rp.unit).alias("unit")),
        F.struct(F.lit("roi").alias("metric"), r.cast("double").alias("value"),
                 F.lit("percentage").alias("unit")))
    return agg.select(F.inline(rows))


def health_score(metrics: DataFrame, divisor: float = 100000.0) -> DataFrame:
    """d10: (revenue_impact + cost_reduction) / divisor over a long metric table."""
    return metrics.agg(
        ((F.sum(F.when(F.col("metric") == "revenue_impact", F.col("value")))
          + F.sum(F.when(F.col("metric") == "cost_reduction", F.col("value"))))
         / F.lit(float(divisor))).alias("health_score"))


def segment_impact(scored: DataFrame, segment: str, pred: str = "prediction", actual: str = "actual",
                   rp: RevenueParams = RevenueParams()) -> DataFrame:
    """d11: per-segment conversion lift and revenue drill-down, with a total row (rollup)."""
    agg = (scored.rollup(segment)
           .agg(F.count("*").alias("n"), *_confusion_cells(pred, actual),
                F.avg(is_one(actual).cast("double")).alias("actual_rate"),
                F.grouping_id().alias("gid")))
    rev, cfp, cfn = _revenue_cols(rp)
    precision = safe_div("tp", F.col("tp") + F.col("fp"))
    return agg.select(
        F.when(F.col("gid") == 1, F.lit("__total__")).otherwise(F.col(segment).cast("string")).alias("segment"),
        "n", "tp", "fp", "fn", "tn", "actual_rate",
        precision.alias("precision"),
        (rev - cfp - cfn).cast("double").alias("revenue_impact"))


def with_lift(seg: DataFrame) -> DataFrame:
    """Conversion lift = precision in segment / overall actual rate (from the rollup total row)."""
    overall = seg.where(F.col("segment") == "__total__").select(F.col("actual_rate")).scalar()
    return seg.withColumn("lift", safe_div(F.col("precision"), overall))
