"""Fairness audit (l01-l12).

The reference loops attribute x group x metric with one boolean mask per
loop.  Here every sensitive attribute is unpivoted into one long
(attribute, group) table and a single grouped aggregate produces all group
rates (positive rate, TPR, FPR, PPV, calibration bins); the per-attribute
spreads are a second aggregate over that small group table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.exprs import md5_uniform, safe_div
from vigil.roles import FairnessLimits
from vigil.session import cut_lineage

# Calibration bin edges as numpy.linspace(0, 1, 11) builds them (i * 0.1),
# so that digitize semantics (p = 1.0 falls outside the ten bins) are reproduced exactly.
CAL_EDGES = tuple(i * 0.1 for i in range(10)) + (1.0,)


def _long(df: DataFrame, attrs: list[str], keep: list[str]) -> DataFrame:
    wide = df.select(*keep, *[F.col(a).cast("string").alias(a) for a in attrs])
    # NULL attribute values form no group (a NULL never equals a group value in the reference)
    return wide.unpivot(keep, attrs, "attribute", "group").where(F.col("group").isNotNull())


def group_rates(df: DataFrame, attrs: list[str], y: str = "y_true", p: str = "y_pred",
                favorable=1) -> DataFrame:
    """(attribute, group): n, positive rate, TPR, FPR, PPV (NULL where undefined)."""
    long = _long(df, attrs, [y, p])
    yp = F.coalesce(F.col(y) == favorable, F.lit(False))
    yn = F.coalesce(F.col(y) != favorable, F.lit(True))
    pp = F.coalesce(F.col(p) == favorable, F.lit(False))
    return long.groupBy("attribute", "group").agg(
        F.count("*").alias("n"),
        F.avg(pp.cast("double")).alias("positive_rate"),
        safe_div(F.count_if(pp & yp), F.count_if(yp)).alias("tpr"),
        safe_div(F.count_if(pp & yn), F.count_if(yn)).alias("fpr"),
        safe_div(F.count_if(pp & yp), F.count_if(pp)).alias("ppv"))


def calibration_by_group(df: DataFrame, attrs: list[str], y: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """l06: per group ECE = unweighted mean over non-empty bins of |mean(y) - mean(p)|;
    p = 1.0 is outside every bin (dropped) but still counted in n_samples."""
    long = _long(df, attrs, [y, prob])
    pr = F.col(prob).cast("double")
    idx = sum(((pr >= F.lit(e)).cast("int") for e in CAL_EDGES), F.lit(0)) - 1
    bins = (long.withColumn("bin", idx)
            .groupBy("attribute", "group", "bin")
            .agg(F.count("*").alias("cnt"), F.avg(F.col(y).cast("double")).alias("t"), F.avg(pr).alias("q")))
    return bins.groupBy("attribute", "group").agg(
        F.sum("cnt").alias("n_samples"),
        F.avg(F.when((F.col("bin") >= 0) & (F.col("bin") < 10), F.abs(F.col("t") - F.col("q")))).alias("ece"))


def _spread(c: str, min_valid: int) -> F.Column:
    return F.when(F.count(c) >= min_valid, F.max(c) - F.min(c))


def fairness_summary(df: DataFrame, attrs: list[str], y: str = "y_true", p: str = "y_pred",
                     prob: str | None = "y_prob", limits: FairnessLimits = FairnessLimits(),
                     parity_limit: float | None = None) -> DataFrame:
    """l01-l07: per attribute and metric: value (spread or ratio), FPR spread for equalized
    odds, pass flag (NULL when the spread is undefined)."""
    g = group_rates(df, attrs, y, p)
    if prob is not None:
        g = g.join(calibration_by_group(df, attrs, y, prob), ["attribute", "group"], "left")
    else:
        g = g.withColumn("ece", F.lit(None).cast("double"))
    a = g.groupBy("attribute").agg(
        _spread("positive_rate", 1).alias("dp"), _spread("tpr", 2).alias("eo"), _spread("fpr", 2).alias("fpr_s"),
        F.when(F.max("positive_rate") > 0, F.min("positive_rate") / F.max("positive_rate"))
         .otherwise(F.lit(0.0)).alias("di"),
        _spread("ppv", 2).alias("pp"), _spread("ece", 2).alias("cal"))
    dp_lim = limits.demographic_parity if parity_limit is None else parity_limit
    nul = F.lit(None).cast("double")
    def row(name, value, fpr, passes):
        return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"),
                        fpr.cast("double").alias("fpr_value"), passes.cast("boolean").alias("passes"))
    rows = F.array(
        row("demographic_parity", F.col("dp"), nul, F.col("dp") <= dp_lim),
        row("equal_opportunity", F.col("eo"), nul, F.col("eo") <= limits.equal_opportunity),
        row("equalized_odds", F.col("eo"), F.col("fpr_s"),
            (F.col("eo") <= limits.equalized_odds) & (F.col("fpr_s") <= limits.equalized_odds)),
        row("disparate_impact", F.col("di"), nul, F.col("di") >= limits.disparate_impact),
        row("predictive_parity", F.col("pp"), nul, F.col("pp") <= limits.predictive_parity),
        row("calibration", F.col("cal"), nul, F.lit(None)))
    return a.select("attribute", F.inline(rows))


def intersectional(df: DataFrame, attrs: list[str], sep: str = "_") -> DataFrame:
    """l08: intersectional attribute (e.g. gender_age) as one more column."""
    return df.withColumn(sep.join(attrs), F.concat_ws(sep, *[F.col(a).cast("string") for a in attrs]))


def compliance_violations(summary: DataFrame, limits: FairnessLimits = FairnessLimits()) -> DataFrame:
    """l09: demographic parity > 0.1, equal opportunity > 0.1, disparate impact < 0.8."""
    m, v = F.col("metric"), F.col("value")
    bad = (((m == "demographic_parity") & (v > limits.demographic_parity))
           | ((m == "equal_opportunity") & (v > limits.equal_opportunity))
           | ((m == "disparate_impact") & (v < limits.disparate_impact)))
    thr = (F.when(m == "demographic_parity", limits.demographic_parity)
           .when(m == "equal_opportunity", limits.equal_opportunity).otherwise(limits.disparate_impact))
    return summary.where(F.coalesce(bad, F.lit(False))).select("attribute", "metric", "value", thr.alias("threshold"))


def assert_compliance(summary: DataFrame, limits: FairnessLimits = FairnessLimits()) -> DataFrame:
    """l09 raising form (the caller's option): AssertionError when any violation exists."""
    v = compliance_violations(summary, limits)
    if not v.isEmpty():
        raise AssertionError("fairness compliance failed")
    return v


def severe_bias(summary: DataFrame, limit: float = 0.2) -> DataFrame:
    """l10: metrics reporting a max difference (parity, opportunity, predictive parity) above 0.2;
    calibration excluded."""
    return summary.where(F.col("metric").isin("demographic_parity", "equal_opportunity", "predictive_parity")
                         & (F.col("value") > limit))


def audit_report(df: DataFrame, summary: DataFrame, attrs: list[str], audit_ts) -> DataFrame:
    """l11: summary rows stamped with the audit time, sample count and attribute list."""
    n = df.agg(F.count("*")).scalar()
    return summary.select(F.lit(audit_ts).cast("timestamp_ntz").cast("string").alias("audit_ts"),
                          n.alias("n_samples"), F.lit(",".join(attrs)).alias("attributes"), "*")


def group_thresholds(df: DataFrame, attrs: list[str], prob: str = "y_prob", p: str = "y_pred",
                     grid=tuple(round(0.05 * i, 2) for i in range(1, 20)), target_rate: float | None = None) -> DataFrame:
    """l12: per group, the decision threshold whose positive rate is closest to a target rate
    (default: the overall predicted-positive rate).  One aggregate with a conditional count per
    grid point, then min_by over the (group x grid) table."""
    long = _long(df, attrs, [prob, p])
    aggs = [F.count("*").alias("n")] + [F.count_if(F.col(prob) >= t).alias(f"t{i}") for i, t in enumerate(grid)]
    a = long.groupBy("attribute", "group").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("k")) for i, t in enumerate(grid)])
    x = a.select("attribute", "group", "n", F.inline(rows)).withColumn("rate", F.col("k") / F.col("n"))
    tgt = (F.lit(float(target_rate)) if target_rate is not None
           else df.agg(F.avg(F.coalesce(F.col(p) == 1, F.lit(False)).cast("double"))).scalar())
    return x.groupBy("attribute", "group").agg(
        F.min_by(F.struct("threshold", "rate"), F.struct(F.abs(F.col("rate") - tgt), F.col("threshold"))).alias("b"),
    ).select("attribute", "group", F.col("b.threshold").alias("threshold"), F.col("b.rate").alias("positive_rate"),
             tgt.alias("target_rate"))


#: Resolution of scores and of false positive rates in ``equalised_odds``.
SCORE_BINS, RATE_STEPS = 1000, 200


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ROC convex hull of one group at RATE_STEPS + 1 false positive rates: which two thresholds reach the point on
    it, and with what weight the lower one.  ``pdf``: group, bin, positives, negatives; one row per score bin."""
    pdf = pdf.sort_values("bin", ascending=False)
    pos, neg = pdf["positives"].sum(), pdf["negatives"].sum()
    if not pos or not neg:
        return pd.DataFrame(columns=["group", "f", "t", "high", "low", "weight_low"])
    f = np.append(0, pdf["negatives"].cumsum().to_numpy() / neg)
    t = np.append(0, pdf["positives"].cumsum().to_numpy() / pos)
    threshold = np.append(SCORE_BINS + 1, pdf["bin"].to_numpy()) / SCORE_BINS
    keep: list[int] = []
    for i in range(len(f)):                                   # upper hull, left to right
        while keep and f[keep[-1]] == f[i]:
            keep.pop()
        while len(keep) > 1 and (t[keep[-1]] - t[keep[-2]]) * (f[i] - f[keep[-2]]) <= (t[i] - t[keep[-2]]) * (f[keep[-1]] - f[keep[-2]]):
            keep.pop()
        keep.append(i)
    keep = np.array(keep)
    at = np.arange(RATE_STEPS + 1) / RATE_STEPS
    hi = np.minimum(np.searchsorted(f[keep], at, side="left"), len(keep) - 1)
    lo = np.maximum(hi - 1, 0)
    lo = np.where(f[keep][hi] == at, hi, lo)
    width = f[keep][hi] - f[keep][lo]
    weight = np.where(width > 0, (at - f[keep][lo]) / np.where(width > 0, width, 1), 1.0)
    rate = t[keep][lo] * (1 - weight) + t[keep][hi] * weight
    return pd.DataFrame({"group": pdf["group"].iat[0], "f": at, "t": rate, "high": threshold[keep][lo], "low": threshold[keep][hi],
                         "weight_low": weight})


def equalised_odds(df: DataFrame, attr: str, y: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """l12: per group of ``attr``, randomised thresholds under which all groups have the same TPR and FPR.

    Every group's ROC convex hull comes from its score bins (one partial aggregate; at most SCORE_BINS rows a group).
    What all groups can reach at a false positive rate is the least of their hulls; of those points the one with the
    largest TPR - FPR is taken, then the smallest FPR.  A group reaches it by mixing two thresholds up to its hull, and a coin
    of that false positive rate down from it.  Groups without both labels have no hull and no row.  NULL scores count
    as 0, NULL groups as a group.

    (group, high, low, weight_low, weight_hull, coin, tpr, fpr): see ``equalised_predictions``.
    """
    bin_ = F.floor(F.least(F.greatest(F.coalesce(F.col(prob), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * SCORE_BINS).cast("int")
    cells = df.where(F.col(y).isNotNull()).groupBy(F.col(attr).cast("string").alias("group"), bin_.alias("bin")).agg(
        F.count_if(F.col(y) == 1).alias("positives"), F.count_if(F.col(y) != 1).alias("negatives"))
    hulls = cut_lineage(cells.groupBy("group").applyInPandas(
        _hull, "group string, f double, t double, high double, low double, weight_low double"))
    reach = hulls.groupBy("f").agg(F.min("t").alias("t"))
    best = reach.agg(F.max_by(F.struct("f", "t"), F.struct(F.col("t") - F.col("f"), -F.col("f")))).scalar()
    hull_weight = F.coalesce(F.try_divide(best.getField("t") - F.col("f"), F.col("t") - F.col("f")), F.lit(1.0))
    return hulls.where(F.col("f") == best.getField("f")).select(
        "group", "high", "low", "weight_low", F.least(F.greatest(hull_weight, F.lit(0.0)), F.lit(1.0)).alias("weight_hull"), F.col("f").alias("coin"),
        best.getField("t").alias("tpr"), F.col("f").alias("fpr"))


def equalised_predictions(df: DataFrame, thresholds: DataFrame, attr: str, key: str, prob: str = "y_prob", seed: int = 42) -> DataFrame:
    """``df`` with ``y_fair``, by draws from the keyed hash; groups without thresholds keep NULL."""
    t = thresholds.select(F.col("group").alias("_g"), "high", "low", "weight_low", "weight_hull", "coin")
    j = df.join(t, F.col(attr).cast("string").eqNullSafe(F.col("_g")), "left")
    draw = lambda salt: md5_uniform(key, seed + salt)
    score = F.floor(F.least(F.greatest(F.coalesce(F.col(prob), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * SCORE_BINS) / SCORE_BINS
    by_hull = score >= F.when(draw(1) < F.col("weight_low"), F.col("low")).otherwise(F.col("high"))
    fair = F.when(draw(2) < F.col("weight_hull"), by_hull).otherwise(draw(3) < F.col("coin"))
    return j.withColumn("y_fair", fair.cast("int")).drop("_g", "high", "low", "weight_low", "weight_hull", "coin")
