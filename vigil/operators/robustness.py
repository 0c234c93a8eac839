"""Robustness audit (m01-m07).

Every check scores the original and the modified rows in the same
projection (a model is a Column expression or any ``transform``), so the
comparison needs no join.  Noise and samples come from keyed hashes, hence
they are reproducible on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.exprs import box_muller, md5_uniform, safe_div
from vigil.functions.ranks import BROADCAST_ROWS, ordered_previous
from vigil.session import cut_lineage


def _status(ok) -> F.Column:
    return F.when(ok, F.lit("PASSED")).otherwise(F.lit("FAILED"))


def _score_pair(df: DataFrame, model, original: dict, modified: dict) -> DataFrame:
    """Score each row as is (pred_o / prob_o) and with the modified feature values (pred_m / prob_m)."""
    a = model.transform(df.withColumns(original))
    a = a.withColumnRenamed("prediction", "pred_o").withColumnRenamed("probability", "prob_o")
    b = model.transform(a.withColumns(modified))
    return b.withColumnRenamed("prediction", "pred_m").withColumnRenamed("probability", "prob_m")


def perturbation_test(df: DataFrame, model, numeric: list[str], key: str, epsilon: float = 0.1,
                      seed: int = 42) -> DataFrame:
    """m01: add N(0, (epsilon * std)^2) noise to every numeric feature (sample std over the
    tested rows); change rate of predictions < 0.1 passes; mean |delta probability|."""
    sd = df.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in numeric])).scalar()
    noise = {c: F.col(c).cast("double") + F.lit(float(epsilon)) * sd.getField(c) * box_muller(
        md5_uniform(F.concat(F.col(key).cast("string"), F.lit(f"|{c}|a")), seed),
        md5_uniform(F.concat(F.col(key).cast("string"), F.lit(f"|{c}|b")), seed)) for c in numeric}
    orig = {c: F.col(c).cast("double") for c in numeric}
    pair = _score_pair(df, model, orig, noise)
    rate = F.avg((F.col("pred_o") != F.col("pred_m")).cast("double"))
    return pair.agg(F.lit("adversarial_perturbation").alias("test"), F.lit(float(epsilon)).alias("epsilon"),
                    F.count("*").alias("n_samples"), rate.alias("prediction_change_rate"),
                    F.avg(F.abs(F.col("prob_o") - F.col("prob_m"))).alias("probability_change_mean"),
                    _status(rate < 0.1).alias("status"))


def invariance_test(df: DataFrame, model, numeric: list[str], categorical: list[str],
                    limit: float = 0.05) -> DataFrame:
    """m02: per feature, numeric + 1 std or categorical rotated to the next value (values in
    sorted order, wrapping); change rate < 0.05 passes.  A row is scored as it is and once per
    modified feature, side by side, and one aggregate compares them."""
    sd = df.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in numeric] or [F.lit(0).alias("_")])).scalar()
    feats = numeric + categorical
    x = df.withColumns({**{c: F.col(c).cast("double") for c in numeric}, **{c: F.col(c).cast("string") for c in categorical}})
    changed = {c: F.col(c) + sd.getField(c) for c in numeric}
    if categorical:
        # next distinct value in sorted order = previous one in descending order (range slices,
        # no single-task window); the largest wraps to the smallest (one scalar per column)
        vals = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_feature"), F.col(c).cast("string").alias("v"))
                                              for c in categorical])).alias("_x"))
                .select("_x.*").where(F.col("v").isNotNull()).distinct())
        nxt = ordered_previous(vals, ["_feature"], [F.col("v").desc()], ["v"])
        lo = vals.groupBy("_feature").agg(F.min("v").alias("_lo"))  # one row per column
        rot = cut_lineage(nxt.join(F.broadcast(lo), "_feature").select("_feature", "v", F.coalesce("prev_v", "_lo").alias("nv")))
        levels = F.broadcast if rot.count() <= BROADCAST_ROWS else (lambda d: d)
        for c in categorical:
            own = rot.where(F.col("_feature") == c).select(F.col("v").alias(f"_v_{c}"), F.col("nv").alias(f"_nv_{c}"))
            x = x.join(levels(own), F.col(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
            changed[c] = F.col(f"_nv_{c}")
    x = model.transform(x).withColumnRenamed("prediction", "_p").drop("probability")
    for i, c in enumerate(feats):
        x = model.transform(x.withColumns({"_own": F.col(c), c: changed[c]})).withColumnRenamed("prediction", f"_p{i}") \
            .drop("probability").withColumn(c, F.col("_own")).drop("_own")
    rates = [F.avg((F.col("_p") != F.col(f"_p{i}")).cast("double")).alias(f"_r{i}") for i in range(len(feats))]
    rows = [F.struct(F.lit(c).alias("feature"), F.col("n_samples"), F.col(f"_r{i}").alias("prediction_change_rate"),
                     _status(F.col(f"_r{i}") < limit).alias("status")) for i, c in enumerate(feats)]
    return x.agg(F.count("*").alias("n_samples"), *rates).where("n_samples > 0").select(F.inline(F.array(*rows)))


def edge_cases(df: DataFrame, model, numeric: list[str], categorical: list[str]) -> DataFrame:
    """m03: synthetic rows at all-min, all-max, zero (where 0 is in range) and mean + 3 std;
    the other columns at the numeric median / categorical mode.  A non-NULL prediction passes."""
    from vigil.operators.profile import long_numeric, long_string, quartiles
    q = quartiles(long_numeric(df, numeric), (0.5,), max_groups=len(numeric))
    med = q.agg(*[F.max(F.when(F.col("feature") == c, F.col("p50"))).alias(c) for c in numeric]) \
        .select(F.struct(*numeric)).scalar()
    st = df.agg(F.struct(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
                                    F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd")).alias(c)
                           for c in numeric])).scalar()
    modes = {}
    if categorical:
        vc = long_string(df, categorical).where(F.col("value").isNotNull()).groupBy("feature", "value").count()
        mo = vc.groupBy("feature").agg(F.min_by("value", F.struct((-F.col("count")).alias("c"),
                                                                  F.col("value").alias("v"))).alias("mode"))
        mrow = mo.agg(*[F.max(F.when(F.col("feature") == c, F.col("mode"))).alias(c) for c in categorical]) \
            .select(F.struct(*categorical)).scalar()
        modes = {c: mrow.getField(c) for c in categorical}
    cases = {
        "all_min_values": {c: st.getField(c).getField("lo") for c in numeric},
        "all_max_values": {c: st.getField(c).getField("hi") for c in numeric},
        "zero_values": {c: F.when((st.getField(c).getField("lo") <= 0) & (st.getField(c).getField("hi") >= 0),
                                  F.lit(0.0)).otherwise(med.getField(c)) for c in numeric},
        "extreme_values": {c: st.getField(c).getField("mu") + 3 * st.getField(c).getField("sd") for c in numeric},
    }
    spark = df.sparkSession
    rows = None
    for name, vals in cases.items():
        r = spark.range(1).select(F.lit(name).alias("case"), *[v.cast("double").alias(c) for c, v in vals.items()],
                                  *[v.alias(c) for c, v in modes.items()])
        rows = r if rows is None else rows.unionByName(r)
    scored = model.transform(rows)
    return scored.select("case", "prediction", "probability",
                         _status(F.col("prediction").isNotNull()).alias("status"))


def stability_test(df: DataFrame, model, key: str, n_trials: int = 10, sample_size: int = 100,
                   limit: float = 0.1) -> DataFrame:
    """m04: n trials of ``sample_size`` rows (keyed-hash samples, trial = salt); positive rate per
    trial, keeping only trials where both classes are predicted; CV = population std / mean.
    Samples are the feature of this test (top-n per trial, no global sort)."""
    scored = model.transform(df)
    trials = scored.select("prediction", key, F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))).alias("trial"))
    u = md5_uniform(F.concat(F.col(key).cast("string"), F.lit("#"), F.col("trial").cast("string")))
    w = Window.partitionBy("trial").orderBy(u, F.col(key))
    samp = trials.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample_size)
    per = samp.groupBy("trial").agg(F.avg((F.col("prediction") == 1).cast("double")).alias("positive_rate"),
                                    F.count_distinct("prediction").alias("_k"))
    per = per.where(F.col("_k") == 2)
    cv = safe_div(F.stddev_pop("positive_rate"), F.avg("positive_rate"))
    return per.agg(F.lit("prediction_stability").alias("test"), F.count("*").alias("n_trials_used"),
                   F.avg("positive_rate").alias("mean_positive_rate"),
                   F.stddev_pop("positive_rate").alias("std_positive_rate"), cv.alias("cv"),
                   _status(F.coalesce(cv < limit, F.lit(False))).alias("status"))


def range_check(train: DataFrame, test: DataFrame, numeric: list[str]) -> DataFrame:
    """m05: test values below the training min / above the training max per feature;
    out % < 5 PASSED, < 10 WARNING, else FAILED."""
    st = train.agg(F.struct(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
                              .alias(c) for c in numeric])).scalar()
    aggs = [F.count("*").alias("_n")]
    for c in numeric:
        v = F.col(c).cast("double")
        aggs += [F.count_if(v < st.getField(c).getField("lo")).alias(f"b_{c}"),
                 F.count_if(v > st.getField(c).getField("hi")).alias(f"a_{c}")]
    a = test.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), st.getField(c).getField("lo").alias("train_min"),
                              st.getField(c).getField("hi").alias("train_max"), F.col(f"b_{c}").alias("n_below"),
                              F.col(f"a_{c}").alias("n_above")) for c in numeric])
    x = a.select("_n", F.inline(rows))
    pct = (F.col("n_below") + F.col("n_above")) / F.col("_n") * 100
    return x.select("feature", "train_min", "train_max", "n_below", "n_above", pct.alias("out_of_range_pct"),
                    F.when(pct < 5, "PASSED").when(pct < 10, "WARNING").otherwise("FAILED").alias("status"))


def run_all(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """m06: every check's status rows unioned, counted per status, with the overall status."""
    u = None
    for name, df in results:
        r = df.select(F.lit(name).alias("test"), "status")
        u = r if u is None else u.unionByName(r)
    counts = u.groupBy("status").agg(F.count("*").alias("n"))
    overall = u.agg(F.when(F.count_if(F.col("status") == "FAILED") > 0, "FAILED")
                    .when(F.count_if(F.col("status") == "WARNING") > 0, "WARNING").otherwise("PASSED")).scalar()
    return counts.withColumn("overall_status", overall)


def high_volume(df: DataFrame, model, copies: int = 100) -> DataFrame:
    """m07: every row replicated ``copies`` times and scored; each replica must return one
    non-NULL prediction."""
    rep = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy"))
    s = model.transform(rep)
    n = df.agg(F.count("*")).scalar()
    return s.agg(F.count("*").alias("n_scored"), F.count("prediction").alias("n_predictions")).select(
        "n_scored", "n_predictions", (n * copies).alias("n_expected"),
        _status((F.col("n_scored") == n * copies) & (F.col("n_predictions") == F.col("n_scored"))).alias("status"))
