"""Planted faults must be found exactly (the reference's planted-bias strategy)."""

from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from vigil.operators import fairness as L
from vigil.operators import monitor as K
from vigil.operators import quality as Q
from vigil.sources import fixtures as fx
from vigil.sources.tables import Tables


def test_planted_drift_flags_only_value(spark):
    t = Tables(spark, MEDIUM)
    ref, cur = fx.drift_frames(t, shift=1.5)
    res = {r["feature"]: r["drifted"] for r in K.column_drift(ref, cur, ["user_id", "value"], ["event_type"]).collect()}
    assert res == {"user_id": False, "value": True, "event_type": False}
    ref, cur = fx.drift_frames(t)
    res = {r["feature"]: r["drifted"] for r in K.column_drift(ref, cur, ["user_id", "value"], ["event_type"]).collect()}
    assert not any(res.values())


def test_planted_bias_detected(spark):
    t = Tables(spark, MEDIUM)
    fair = {r["group"]: r["tpr"] for r in L.group_rates(fx.scored(t), ["lang"]).collect()}
    bias = {r["group"]: r["tpr"] for r in L.group_rates(fx.scored_biased(t), ["lang"]).collect()}
    assert bias["fr"] < fair["fr"] and min(bias, key=bias.get) == "fr"
    spread = {r["metric"]: r["value"] for r in L.fairness_summary(fx.scored_biased(t), ["lang"]).collect()}
    assert spread["equal_opportunity"] > 0.1


def test_injected_nulls_counted_exactly(spark):
    t = Tables(spark, MEDIUM)
    fs = fx.feature_store_nulls(t)
    rep = {r["column"]: r["missing_count"] for r in Q.missing_report(fs).collect()}
    base = fx.feature_store(t)
    assert rep["f_total"] == base.where(F.col("id") % 7 == 0).count()
    assert rep["prediction_timestamp"] == base.where(F.col("id") % 3 == 0).count()


def test_injected_duplicates_counted_exactly(spark):
    t = Tables(spark, MEDIUM)
    o = t.orders.select("o_orderkey", "o_custkey")
    dup = o.unionByName(o.where(F.col("o_orderkey") < 25))
    r = Q.quality_summary(dup).first()
    assert abs(r["duplicate_pct"] - 25 * 100.0 / dup.count()) < 1e-9
