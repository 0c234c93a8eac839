"""Operators against the same statistic from Spark ML, and the raising form of the fairness gate."""

import pytest
from pyspark.sql import functions as F

from vigil.functions import ranks
from vigil.operators import evaluation as V
from vigil.operators import fairness as L
from vigil.operators import stats as S
from vigil.sources import fixtures as fx


def test_auc_matches_spark_ml(spark, tables):
    scored = fx.scored(tables)
    assert abs(V.auc(scored).first()[0] - V.auc_mllib(scored)) < 1e-9


@pytest.mark.parametrize("name", ["rmse", "mae", "r2"])
def test_regression_matches_spark_ml(spark, name):
    df = spark.range(200).select((F.col("id") * 1.5).alias("y"), (F.col("id") * 1.4 + F.col("id") % 7).alias("yhat"))
    assert abs(V.regression_metrics(df, "y", "yhat").first()[name] - V.regression_metrics_mllib(df, "y", "yhat", name)) < 1e-9


def test_normality_matches_spark_ml(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 1000 / 500.0 - 1).alias("x"))
    ours = S.ks_normality(df, ["x"], 0.1, 0.6).first()["statistic"]
    assert abs(ours - S.ks_normality_mllib(df, "x", 0.1, 0.6).first()["statistic"]) < 1e-6


def test_compliance_gate_raises(spark):
    row = "attribute string, metric string, value double, passes boolean"
    bad = spark.createDataFrame([("a", "demographic_parity", 0.5, False)], row)
    good = spark.createDataFrame([("a", "demographic_parity", 0.01, True)], row)
    with pytest.raises(AssertionError):
        L.assert_compliance(bad)
    assert L.assert_compliance(good).count() == 0


def test_bucket_tagging_is_a_binary_search(spark):
    """Any number of buckets gives the cuts that counting the bounds gives."""
    cells = spark.range(5000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 5000).cast("double").alias("v"), F.lit(1).alias("n"))
    for b in (2, 3, 16, 300):
        tagged, _ = ranks._bucket_cells(cells, ["g"], "v", b)
        n = {r["_bk"]: r["count"] for r in tagged.groupBy("_bk").count().collect()}
        assert set(n) == set(range(b)) and max(n.values()) <= 2 * 5000 / b + 2
        lows = [r[0] for r in tagged.groupBy("_bk").agg(F.min("v")).orderBy("_bk").select("min(v)").collect()]
        assert lows == sorted(lows)
