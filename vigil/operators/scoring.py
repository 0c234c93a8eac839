"""Batch scoring and prediction logs (j01-j05).

A *model* is anything with ``transform(df)`` that adds ``prediction`` and
``probability``: an MLlib ``PipelineModel``, an ``ExpressionModel`` (a
Column expression -- fully JVM-side and oracle-checkable), or a
``PandasModel`` wrapping any object with ``predict(pandas_df)`` through a
scalar pandas UDF over the feature columns (Arrow batches; only the features
cross to Python).
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from vigil.functions.exprs import sigmoid
from vigil.roles import Roles


@dataclass
class ExpressionModel:
    """prediction = probability >= threshold, probability = a Column expression."""
    probability: Column
    threshold: float = 0.5
    version: str = "expr-1"

    def transform(self, df: DataFrame) -> DataFrame:
        return (df.withColumn("probability", self.probability.cast("double"))
                .withColumn("prediction", (F.col("probability") >= self.threshold).cast("int")))


def logistic_model(weights: dict[str, float], intercept: float, threshold: float = 0.5,
                   version: str = "logit-1") -> ExpressionModel:
    z = F.lit(float(intercept))
    for c, w in weights.items():
        z = z + F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return ExpressionModel(sigmoid(z), threshold, version)


class PandasModel:
    """j03: any object with ``predict(pandas.DataFrame) -> array of probabilities``."""

    def __init__(self, obj, features: list[str], threshold: float = 0.5, version: str = "py-1"):
        self.obj, self.features, self.threshold, self.version = obj, features, threshold, version

    def transform(self, df: DataFrame) -> DataFrame:
        # a scalar pandas UDF over a struct of the feature columns: only the features cross to
        # Python (Arrow batches); every other column stays in the JVM
        obj, feats, th = self.obj, self.features, self.threshold

        @pandas_udf(DoubleType())
        def predict(x: pd.DataFrame) -> pd.Series:
            return pd.Series(obj.predict(x[feats]), index=x.index).astype("float64")

        return (df.withColumn("probability", predict(F.struct(*[F.col(c) for c in feats])))
                .withColumn("prediction", (F.col("probability") >= th).cast("int")))


class LinearScorer:
    """Tiny numpy model used to exercise the foreign-model path."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def predict(self, pdf):
        import numpy as np
        z = np.full(len(pdf), self.intercept, dtype="float64")
        for c, w in self.weights.items():
            z = z + w * pdf[c].fillna(0.0).astype("float64").to_numpy()
        return 1.0 / (1.0 + np.exp(-z))


def score_batch(df: DataFrame, model, version: str, scored_at, roles: Roles = Roles(),
                keep: list[str] | None = None) -> DataFrame:
    """j01: select features (never ids, dates, target or old scoring columns), predict, stamp."""
    feats = roles.features(df)
    keep = keep or [c for c in (*roles.keys, roles.time) if c and c in df.columns]
    out = model.transform(df.select(*keep, *feats))
    return out.withColumns({"prediction_timestamp": F.lit(scored_at).cast("timestamp_ntz"),
                            "model_version": F.lit(version)})


def write_predictions(scored: DataFrame, path: str, partition_by: list[str] | None = None,
                      mode: str = "append") -> str:
    """j01 / j02: partitioned append of the scored rows (clustered by partition value)."""
    w = scored
    if partition_by:
        w = w.hint("rebalance", *partition_by)   # adaptive execution splits a hot value
        w.write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        w.write.mode(mode).parquet(path)
    return path


def prediction_log_report(log: DataFrame, start=None, end=None, ts: str = "ts",
                          samples: str = "num_samples", version: str = "model_version") -> DataFrame:
    """j04: total predictions, requests and model versions seen in a period (durable log)."""
    from vigil.operators.relational import period_filter
    x = period_filter(log, ts, start, end) if (start or end) else log
    return x.agg(F.coalesce(F.sum(samples), F.lit(0)).cast("long").alias("total_predictions"),
                 F.count("*").alias("total_requests"),
                 F.count_distinct(version).alias("n_versions"),
                 F.concat_ws(",", F.array_sort(F.collect_set(version))).alias("model_versions"),  # few versions
                 F.min(ts).cast("string").alias("first_ts"), F.max(ts).cast("string").alias("last_ts"))


def volume_spikes(log: DataFrame, ts: str = "ts", factor: float = 2.0, trailing_days: int = 7) -> DataFrame:
    """j05: daily prediction volume vs the trailing mean of the previous days (> factor x)."""
    daily = log.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day").rowsBetween(-trailing_days, -1)  # over the daily table
    normal = F.avg("n").over(w)
    return daily.select("day", "n", normal.alias("trailing_mean"),
                        F.coalesce(F.col("n") > factor * normal, F.lit(False)).alias("spike"))
