"""Binned training data: features cut at quantiles, equal rows counted as one cell.

Tree growers only compare a feature with cut points, so rows in the same bins
are alike; the counted cells are all they need.  With few features there are
few cells, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def cut_points(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most ``bins`` - 1 rising cut points per feature, quantiles of its values; none where all values are NULL."""
    share = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), share, ACCURACY).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(features))]


def bin_of(feature: str | Column, cuts: list[float]) -> Column:
    """Number of cut points below the value (so a split at cut k keeps values up to it on the left); -1 for NULL."""
    x = (F.col(feature) if isinstance(feature, str) else feature).cast("double")
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: x > c)) if cuts else F.lit(0)
    return F.when(x.isNull(), -1).otherwise(below).cast("int")


def cells(df: DataFrame, features: list[str], cuts: list[list[float]], keys: list[str]) -> DataFrame:
    """(b0, b1, ..., *keys, n): how many rows are in each combination of bins and keys."""
    own = df.select(*[bin_of(f, c).alias(f"b{i}") for i, (f, c) in enumerate(zip(features, cuts))], *keys)
    return own.groupBy(*[f"b{i}" for i in range(len(features))], *keys).agg(F.count("*").alias("n"))
