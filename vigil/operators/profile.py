"""Profiling and EDA tables (f01-f15).

The reference loops over columns (one scan per column).  Here every report
is one pass: columns are unpivoted to a long (feature, value) table and
aggregated with ``groupBy(feature)`` (partial + final hash aggregate), or
all pairs are computed in one wide ``agg``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.ranks import cumulative, exact_quantiles, value_cells


def long_numeric(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids..., feature, value double) -- one row per row and numeric column."""
    ids = ids or []
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(ids, cols, "feature", "value")


def long_string(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    ids = ids or []
    wide = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return wide.unpivot(ids, cols, "feature", "value")


def quartiles(long: DataFrame, probs=(0.25, 0.5, 0.75), method: str = "exact",
              max_groups: int | None = None) -> DataFrame:
    """(feature, p25, p50, p75) -- exact by distributed ranks, or ``approx``."""
    names = [f"p{int(round(q * 100))}" for q in probs]
    if method == "approx":
        agg = long.groupBy("feature").agg(F.percentile_approx("value", list(probs), 100000).alias("_q"))
        return agg.select("feature", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    q = exact_quantiles(long, ["feature"], "value", list(probs), max_groups=max_groups)
    return q.groupBy("feature").pivot("q", [float(x) for x in probs]).agg(F.first("value_q")) \
        .toDF("feature", *names)


def describe_numeric(df: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """f01: count, mean, std, min, 25/50/75 %, max per numeric column."""
    long = long_numeric(df, cols)
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(quartiles(long, method=method, max_groups=len(cols)), "feature", "left").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """f02: count, unique, top (most frequent; ties by smallest value), freq."""
    vc = long_string(df, cols).where(F.col("value").isNotNull()).groupBy("feature", "value").count()
    return vc.groupBy("feature").agg(
        F.sum("count").cast("long").alias("count"), F.count("*").alias("unique"),
        F.min_by("value", F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))).alias("top"),
        F.max("count").alias("freq"))


def target_distribution(df: DataFrame, target: str = "target", limit: float = 3.0) -> DataFrame:
    """f03: class counts and %, imbalance ratio max/min, flag above ``limit``."""
    vc = df.where(F.col(target).isNotNull()).groupBy(target).count()
    s = vc.agg(F.sum("count").alias("n"), (F.max("count") / F.min("count")).alias("r"))
    n, ratio = s.select("n").scalar(), s.select("r").scalar()
    return vc.select(F.col(target).alias("class"), F.col("count"),
                     (F.col("count") / n * 100).alias("pct"),
                     ratio.alias("imbalance_ratio"), (ratio > limit).alias("imbalanced"))


def histogram(df: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """f04: equal-width bins per feature (last bin closed); zero width -> one bin."""
    long = long_numeric(df, cols).where(F.col("value").isNotNull())
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = (long.join(F.broadcast(rng), "feature")  # one row per feature
         .withColumn("bin", F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
             F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))))
    return b.groupBy("feature", "bin").agg(
        F.count("*").alias("count"),
        F.first(F.col("lo") + F.col("bin") * width).alias("edge_lo"),
        F.first(F.col("lo") + (F.col("bin") + 1) * width).alias("edge_hi"))


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """f05: values below Q1 - k IQR or above Q3 + k IQR; count and % of all rows."""
    long = long_numeric(df, cols)
    q = quartiles(long, (0.25, 0.75), method, max_groups=len(cols))
    lim = q.select("feature", (F.col("p25") - k * (F.col("p75") - F.col("p25"))).alias("lower"),
                   (F.col("p75") + k * (F.col("p75") - F.col("p25"))).alias("upper"))
    j = long.join(F.broadcast(lim), "feature")  # one row per feature
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return j.groupBy("feature", "lower", "upper").agg(
        F.count_if(out).alias("n_outliers"), (F.count_if(out) / F.count("*") * 100).alias("pct_outliers"))


def top_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """f06: top-k values per column (count desc, value asc) with % of all rows."""
    n = df.agg(F.count("*")).scalar()
    vc = long_string(df, cols).where(F.col("value").isNotNull()).groupBy("feature", "value").count()
    w = Window.partitionBy("feature").orderBy(F.col("count").desc(), F.col("value"))
    return (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("pct", F.col("count") / n * 100))


def cardinality(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                limits=(10, 20, 50)) -> DataFrame:
    """f07: distinct count per column (exact, or HLL++), with the reference's keep-limits."""
    cols = cols or df.columns
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    wide = df.agg(*[fn(F.col(c)).cast("long").alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "n_unique")
    return long.select("feature", "n_unique",
                       (F.col("n_unique") <= limits[0]).alias("le_10"),
                       (F.col("n_unique") <= limits[1]).alias("le_20"),
                       (F.col("n_unique") < limits[2]).alias("lt_50"))


def temporal_coverage(df: DataFrame, ts: str) -> DataFrame:
    """f08: min, max, range in days, number of days with records, mean records per day."""
    daily = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).count()
    return daily.agg(F.min("day").alias("min_day"), F.max("day").alias("max_day"),
                     F.datediff(F.max("day"), F.min("day")).alias("range_days"),
                     F.count("*").alias("n_days"), F.sum("count").alias("n_records"),
                     F.avg("count").alias("mean_per_day"))


def pair_correlation(a: str, b: str) -> Column:
    """Pearson r over the rows that have both; NULL where a side does not vary (``corr`` fails there)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


#: Columns up to which every pair is an expression of one aggregate; more are summed in blocks.
FEW_COLUMNS = 24


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """f09: Pearson r for every ordered pair (pairwise-complete), one pass; NULL where a side does not vary."""
    if len(cols) > FEW_COLUMNS:
        return _blocked_correlations(df, cols)
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[pair_correlation(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), F.col(f"{i}").alias("r"))
             for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(c).alias("feature_a"), F.lit(c).alias("feature_b"), F.lit(1.0).alias("r"))
             for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def _blocked_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same for many columns: cross-product sums of centred values per partition, merged per column.

    A partition's batches add to six matrices of columns x columns (one matrix product each); a row per column with
    its sums leaves the partition, and rows of a column meet in one group of as many rows as there are partitions.
    """
    centre = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"{i}") for i, c in enumerate(cols)]).first()
    means = np.array([0.0 if m is None or not np.isfinite(m) else m for m in centre])
    n = len(cols)
    kinds = ("n", "x", "xx", "xy", "y", "yy")

    def sums(batches):
        total = np.zeros((6, n, n))
        for pdf in batches:
            x = pdf.to_numpy(float) - means
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            counts, first, square = m.T @ m, x.T @ m, (x * x).T @ m
            total += np.stack([counts, first, square, x.T @ x, first.T, square.T])
        yield pd.DataFrame({"i": np.arange(n), **{k: list(t) for k, t in zip(kinds, total)}})

    def merged(pdf):
        count, x, xx, xy, y, yy = (np.sum(np.stack(pdf[k].to_numpy()), axis=0) for k in kinds)
        with np.errstate(all="ignore"):
            cov, vx, vy = xy - x * y / count, xx - x * x / count, yy - y * y / count
            r = cov / np.sqrt(vx * vy)
        flat = (count < 1) | (vx <= 1e-12 * np.abs(xx)) | (vy <= 1e-12 * np.abs(yy))
        i = int(pdf["i"].iat[0])
        r = [None if f else float(v) for f, v in zip(flat, r)]
        r[i] = 1.0
        return pd.DataFrame({"feature_a": cols[i], "feature_b": cols, "r": pd.array(r, dtype="Float64")})

    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = wide.mapInPandas(sums, "i int, " + ", ".join(f"{k} array<double>" for k in kinds))
    return parts.groupBy("i").applyInPandas(lambda pdf: merged(pdf), "feature_a string, feature_b string, r double")


def strongest_pairs(corr: DataFrame, min_abs: float = 0.5, k: int = 10) -> DataFrame:
    """f10: |r| > min_abs, r != 1, each unordered pair once, sorted by r desc (top-k report)."""
    return (corr.where((F.col("feature_a") < F.col("feature_b")) & (F.col("r") != 1.0)
                       & (F.abs("r") > min_abs))
            .orderBy(F.col("r").desc(), "feature_a", "feature_b").limit(k))


def target_correlation(df: DataFrame, cols: list[str], target: str = "target") -> DataFrame:
    """f11: r(feature, target) ranked by |r| desc."""
    wide = df.agg(*[pair_correlation(c, target).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "r")
    w = Window.orderBy(F.abs("r").desc_nulls_last(), "feature")  # over one row per feature
    return long.withColumn("rank", F.row_number().over(w))


def group_means(df: DataFrame, cols: list[str], target: str = "target") -> DataFrame:
    """f12: mean of every numeric feature per target class."""
    return df.groupBy(target).agg(*[F.avg(c).alias(c) for c in cols])


def crosstab_pct(df: DataFrame, a: str, b: str) -> DataFrame:
    """f13: row-normalised crosstab in long form (a, b, count, pct of row)."""
    c = df.groupBy(a, b).count()
    # row totals joined back (no hint: broadcast when the row-value table is under the
    # threshold, else a shuffle join) -- not a window, which holds a row value's cells in one task
    tot = c.groupBy(a).agg(F.sum("count").alias("_row")).withColumnRenamed(a, "_a")
    j = c.join(tot, F.col(a).eqNullSafe(F.col("_a")))
    return j.select(a, b, "count", (F.col("count") / F.col("_row") * 100).alias("pct"))


def spearman(df: DataFrame, cols: list[str], row_id: str, buckets: int | None = None) -> DataFrame:
    """f15: Spearman rho = Pearson r of average ranks, ranks from distributed cumulative counts."""
    long = long_numeric(df, cols, [row_id]).where(F.col("value").isNotNull())
    cells = value_cells(long, ["feature"], "value")
    cum = cumulative(cells, ["feature"], "value", ["n"], buckets, max_groups=len(cols))
    ranks = cum.select("feature", "value", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    ranked = long.join(ranks, ["feature", "value"])
    wide = ranked.groupBy(row_id).pivot("feature", cols).agg(F.first("rank"))
    return correlation_matrix(wide, cols).withColumnRenamed("r", "rho")


def eda_summary(df: DataFrame, target: str = "target") -> DataFrame:
    """f14: rows, columns, completeness %, duplicate %, target distribution as text."""
    from vigil.operators.quality import quality_summary
    q = quality_summary(df)
    dist = (df.groupBy(target).count()
            .agg(F.concat_ws(",", F.array_sort(F.collect_list(
                F.concat(F.col(target).cast("string"), F.lit(":"), F.col("count").cast("string")))))
                 .alias("target_distribution")))  # one entry per class
    return q.withColumn("target_distribution", dist.scalar())
