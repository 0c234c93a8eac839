"""Statistical tests (g01-g07).

All tests are aggregates over a long (feature, value, group) table.  Rank
statistics come from ``functions.ranks.cumulative`` (no single-task window);
p-values are closed-form column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.exprs import box_muller, chi2_sf, md5_uniform, norm_cdf, poisson1_weight, safe_div
from vigil.functions.ranks import cumulative, value_cells
from vigil.operators.profile import long_numeric, long_string


def kolmogorov_pvalue(d, m, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov p-value for statistic d with effective size m."""
    sm = F.sqrt(F.col(m) if isinstance(m, str) else m)
    lam = (sm + F.lit(0.12) + F.lit(0.11) / sm) * (F.col(d) if isinstance(d, str) else d)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def ks_normality(df: DataFrame, cols: list[str], mu: float = 0.0, sigma: float = 1.0,
                 buckets: int | None = None) -> DataFrame:
    """g01: one-sample KS against N(mu, sigma) -- the reference tests against N(0, 1)
    without standardising, and so do we.  D+ / D- from cumulative counts per value."""
    long = long_numeric(df, cols).where(F.col("value").isNotNull())
    cells = value_cells(long, ["feature"], "value")
    cum = cumulative(cells, ["feature"], "value", ["n"], buckets, max_groups=len(cols))
    tot = cells.groupBy("feature").agg(F.sum("n").alias("_tot"))
    j = cum.join(F.broadcast(tot), "feature")  # one row per feature
    cdf = norm_cdf((F.col("value") - mu) / sigma)
    d = F.greatest(F.col("cum_n") / F.col("_tot") - cdf, cdf - (F.col("cum_n") - F.col("n")) / F.col("_tot"))
    agg = j.groupBy("feature").agg(F.first("_tot").alias("n"), F.max(d).alias("statistic"))
    return agg.select("feature", "n", "statistic",
                      kolmogorov_pvalue("statistic", F.col("n").cast("double")).alias("p_value"))


def ks_normality_mllib(df: DataFrame, col: str, mu: float = 0.0, sigma: float = 1.0) -> DataFrame:
    """g01 through MLlib's KolmogorovSmirnovTest (exact normal CDF)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    return KolmogorovSmirnovTest.test(df.select(F.col(col).cast("double").alias(col)).dropna(), col,
                                      "norm", float(mu), float(sigma))


def jarque_bera(df: DataFrame, cols: list[str]) -> DataFrame:
    """g02 (re-aimed small-n normality): JB = n/6 (S^2 + K^2/4), S and K population
    skewness / excess kurtosis, p = exp(-JB/2) (chi-square, 2 dof)."""
    long = long_numeric(df, cols).where(F.col("value").isNotNull())
    a = long.groupBy("feature").agg(F.count("*").alias("n"), F.skewness("value").alias("skew"),
                                    F.kurtosis("value").alias("kurt"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)
    return a.select("feature", "n", "skew", "kurt", jb.alias("jb"), F.exp(-jb / 2).alias("p_value"),
                    (F.exp(-jb / 2) >= 0.05).alias("normal"))


def mann_whitney(df: DataFrame, cols: list[str], group: str, g1, g2,
                 buckets: int | None = None) -> DataFrame:
    """g03: two-sided Mann-Whitney U per feature (tie-corrected normal approximation with
    continuity correction); U is for the first group, as SciPy reports it."""
    long = (long_numeric(df.where(F.col(group).isin(g1, g2)), cols, [group])
            .where(F.col("value").isNotNull())
            .withColumn("_g", F.when(F.col(group) == g1, F.lit("a")).otherwise(F.lit("b"))))
    cells = value_cells(long, ["feature"], "value", "_g", ("a",))
    cum = cumulative(cells, ["feature"], "value", ["n"], buckets, max_groups=len(cols))
    rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    agg = cum.groupBy("feature").agg(
        F.sum(F.col("n_a") * rank).alias("r1"), F.sum("n_a").alias("n1"),
        (F.sum("n") - F.sum("n_a")).alias("n2"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
        # group means from the same cells (value x count per group): no second pass over the rows
        F.try_divide(F.sum(F.col("value") * F.col("n_a")), F.sum("n_a")).alias("mean_group_0"),
        F.try_divide(F.sum(F.col("value") * (F.col("n") - F.col("n_a"))), F.sum(F.col("n") - F.col("n_a")))
        .alias("mean_group_1"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    N = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    sigma = F.sqrt(n1 * n2 / 12.0 * ((N + 1) - F.col("ties") / (N * (N - 1))))
    z = (F.greatest(u1, u2) - n1 * n2 / 2 - 0.5) / sigma
    p = F.least(F.lit(1.0), 2 * (1 - norm_cdf(z)))
    return agg.select(
        "feature", u1.alias("statistic"), F.when(sigma > 0, p).otherwise(F.lit(1.0)).alias("p_value"),
        (F.when(sigma > 0, p).otherwise(F.lit(1.0)) < 0.05).alias("significant"),
        "mean_group_0", "mean_group_1", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))


def chi_square(df: DataFrame, cols: list[str], target: str, max_levels: int = 50,
               yates: bool = True) -> DataFrame:
    """g04: chi-square test of independence, feature level x target class, per categorical
    column with fewer than ``max_levels`` levels.  Yates correction at dof = 1 (as SciPy)."""
    long = long_string(df, cols, [target]).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    obs = long.groupBy("feature", "value", target).agg(F.count("*").alias("o"))
    levels = obs.groupBy("feature", "value").agg(F.sum("o").alias("row"))
    classes = obs.groupBy("feature", target).agg(F.sum("o").alias("col"))
    dims = levels.groupBy("feature").agg(F.count("*").alias("r"), F.sum("row").alias("N")).join(
        classes.groupBy("feature").agg(F.count("*").alias("c")), "feature").where(F.col("r") < max_levels)
    # full grid: levels x classes of each kept feature (< max_levels x classes rows per feature);
    # high-cardinality features are dropped before the grid is formed.
    kept = levels.join(dims, "feature")
    grid = kept.join(classes, "feature")
    cells = grid.join(obs, ["feature", "value", target], "left").fillna(0, ["o"])
    e = F.col("row") * F.col("col") / F.col("N")
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    diff = F.abs(F.col("o") - e)
    if yates:
        diff = F.when(dof == 1, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
    stat = cells.groupBy("feature", "r", "c").agg(F.sum(diff * diff / e).alias("chi2"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    return stat.select("feature", "chi2", dof.cast("long").alias("dof"),
                       chi2_sf("chi2", dof).alias("p_value"), (chi2_sf("chi2", dof) < 0.05).alias("significant"))


def chi_square_mllib(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """g04 p-values through MLlib (no Yates correction): indexed features -> ChiSquareTest."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    idx = StringIndexer(inputCols=features, outputCols=[f"{c}_ix" for c in features], handleInvalid="keep")
    x = idx.fit(df).transform(df)
    x = VectorAssembler(inputCols=[f"{c}_ix" for c in features], outputCol="_v").transform(x)
    return ChiSquareTest.test(x.select("_v", F.col(label).cast("double").alias(label)), "_v", label, flatten=True)


#: Cells without a key: up to so many rows draw one Poisson(1) per row, larger ones a single Poisson of the cell.
EXACT_ROWS = 256


def poisson_of_cell(n: Column, name: Column, i: Column, seed: int) -> Column:
    """Draw ``i`` of a cell of ``n`` rows: summed over i = 1 .. n (n <= EXACT_ROWS) or taken once, a Poisson(n) weight.

    Exact for small cells, as a sum of n Poisson(1).  Beyond, a normal draw z gives n + sqrt(n) z + (z^2 - 1) / 6,
    rounded: mean and variance are n to within 1 / 12, and the distribution function is off by less than 1 / n.
    """
    uniform = lambda tag: md5_uniform(F.concat(name, F.lit("#"), tag), seed)
    z = box_muller(uniform(F.lit("u")), uniform(F.lit("v")))
    large = F.greatest(F.lit(0.0), F.round(n + F.sqrt(n) * z + (z * z - 1) / 6))
    return F.when(n <= EXACT_ROWS, poisson1_weight(uniform(i.cast("string")))).otherwise(large)


def bootstrap_difference(scored: DataFrame, y: str, p1: str, p2: str, n_boot: int = 200, seed: int = 42,
                         metric: str = "accuracy", key: str | None = None) -> DataFrame:
    """g05: Poisson bootstrap of metric(p2) - metric(p1) (accuracy or recall).

    With ``key`` every row gets an independent Poisson(1) weight per replicate from the hash of its key; the replicate
    explode is pipelined straight into a partial aggregate to (replicate, y, hit1, hit2) cells, so nothing of size
    rows x B is materialised.  Rows that share a key share their weights.  Without a key rows cannot be told apart:
    a cell of n rows with the same (y, hit1, hit2) draws its weight as a whole (``poisson_of_cell``).
    Two-tailed p = 2 min(P(d <= 0), P(d >= 0)); 95 % CI from replicate percentiles.
    """
    hit1 = (F.col(p1) == F.col(y)).cast("int")
    hit2 = (F.col(p2) == F.col(y)).cast("int")
    own = [F.col(y).alias("_y"), hit1.alias("_h1"), hit2.alias("_h2")]
    b = F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b")
    if key is None:
        reps = scored.groupBy(*own).agg(F.count("*").alias("n")).select("*", b)
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        name = F.concat_ws("#", text("_y"), text("_h1"), text("_h2"), F.col("b").cast("string"))
        draws = reps.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("n") <= EXACT_ROWS, F.col("n")).otherwise(1))).alias("i"))
        w = poisson_of_cell(F.col("n"), name, F.col("i"), seed)
    else:
        draws = scored.select(F.col(key).cast("string").alias("_k"), *own).select("*", b)
        w = poisson1_weight(md5_uniform(F.concat(F.col("_k"), F.lit("#"), F.col("b").cast("string")), seed))
    cells = draws.groupBy("b", "_y", "_h1", "_h2").agg(F.sum(w).alias("w"))
    if metric == "recall":
        num1 = F.sum(F.when(F.col("_y") == 1, F.col("w") * F.col("_h1")))
        num2 = F.sum(F.when(F.col("_y") == 1, F.col("w") * F.col("_h2")))
        den = F.sum(F.when(F.col("_y") == 1, F.col("w")))
    else:
        num1, num2, den = F.sum(F.col("w") * F.col("_h1")), F.sum(F.col("w") * F.col("_h2")), F.sum("w")
    per = cells.groupBy("b").agg(safe_div(num2, den).alias("m2"), safe_div(num1, den).alias("m1"))
    per = per.select("b", (F.col("m2") - F.col("m1")).alias("d"))
    return per.agg(
        F.avg("d").alias("mean_difference"),
        F.percentile("d", 0.025).alias("ci_lower"), F.percentile("d", 0.975).alias("ci_upper"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")),
                                        F.avg((F.col("d") >= 0).cast("double")))).alias("p_value"),
        F.count("*").alias("n_replicates"))


def bonferroni(tests: DataFrame, p: str = "p_value", family_cols: list[str] | None = None) -> DataFrame:
    """g06: p_adj = min(1, p * m), m = tests in the family (count over a tiny test table)."""
    m = tests.agg(F.count("*")).scalar() if not family_cols else None
    if family_cols:
        from pyspark.sql import Window
        m = F.count("*").over(Window.partitionBy(*family_cols))
    return tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * m)) \
        .withColumn("significant_adjusted", F.col("p_adjusted") < 0.05)


def improvement(metrics: DataFrame, value: str, baseline: float, target: float) -> DataFrame:
    """g07: improvement vs baseline, absolute and %, and whether the target is reached."""
    return metrics.select("*", (F.col(value) - baseline).alias("improvement"),
                          ((F.col(value) - baseline) / baseline * 100).alias("improvement_pct"),
                          (F.col(value) >= target).alias("target_reached"))

