"""Forms for many columns or many rows against the small forms."""

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import profile as P
from vigil.operators import stats as S


def test_blocked_correlations_are_the_pairwise_ones(spark):
    n = 30
    cols = [f"c{i}" for i in range(n)]
    base = spark.range(500).select("id", *[
        F.when(F.xxhash64("id", F.lit(i)) % 9 > 0, (F.xxhash64("id", F.lit(i % 7)) % 1000) / 7.0 + (F.xxhash64("id", F.lit(100 + i)) % 300) + 1e6 * (i == 3)).alias(c)
        for i, c in enumerate(cols)]).withColumns({"c5": F.lit(2.5), "c6": F.lit(None).cast("double")}).repartition(5)
    want = {}
    for lo in range(0, n, 15):
        for hi in range(0, n, 15):
            part = sorted({*cols[lo:lo + 12], *cols[hi:hi + 12]})
            if len(part) <= P.FEW_COLUMNS:
                want.update({(r["feature_a"], r["feature_b"]): r["r"] for r in P.correlation_matrix(base, part).collect()})
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in P.correlation_matrix(base, cols).collect()}
    assert len(got) == n * n and len(want) > 500
    for k, r in want.items():
        bad = r is None or np.isnan(r)
        assert (got[k] is None) == bad and (bad or abs(got[k] - r) < 1e-9), (k, r, got[k])


def test_five_hundred_columns(spark):
    cols = [f"c{i}" for i in range(500)]
    df = spark.range(60).select(*[((F.col("id") * (i % 13 + 1)) % 17).cast("double").alias(c) for i, c in enumerate(cols)])
    out = P.correlation_matrix(df, cols)
    assert out.count() == 250_000
    assert out.where("feature_a = 'c0' AND feature_b = 'c13'").first()["r"] > 1 - 1e-9


def test_cell_bootstrap_has_the_distribution_of_the_row_bootstrap(spark):
    """Replicate differences of cells drawn as Poisson(n), small and large, against weights drawn row by row."""
    r = np.random.default_rng(1)
    for scale in (1, 40):
        counts = {(1, 1, 1): 60, (1, 0, 1): 14, (1, 1, 0): 9, (0, 1, 1): 50, (0, 0, 0): 7}
        cells = [(y, y if h1 else 1 - y, y if h2 else 1 - y, n * scale) for (y, h1, h2), n in counts.items()]
        df = spark.createDataFrame(cells, "y int, a int, b int, n int").select("y", "a", "b", F.explode(F.sequence(F.lit(1), F.col("n"))))
        got = S.bootstrap_difference(df, "y", "a", "b", 2000).first()
        rows = [(h1, h2) for (y, h1, h2), n in counts.items() for _ in range(n * scale)]
        h = np.array(rows)
        w = r.poisson(1, (2000, len(h)))
        d = (w @ h[:, 1] - w @ h[:, 0]) / w.sum(axis=1)
        spread = d.std()
        assert abs(got["mean_difference"] - d.mean()) < 0.15 * spread
        assert abs(got["ci_lower"] - np.quantile(d, 0.025)) < 0.25 * spread and abs(got["ci_upper"] - np.quantile(d, 0.975)) < 0.25 * spread
        assert got["n_replicates"] == 2000


def test_poisson_of_cells(spark):
    for n in (3, 200, 300, 5000):
        draws = spark.range(4000).select(F.lit(n).alias("n"), F.concat(F.lit("x"), "id").alias("name"),
                                         F.explode(F.sequence(F.lit(1), F.lit(n if n <= S.EXACT_ROWS else 1))).alias("i"))
        w = draws.groupBy("name").agg(F.sum(S.poisson_of_cell(F.col("n"), F.col("name"), F.col("i"), 5)).alias("w"))
        row = w.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.skewness("w").alias("s")).first()
        assert abs(row["m"] - n) < 5 * (n / 4000) ** 0.5 and abs(row["v"] / n - 1) < 0.12 and abs(row["s"] - n ** -0.5) < 0.2
