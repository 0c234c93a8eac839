"""Catalog: statistical tests (g01-g07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import stats as S
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources.fixture_sql import chi2_sf, md5u, norm_cdf, poisson1, with_views

NUM = ["f_total", "f_items", "f_disc"]


def _union(template: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)


def _ks1_sql() -> str:
    cells = _union("SELECT '{c}' AS feature, {c}::DOUBLE AS value, count(*) AS cnt FROM events "
                   "WHERE {c} IS NOT NULL GROUP BY 2", ["value", "user_id"])
    cdf = norm_cdf("value")
    return f"""
SELECT feature, n::BIGINT AS n, d AS statistic,
       CASE WHEN (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 *
         list_sum(list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) *
           exp(-2.0 * k * k * ((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d) * ((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d)))))) END
         AS p_value
FROM (SELECT feature, max(tot) AS n, max(greatest(cum / tot - {cdf}, {cdf} - (cum - cnt) / tot)) AS d
      FROM (SELECT feature, value, cnt, sum(cnt) OVER (PARTITION BY feature ORDER BY value) AS cum,
                   sum(cnt) OVER (PARTITION BY feature) AS tot FROM ({cells}) c) w GROUP BY feature) a"""


@query("g01_ks_normality", doubles=("statistic", "p_value"), oracle=_ks1_sql())
def g01(t):
    """One-sample KS against N(0, 1), unstandardised as in the reference (n >= 5000 branch)."""
    return S.ks_normality(t.events, ["value", "user_id"])


@query("g02_jarque_bera", doubles=("skew", "kurt", "jb", "p_value"), oracle=with_views(_union("""
SELECT '{c}' AS feature, count({c})::BIGINT AS n,
       skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS skew,
       kurtosis_pop({c}) AS kurt,
       count({c}) / 6.0 * (pow(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 2)
                           + pow(kurtosis_pop({c}), 2) / 4.0) AS jb,
       exp(-(count({c}) / 6.0 * (pow(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 2)
                           + pow(kurtosis_pop({c}), 2) / 4.0)) / 2) AS p_value,
       exp(-(count({c}) / 6.0 * (pow(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 2)
                           + pow(kurtosis_pop({c}), 2) / 4.0)) / 2) >= 0.05 AS normal
FROM test_rows""", NUM), "test_rows"))
def g02(t):
    """Jarque-Bera normality (the small-n branch, re-aimed from Shapiro-Wilk)."""
    return S.jarque_bera(fx.test_rows(t), NUM)


def _mw_sql() -> str:
    long = _union("SELECT '{c}' AS feature, {c}::DOUBLE AS value, target FROM feature_store "
                  "WHERE {c} IS NOT NULL AND target IN (0, 1)", NUM)
    z = ("(greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / "
         "sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))")
    p = f"least(1.0, 2 * (1 - {norm_cdf(z)}))"
    return with_views(f"""
WITH l AS ({long}),
r AS (SELECT feature, value, target, rank() OVER (PARTITION BY feature ORDER BY value)
             + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM l),
t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM l
      GROUP BY feature, value) x GROUP BY feature),
a AS (SELECT feature, sum(CASE WHEN target = 0 THEN rk END) AS r1,
             count(*) FILTER (WHERE target = 0)::DOUBLE AS n1, count(*) FILTER (WHERE target = 1)::DOUBLE AS n2,
             avg(CASE WHEN target = 0 THEN value END) AS mean_group_0,
             avg(CASE WHEN target = 1 THEN value END) AS mean_group_1
      FROM r GROUP BY feature),
u AS (SELECT a.*, t.ties, r1 - n1 * (n1 + 1) / 2 AS u1 FROM a JOIN t USING (feature))
SELECT feature, u1 AS statistic, {p} AS p_value, {p} < 0.05 AS significant, mean_group_0, mean_group_1,
       n1::BIGINT AS n1, n2::BIGINT AS n2 FROM u""", "feature_store")


@query("g03_mann_whitney", doubles=("statistic", "p_value", "mean_group_0", "mean_group_1"), oracle=_mw_sql())
def g03(t):
    return S.mann_whitney(fx.feature_store(t), NUM, "target", 0, 1)


def _chi_sql() -> str:
    long = ("SELECT 'priority' AS feature, priority AS value, target FROM feature_store "
            "UNION ALL SELECT 'f_items', CAST(f_items AS VARCHAR), target FROM feature_store")
    diff = "abs(coalesce(o, 0) - row_n * col_n / N)"
    corr = f"CASE WHEN (r - 1) * (c - 1) = 1 THEN {diff} - least(0.5, {diff}) ELSE {diff} END"
    return with_views(f"""
WITH l AS ({long}),
o AS (SELECT feature, value, target, count(*) AS o FROM l GROUP BY ALL),
lv AS (SELECT feature, value, sum(o) AS row_n FROM o GROUP BY ALL),
cl AS (SELECT feature, target, sum(o) AS col_n FROM o GROUP BY ALL),
d AS (SELECT feature, count(*) AS r, sum(row_n) AS N FROM lv GROUP BY feature),
dc AS (SELECT feature, count(*) AS c FROM cl GROUP BY feature),
g AS (SELECT lv.feature, lv.value, cl.target, row_n, col_n, N, r, c FROM lv JOIN cl USING (feature)
      JOIN d USING (feature) JOIN dc USING (feature) WHERE r < 50),
s AS (SELECT g.feature, r, c, sum(({corr}) * ({corr}) / (row_n * col_n / N)) AS chi2
      FROM g LEFT JOIN o ON g.feature = o.feature AND g.value = o.value AND g.target = o.target
      GROUP BY g.feature, r, c)
SELECT feature, chi2, ((r - 1) * (c - 1))::BIGINT AS dof, {chi2_sf('chi2', '(r - 1) * (c - 1)')} AS p_value,
       {chi2_sf('chi2', '(r - 1) * (c - 1)')} < 0.05 AS significant FROM s""", "feature_store")


@query("g04_chi_square", doubles=("chi2", "p_value"), oracle=_chi_sql())
def g04(t):
    fs = fx.feature_store(t).withColumn("f_items", F.col("f_items").cast("string"))
    return S.chi_square(fs, ["priority", "f_items"], "target")


def _boot_sql(B: int = 200) -> str:
    u = md5u("cast(id AS VARCHAR) || '#' || cast(b AS VARCHAR)")
    return with_views(f"""
WITH base AS (SELECT id, y_true, (y_pred = y_true)::INTEGER AS h1, ((y_prob > 0.5)::INTEGER = y_true)::INTEGER AS h2
              FROM scored),
w AS (SELECT b, h1, h2, {poisson1(u)} AS w FROM base, range(1, {B + 1}) r(b)),
per AS (SELECT b, sum(w * h2) / nullif(sum(w), 0) - sum(w * h1) / nullif(sum(w), 0) AS d FROM w GROUP BY b)
SELECT avg(d) AS mean_difference, quantile_cont(d, 0.025) AS ci_lower, quantile_cont(d, 0.975) AS ci_upper,
       least(1.0, 2 * least(avg((d <= 0)::INTEGER::DOUBLE), avg((d >= 0)::INTEGER::DOUBLE))) AS p_value,
       count(*)::BIGINT AS n_replicates FROM per""", "scored")


@query("g05_paired_bootstrap", doubles=("mean_difference", "ci_lower", "ci_upper", "p_value"), oracle=_boot_sql())
def g05(t):
    """Paired Poisson bootstrap (200 replicates) of accuracy(probability model) - accuracy(length rule)."""
    s = fx.scored(t).withColumn("p2", (F.col("y_prob") > 0.5).cast("int"))
    return S.bootstrap_difference(s, "y_true", "y_pred", "p2", 200, 42, key="id")


@query("g06_bonferroni", doubles=("statistic", "p_value", "mean_group_0", "mean_group_1", "p_adjusted"),
       oracle="SELECT *, least(1.0, p_value * count(*) OVER ()) AS p_adjusted, "
              "least(1.0, p_value * count(*) OVER ()) < 0.05 AS significant_adjusted FROM (\n"
              + _mw_sql() + "\n) m")
def g06(t):
    return S.bonferroni(S.mann_whitney(fx.feature_store(t), NUM, "target", 0, 1))


@query("g07_improvement", doubles=("recall", "improvement", "improvement_pct"), oracle=with_views("""
SELECT run_id, model, recall, recall - 0.70 AS improvement, (recall - 0.70) / 0.70 * 100 AS improvement_pct,
       recall >= 0.75 AS target_reached FROM runs""", "runs"))
def g07(t):
    return S.improvement(fx.runs(t).select("run_id", "model", "recall"), "recall", 0.70, 0.75)



