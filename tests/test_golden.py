"""Hand-computed micro-frames for the edge rules of SURVEY 2.16."""

import math

import pytest

from vigil.functions import exprs as X
from vigil.functions.ranks import cumulative, exact_quantiles
from vigil.operators import business as B
from vigil.operators import evaluation as V
from vigil.operators import fairness as L
from vigil.operators import profile as P
from vigil.operators import relational as R
from vigil.operators import stats as S


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_norm_cdf_and_erfc_accuracy(spark):
    zs = [-4.0, -1.5, -0.3, 0.0, 0.7, 1.96, 3.2]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(X.norm_cdf("z")).collect()]
    for z, g in zip(zs, got):
        assert abs(g - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 2e-7


def test_chi2_sf_closed_form(spark):
    # dof 1: erfc(sqrt(x/2)); dof 2: exp(-x/2); dof 3: erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2)
    cases = [(3.84, 1), (5.99, 2), (7.81, 3), (10.0, 4), (2.0, 5)]
    df = spark.createDataFrame(cases, "x double, k int")
    got = [r[0] for r in df.select(X.chi2_sf("x", "k")).collect()]
    exp = [math.erfc(math.sqrt(3.84 / 2)), math.exp(-5.99 / 2),
           math.erfc(math.sqrt(7.81 / 2)) + math.sqrt(2 * 7.81 / math.pi) * math.exp(-7.81 / 2),
           math.exp(-5.0) * (1 + 5.0),
           math.erfc(1.0) + math.sqrt(2 / math.pi) * math.exp(-1.0) * (math.sqrt(2.0) + 2.0 ** 1.5 / 3)]
    for g, e in zip(got, exp):
        assert abs(g - e) < 1e-6


def test_md5_uniform_range_and_determinism(spark):
    df = spark.range(1000)
    a = [r[0] for r in df.select(X.md5_uniform("id")).collect()]
    b = [r[0] for r in df.repartition(7).orderBy("id").select(X.md5_uniform("id")).collect()]
    assert a == b and all(0 <= u < 1 for u in a)


@pytest.mark.parametrize("buckets", [1, 4])
def test_cumulative_matches_window(spark, buckets):
    rows = [("a", float(v), c) for v, c in [(1, 2), (2, 1), (3, 5), (5, 1), (8, 2), (13, 1)]] + \
           [("b", float(v), 1) for v in range(20)]
    cells = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r["g"], r["v"]): (r["cum_n"], r["next_value"]) for r in
           cumulative(cells, ["g"], "v", ["n"], buckets=buckets, with_next=True).collect()}
    run = {}
    for g in ("a", "b"):
        vals = sorted((v, c) for gg, v, c in rows if gg == g)
        s = 0
        for i, (v, c) in enumerate(vals):
            s += c
            nxt = vals[i + 1][0] if i + 1 < len(vals) else None
            run[(g, v)] = (s, nxt)
    assert got == run


def test_exact_quantiles_ties_and_single_row(spark):
    rows = [("x", v) for v in [1.0, 2.0, 2.0, 2.0, 10.0]] + [("y", 7.0)]
    long = spark.createDataFrame(rows, "feature string, value double")
    q = {(r["feature"], r["q"]): r["value_q"] for r in
         exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.9], buckets=2).collect()}
    assert q[("x", 0.25)] == 2.0 and q[("x", 0.5)] == 2.0
    assert abs(q[("x", 0.9)] - (2.0 + 0.6 * 8.0)) < 1e-12   # pos 3.6 between 2.0 and 10.0
    assert q[("y", 0.5)] == 7.0


def test_churn_null_counts_as_not_churned(spark):
    df = spark.createDataFrame([(1,), (None,), (0,), (1,)], "churned int")
    r = one(B.churn_rate(df))
    assert r["value"] == 50.0 and r["total_customers"] == 4 and r["churned_customers"] == 2


def test_zero_baselines(spark):
    df = spark.range(5)
    r = one(B.cost_reduction(df, 0.0, 0.0))
    assert r["cost_reduction_pct"] == 0.0
    rev = spark.createDataFrame([(100.0,)], "value double")
    assert one(B.roi(rev, 0.0, 0.0, 1))["value"] == 0.0
    proc = spark.createDataFrame([(1, 0.0, 0.0)], "id int, before_h double, after_h double")
    assert one(B.process_efficiency(proc))["efficiency_gain_pct"] == 0.0


def test_one_row_std_is_null(spark):
    df = spark.createDataFrame([(7.0,)], "nps_score double")
    r = one(B.satisfaction(df))
    assert r["std"] is None and r["value"] == 7.0 and r["n_responses"] == 1


def test_fairness_edge_groups(spark):
    rows = [
        # group A: positives and negatives
        (1, 1, 0.2, "A"), (1, 0, 0.4, "A"), (0, 1, 0.9, "A"), (0, 0, 0.1, "A"),
        # group B: no true positives -> TPR NULL; one probability exactly 1.0
        (0, 1, 1.0, "B"), (0, 0, 0.3, "B"),
        # NULL group: excluded
        (1, 1, 0.5, None),
    ]
    df = spark.createDataFrame(rows, "y_true int, y_pred int, y_prob double, g string")
    g = {r["group"]: r for r in L.group_rates(df, ["g"]).collect()}
    assert set(g) == {"A", "B"}
    assert g["B"]["tpr"] is None and g["A"]["tpr"] == 0.5
    s = {r["metric"]: r for r in L.fairness_summary(df, ["g"]).collect()}
    assert s["equal_opportunity"]["value"] is None and s["equal_opportunity"]["passes"] is None
    assert s["demographic_parity"]["value"] == 0.0
    cal = {r["group"]: r for r in L.calibration_by_group(df, ["g"]).collect()}
    assert cal["B"]["n_samples"] == 2
    assert abs(cal["B"]["ece"] - 0.3) < 1e-12   # the p = 1.0 row is outside every bin


def test_disparate_impact_zero_max(spark):
    df = spark.createDataFrame([(1, 0, 0.1, "A"), (0, 0, 0.2, "B")], "y_true int, y_pred int, y_prob double, g string")
    s = {r["metric"]: r for r in L.fairness_summary(df, ["g"]).collect()}
    assert s["disparate_impact"]["value"] == 0.0 and s["disparate_impact"]["passes"] is False


def test_auc_with_ties(spark):
    # positives scores 0.8, 0.5 ; negatives 0.5, 0.2 -> pairs: (0.8>0.5),(0.8>0.2),(0.5=0.5 half),(0.5>0.2) = 3.5/4
    df = spark.createDataFrame([(1, 0.8), (1, 0.5), (0, 0.5), (0, 0.2)], "y_true int, y_prob double")
    assert abs(one(V.auc(df))["auc"] - 0.875) < 1e-12
    assert one(V.auc(df.where("y_true = 1")))["auc"] is None


def test_weighted_metrics_zero_division(spark):
    # class 2 is never predicted -> its precision is 0 (zero_division=0)
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 0)], "y_true int, y_pred int")
    r = one(V.classification_metrics(df))
    assert r["accuracy"] == 0.5
    # precision_0 = 1/2, precision_1 = 1/2, precision_2 = 0; supports 1, 1, 2
    assert abs(r["precision"] - (0.5 + 0.5 + 0) / 4) < 1e-12


def test_mann_whitney_small_ties(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (1, 2.0), (1, 3.0), (1, 4.0)], "g int, x double")
    r = one(S.mann_whitney(df, ["x"], "g", 0, 1, buckets=2))
    # ranks: 1 | 3,3,3 | 5 | 6 -> R1 = 1 + 3 + 3 = 7, U1 = 7 - 6 = 1
    assert r["statistic"] == 1.0
    n1 = n2 = 3.0
    N = 6.0
    sigma = math.sqrt(n1 * n2 / 12 * ((N + 1) - (27 - 3) / (N * (N - 1))))
    z = (8 - 4.5 - 0.5) / sigma
    assert abs(r["p_value"] - min(1.0, math.erfc(z / math.sqrt(2)))) < 1e-6


def test_histogram_zero_width(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "v double")
    rows = P.histogram(df, ["v"], 50).collect()
    assert len(rows) == 1 and rows[0]["bin"] == 0 and rows[0]["count"] == 3


def test_dedup_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", 2), (2, "b", 1)], "k int, v string, o int")
    assert sorted(tuple(r) for r in R.dedup_keep_last(df, ["k"], ["o"]).collect()) == [(1, "a", 2), (2, "b", 1)]
    r = one(R.duplicate_report(df))
    assert r["n_duplicates"] == 1 and r["n_groups"] == 1 and r["n_rows_in_groups"] == 2
