"""Catalog: robustness audit (m01-m07) with an expression model (oracle-checkable)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import robustness as M
from vigil.operators.scoring import ExpressionModel
from vigil.functions.exprs import sigmoid
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources.fixture_sql import md5u, with_views

NUM = ["f_total", "f_items", "f_disc"]
CAT = ["priority"]


def model() -> ExpressionModel:
    z = (F.lit(-2.0) + F.lit(1.0e-5) * F.coalesce(F.col("f_total").cast("double"), F.lit(0.0))
         + F.lit(0.1) * F.coalesce(F.col("f_items").cast("double"), F.lit(0.0))
         - F.lit(5.0) * F.coalesce(F.col("f_disc").cast("double"), F.lit(0.0))
         + F.lit(0.3) * F.coalesce((F.col("priority") == "1-URGENT").cast("double"), F.lit(0.0)))
    return ExpressionModel(sigmoid(z), 0.5, "robust-1")


def _p(t: str = "f_total", i: str = "f_items", d: str = "f_disc", pr: str = "priority") -> str:
    z = (f"-2.0 + 1.0e-5 * coalesce(({t})::DOUBLE, 0.0) + 0.1 * coalesce(({i})::DOUBLE, 0.0) "
         f"- 5.0 * coalesce(({d})::DOUBLE, 0.0) + 0.3 * coalesce((({pr}) = '1-URGENT')::INTEGER::DOUBLE, 0.0)")
    return f"(1.0 / (1.0 + exp(-({z}))))"


def _bm(c: str) -> str:
    u1 = md5u(f"CAST(id AS VARCHAR) || '|{c}|a'")
    u2 = md5u(f"CAST(id AS VARCHAR) || '|{c}|b'")
    return f"(sqrt(-2.0 * ln(greatest({u1}, 1e-12))) * cos({2 * 3.141592653589793!r} * {u2}))"


def _pert_sql() -> str:
    noisy = {c: f"({c}::DOUBLE + 0.1 * sd_{c} * {_bm(c)})" for c in NUM}
    po, pm = _p(), _p(noisy["f_total"], noisy["f_items"], noisy["f_disc"])
    return f"""
SELECT 'adversarial_perturbation' AS test, 0.1 AS epsilon, count(*)::BIGINT AS n_samples,
       avg(((({po}) >= 0.5)::INTEGER <> (({pm}) >= 0.5)::INTEGER)::INTEGER::DOUBLE) AS prediction_change_rate,
       avg(abs(({po}) - ({pm}))) AS probability_change_mean,
       CASE WHEN avg(((({po}) >= 0.5)::INTEGER <> (({pm}) >= 0.5)::INTEGER)::INTEGER::DOUBLE) < 0.1 THEN 'PASSED'
            ELSE 'FAILED' END AS status
FROM test_rows, (SELECT {", ".join(f"stddev_samp({c}) AS sd_{c}" for c in NUM)} FROM test_rows) s"""


@query("m01_perturbation", doubles=("epsilon", "prediction_change_rate", "probability_change_mean"),
       oracle=with_views(_pert_sql(), "test_rows"))
def m01(t):
    """Gaussian noise of 0.1 std on every numeric feature of all test rows (keyed, reproducible)."""
    return M.perturbation_test(fx.test_rows(t), model(), NUM, "id", 0.1)


def _inv_sql() -> str:
    parts = []
    for c in NUM:
        mod = {x: (f"({x}::DOUBLE + sd)" if x == c else x) for x in NUM}
        pm = _p(mod["f_total"], mod["f_items"], mod["f_disc"])
        parts.append(f"""SELECT '{c}' AS feature, count(*)::BIGINT AS n_samples,
            avg((((({_p()}) >= 0.5)::INTEGER) <> ((({pm}) >= 0.5)::INTEGER))::INTEGER::DOUBLE) AS prediction_change_rate
            FROM test_rows, (SELECT stddev_samp({c}) AS sd FROM test_rows) s""")
    pm = _p(pr="r.nv")
    parts.append(f"""SELECT 'priority', count(*)::BIGINT,
        avg((((({_p()}) >= 0.5)::INTEGER) <> ((({pm}) >= 0.5)::INTEGER))::INTEGER::DOUBLE)
        FROM test_rows LEFT JOIN (SELECT v, coalesce(lead(v) OVER (ORDER BY v), first(v) OVER (ORDER BY v)) AS nv
                                  FROM (SELECT DISTINCT CAST(priority AS VARCHAR) AS v FROM test_rows WHERE priority IS NOT NULL) d) r
        ON CAST(test_rows.priority AS VARCHAR) = r.v""")
    u = "\nUNION ALL\n".join(parts)
    return f"SELECT *, CASE WHEN prediction_change_rate < 0.05 THEN 'PASSED' ELSE 'FAILED' END AS status FROM ({u}) x"


@query("m02_invariance", doubles=("prediction_change_rate",), oracle=with_views(_inv_sql(), "test_rows"))
def m02(t):
    return M.invariance_test(fx.test_rows(t), model(), NUM, CAT)


def _edge_sql() -> str:
    st = ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}, avg({c}) AS mu_{c}, "
                   f"stddev_samp({c}) AS sd_{c}, quantile_cont({c}, 0.5) AS md_{c}" for c in NUM)
    mode = ("(SELECT arg_min(v, (-n, v)) FROM (SELECT CAST(priority AS VARCHAR) AS v, count(*) AS n FROM test_rows "
            "WHERE priority IS NOT NULL GROUP BY 1) x)")
    cases = {
        "all_min_values": {c: f"lo_{c}" for c in NUM},
        "all_max_values": {c: f"hi_{c}" for c in NUM},
        "zero_values": {c: f"CASE WHEN lo_{c} <= 0 AND hi_{c} >= 0 THEN 0.0 ELSE md_{c} END" for c in NUM},
        "extreme_values": {c: f"mu_{c} + 3 * sd_{c}" for c in NUM},
    }
    rows = []
    for name, v in cases.items():
        p = _p(v["f_total"], v["f_items"], v["f_disc"], "m")
        rows.append(f"SELECT '{name}' AS \"case\", (({p}) >= 0.5)::INTEGER AS prediction, {p} AS probability, "
                    f"'PASSED' AS status FROM s")
    return f"WITH s AS (SELECT {st}, {mode} AS m FROM test_rows)\n" + "\nUNION ALL\n".join(rows)


@query("m03_edge_cases", doubles=("probability",), oracle=with_views(_edge_sql(), "test_rows"))
def m03(t):
    return M.edge_cases(fx.test_rows(t), model(), NUM, CAT)


def _stab_sql() -> str:
    u = md5u("CAST(id AS VARCHAR) || '#' || CAST(trial AS VARCHAR)")
    return f"""
WITH s AS (SELECT id, (({_p()}) >= 0.5)::INTEGER AS prediction FROM test_rows),
tr AS (SELECT trial, prediction, row_number() OVER (PARTITION BY trial ORDER BY {u}, id) AS r
       FROM s, range(0, 10) t(trial)),
per AS (SELECT trial, avg((prediction = 1)::INTEGER::DOUBLE) AS pr, count(DISTINCT prediction) AS k FROM tr
        WHERE r <= 100 GROUP BY trial)
SELECT 'prediction_stability' AS test, count(*)::BIGINT AS n_trials_used, avg(pr) AS mean_positive_rate,
       stddev_pop(pr) AS std_positive_rate, stddev_pop(pr) / nullif(avg(pr), 0) AS cv,
       CASE WHEN coalesce(stddev_pop(pr) / nullif(avg(pr), 0) < 0.1, false) THEN 'PASSED' ELSE 'FAILED' END AS status
FROM per WHERE k = 2"""


@query("m04_stability", doubles=("mean_positive_rate", "std_positive_rate", "cv"),
       oracle=with_views(_stab_sql(), "test_rows"))
def m04(t):
    """Ten keyed samples of 100 test rows (sampling is the feature of this test)."""
    return M.stability_test(fx.test_rows(t), model(), "id", 10, 100)


def _range_sql() -> str:
    parts = [f"""SELECT '{c}' AS feature, lo AS train_min, hi AS train_max,
        count(*) FILTER (WHERE {c}::DOUBLE < lo)::BIGINT AS n_below, count(*) FILTER (WHERE {c}::DOUBLE > hi)::BIGINT AS n_above,
        (count(*) FILTER (WHERE {c}::DOUBLE < lo) + count(*) FILTER (WHERE {c}::DOUBLE > hi)) * 100.0 / count(*) AS pct
        FROM test_rows, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM train_rows) s GROUP BY lo, hi"""
             for c in NUM]
    u = "\nUNION ALL\n".join(parts)
    return f"""SELECT feature, train_min, train_max, n_below, n_above, pct AS out_of_range_pct,
       CASE WHEN pct < 5 THEN 'PASSED' WHEN pct < 10 THEN 'WARNING' ELSE 'FAILED' END AS status FROM ({u}) x"""


@query("m05_range_check", doubles=("train_min", "train_max", "out_of_range_pct"),
       oracle=with_views(_range_sql(), "train_rows", "test_rows"))
def m05(t):
    return M.range_check(fx.train_rows(t), fx.test_rows(t), NUM)


@query("m06_run_all", oracle=with_views(f"""
WITH st AS (SELECT status FROM ({_pert_sql()}) a UNION ALL SELECT status FROM ({_inv_sql()}) b
            UNION ALL SELECT status FROM ({_edge_sql()}) c UNION ALL SELECT status FROM ({_stab_sql()}) d
            UNION ALL SELECT status FROM ({_range_sql()}) e)
SELECT status, count(*)::BIGINT AS n,
       (SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED'
                    WHEN count(*) FILTER (WHERE status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASSED' END FROM st)
           AS overall_status
FROM st GROUP BY status""", "train_rows", "test_rows"))
def m06(t):
    test, train, m = fx.test_rows(t), fx.train_rows(t), model()
    return M.run_all([("perturbation", M.perturbation_test(test, m, NUM, "id", 0.1)),
                      ("invariance", M.invariance_test(test, m, NUM, CAT)),
                      ("edge_cases", M.edge_cases(test, m, NUM, CAT)),
                      ("stability", M.stability_test(test, m, "id", 10, 100)),
                      ("range_check", M.range_check(train, test, NUM))])


@query("m07_high_volume", oracle=with_views("""
SELECT count(*)::BIGINT * 100 AS n_scored, count(*)::BIGINT * 100 AS n_predictions, count(*)::BIGINT * 100 AS n_expected,
       'PASSED' AS status FROM test_rows""", "test_rows"))
def m07(t):
    """Every test row replicated 100 times and scored."""
    return M.high_volume(fx.test_rows(t), model(), 100)
