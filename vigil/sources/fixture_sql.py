"""The fixture views as DuckDB SQL text, plus SQL forms of the shared
column expressions.  Used only to build the independent oracle queries in
``__spark_entry__.oracle_sql``.
"""

from __future__ import annotations

import math

from vigil.functions.exprs import AS_A, AS_P
from vigil.sources import fixtures as fx


def md5u(key: str, salt: int = 42) -> str:
    return (f"(('0x' || substr(md5(cast({key} as varchar) || ':{salt}'), 1, 8))::BIGINT"
            f" / 4294967296.0)::DOUBLE")


def erf(x: str) -> str:
    ax = f"abs(({x})::DOUBLE)"
    t = f"(1.0 / (1.0 + {AS_P} * {ax}))"
    poly = f"{AS_A[4]}"
    for a in reversed(AS_A[:4]):
        poly = f"(({poly}) * {t} + {a})"
    poly = f"(({poly}) * {t})"
    y = f"(1.0 - {poly} * exp(-{ax} * {ax}))"
    return f"(CASE WHEN ({x}) >= 0 THEN {y} ELSE -{y} END)"


def norm_cdf(z: str) -> str:
    return f"(0.5 * (1.0 + {erf(f'({z}) / {math.sqrt(2.0)!r}')}))"


def sigmoid(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-({z}))))"


def ks_pvalue(d: str, n1: str, n2: str, terms: int = 100) -> str:
    m = f"(({n1})::DOUBLE * ({n2}) / (({n1}) + ({n2})))"
    lam = f"((sqrt({m}) + 0.12 + 0.11 / sqrt({m})) * ({d}))"
    series = (f"list_sum(list_transform(range(1, {terms + 1}), "
              f"lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * {lam} * {lam})))")
    return (f"(CASE WHEN {lam} < 0.2 THEN 1.0 "
            f"ELSE least(1.0, greatest(0.0, 2.0 * {series})) END)")


def chi2_sf(x: str, dof: str) -> str:
    xx = f"(({x})::DOUBLE)"
    half = f"({xx} / 2)"
    k = f"(({dof})::INTEGER)"
    even = (f"list_sum(list_transform(range(0, greatest({k} // 2 - 1, 0) + 1), lambda i: "
            f"exp(-{half} + i * ln(greatest({half}, 1e-300)) - lgamma(i + 1))))")
    odd_terms = (f"list_sum(list_transform(range(1, greatest(({k} - 1) // 2, 1) + 1), lambda i: "
                 f"exp(-{half} + (i - 0.5) * ln(greatest({xx}, 1e-300)) "
                 f"- (lgamma(2 * i + 1) - i * ln(2.0) - lgamma(i + 1)))))")
    erfc = f"(1.0 - {erf(f'sqrt({half})')})"
    odd = f"({erfc} + CASE WHEN {k} >= 3 THEN {math.sqrt(2.0 / math.pi)!r} * {odd_terms} ELSE 0.0 END)"
    p = f"(CASE WHEN {k} % 2 = 0 THEN {even} ELSE {odd} END)"
    return f"(CASE WHEN {xx} <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, {p})) END)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "t0": ((), f"SELECT (max(o_orderdate)::DATE - {fx.LOOKBACK_DAYS}) AS t0 FROM orders"),
    "customer_history": (("t0",), f"""
        SELECT c.c_custkey AS customer_id,
               coalesce(h.rec, {fx.NO_ORDER_RECENCY}) AS rec,
               coalesce(h.n_before, 0)::BIGINT AS n_before,
               coalesce(h.n_after, 0)::BIGINT AS n_after
        FROM customer c LEFT JOIN (
            SELECT o_custkey,
                   min(CASE WHEN o_orderdate <= t0 THEN date_diff('day', o_orderdate::DATE, t0) END) AS rec,
                   count(*) FILTER (WHERE o_orderdate <= t0) AS n_before,
                   count(*) FILTER (WHERE o_orderdate > t0) AS n_after
            FROM orders, t0 GROUP BY o_custkey) h ON h.o_custkey = c.c_custkey"""),
    "predictions": (("customer_history",), f"""
        SELECT customer_id,
               (rec > {fx.RECENCY_LIMIT} OR n_before < {fx.MIN_ORDERS})::INTEGER AS prediction,
               {sigmoid(f'(rec - {fx.RECENCY_LIMIT}) / {fx.RECENCY_SCALE}')} AS probability
        FROM customer_history"""),
    "actuals": (("customer_history",),
                "SELECT customer_id, (n_after = 0)::INTEGER AS actual FROM customer_history"),
    "scored": ((), f"""
        SELECT d.doc_id AS id, l.quality::INTEGER AS y_true, (d.n_chars > 1200)::INTEGER AS y_pred,
               {sigmoid('(d.n_chars - 2000) / 1500.0')} AS y_prob, d.lang, d.source
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
    "scored_biased": (("scored",), f"""
        SELECT id, y_true,
               CASE WHEN lang = 'fr' AND y_true = 1 AND {md5u('id')} < 0.3 THEN 0 ELSE y_pred END AS y_pred,
               y_prob, lang, source FROM scored"""),
    "feature_store": ((), """
        SELECT o.o_orderkey AS id, o.o_custkey AS customer_id, o.o_orderdate::DATE AS date,
               o.o_totalprice AS f_total, coalesce(li.f_items, 0)::BIGINT AS f_items, li.f_disc,
               o.o_orderpriority AS priority,
               CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL 1 DAY END
                   AS prediction_timestamp,
               (o.o_orderstatus = 'F')::INTEGER AS target
        FROM orders o LEFT JOIN (
            SELECT l_orderkey, count(*) AS f_items, avg(l_discount) AS f_disc
            FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey"""),
    "feature_store_nulls": (("feature_store",), """
        SELECT id, customer_id, date,
               CASE WHEN id % 7 = 0 THEN NULL ELSE f_total END AS f_total, f_items,
               CASE WHEN id % 11 = 0 THEN NULL ELSE f_disc END AS f_disc,
               priority, prediction_timestamp, target
        FROM feature_store"""),
    "train_rows": (("feature_store",), f"SELECT * FROM feature_store WHERE date <= DATE '{fx.SPLIT_DATE}'"),
    "test_rows": (("feature_store",), f"SELECT * FROM feature_store WHERE date > DATE '{fx.SPLIT_DATE}'"),
    "ref": ((), f"SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '{fx.DRIFT_CUT}'"),
    "cur": ((), f"SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '{fx.DRIFT_CUT}'"),
    "cur_shift": (("cur",), "SELECT event_id, ts, user_id, event_type, value * 1.5 AS value FROM cur"),
    "service_log": ((), """
        SELECT ts, 'v' || CAST(user_id % 2 + 1 AS VARCHAR) AS model_version, value AS latency_ms,
               (event_type = 'error' AND event_id % 10 = 0)::INTEGER AS is_error,
               (value < 150)::INTEGER AS is_correct, user_id % 3 + 1 AS num_samples, event_id, user_id
        FROM events"""),
    "metric_history": ((), "SELECT event_type AS name, value, 'BRL' AS unit, ts FROM events"),
    "feedback": ((), "SELECT least(10.0, floor(value / 10)::DOUBLE) AS nps_score FROM events"),
    "processes": ((), "SELECT p_partkey AS id, p_size::DOUBLE AS before_h, p_size / 2.0 AS after_h FROM part"),
    "runs": ((), """
        SELECT p_partkey AS run_id, p_brand AS model, CAST(p_partkey % 9 AS VARCHAR) AS version,
               CASE p_partkey % 4 WHEN 0 THEN 'Production' WHEN 1 THEN 'Staging'
                    WHEN 2 THEN 'Archived' ELSE 'None' END AS stage,
               (p_partkey * 7919) % 1000 / 1000.0 AS recall,
               (p_partkey * 104729) % 1000 / 1000.0 AS accuracy,
               TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL 1 MINUTE AS ts
        FROM part"""),
    "pipeline_runs": ((), """
        SELECT o_orderkey AS run_id, o_orderpriority AS dag,
               o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS start_ts,
               o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR
                   + CAST(trunc(o_totalprice % 7200) AS INTEGER) * INTERVAL 1 SECOND AS end_ts,
               CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status
        FROM orders"""),
    "orders_v1": ((), f"SELECT * FROM orders WHERE {md5u('o_orderkey')} < 0.95"),
    "orders_v2": ((), f"""
        SELECT * EXCLUDE (u) REPLACE (CASE WHEN u > 0.5 AND u < 0.52 THEN NULL ELSE o_totalprice END AS o_totalprice,
                          CASE WHEN u > 0.6 AND u < 0.61 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority)
        FROM (SELECT *, {md5u('o_orderkey')} AS u FROM orders) o WHERE u > 0.05"""),
    "y_reg": ((), """
        SELECT l.l_extendedprice AS y, l.l_quantity * p.p_retailprice AS yhat
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""),
}


def with_views(body: str, *names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs of the named views (dependencies first)."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    parts += [f"{n} AS ({s})" for n, s in (ctes or [])]
    stripped = body.lstrip()
    if parts and stripped[:5].upper() == "WITH ":
        # merge the body's own CTE list into ours
        return f"WITH {', '.join(parts)},\n{stripped[5:]}"
    return (f"WITH {', '.join(parts)}\n{body}") if parts else body


def poisson1(u: str) -> str:
    """SQL form of ``exprs.poisson1_weight``."""
    terms, cdf, t = [], 0.0, math.exp(-1.0)
    for k in range(12):
        cdf += t
        terms.append(f"CASE WHEN ({u}) >= {cdf!r} THEN 1 ELSE 0 END")
        t = t / (k + 1)
    return "(" + " + ".join(terms) + ")"
