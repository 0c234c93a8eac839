"""Catalog: profiling and EDA (f01-f15)."""

from __future__ import annotations

from vigil.operators import profile as P
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources.fixture_sql import with_views

FS, FSN = "feature_store", "feature_store_nulls"
NUM = ["f_total", "f_items", "f_disc"]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)


@query("f01_describe_numeric", doubles=("mean", "std", "min", "p25", "p50", "p75", "max"),
       oracle=with_views(_union("""
SELECT '{c}' AS feature, count({c})::BIGINT AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       min({c})::DOUBLE AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75, max({c})::DOUBLE AS max FROM feature_store_nulls""", NUM), FSN))
def f01(t):
    return P.describe_numeric(fx.feature_store_nulls(t), NUM)


@query("f02_describe_categorical", oracle=_union("""
SELECT '{c}' AS feature, sum(n)::BIGINT AS count, count(*)::BIGINT AS unique,
       arg_min(v, (-n, v)) AS top, max(n)::BIGINT AS freq
FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) x""",
                                                      ["o_orderstatus", "o_orderpriority"]))
def f02(t):
    return P.describe_categorical(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("f03_target_distribution", doubles=("pct", "imbalance_ratio"), oracle=with_views("""
SELECT target AS class, n AS count, n * 100.0 / sum(n) OVER () AS pct,
       max(n) OVER () * 1.0 / min(n) OVER () AS imbalance_ratio, max(n) OVER () * 1.0 / min(n) OVER () > 3 AS imbalanced
FROM (SELECT target, count(*)::BIGINT AS n FROM feature_store WHERE target IS NOT NULL GROUP BY target) c""", FS))
def f03(t):
    return P.target_distribution(fx.feature_store(t), "target")


@query("f04_histogram", doubles=("edge_lo", "edge_hi"), oracle=with_views("""
WITH l AS (""" + _union("SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM feature_store_nulls WHERE {c} IS NOT NULL",
                        NUM) + """),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature),
b AS (SELECT l.feature, lo, hi, CASE WHEN hi = lo THEN 0
             ELSE least(floor((value - lo) / ((hi - lo) / 50)), 49)::INTEGER END AS bin FROM l JOIN r USING (feature))
SELECT feature, bin, count(*)::BIGINT AS count, first(lo + bin * ((hi - lo) / 50)) AS edge_lo,
       first(lo + (bin + 1) * ((hi - lo) / 50)) AS edge_hi FROM b GROUP BY feature, bin""", FSN))
def f04(t):
    return P.histogram(fx.feature_store_nulls(t), NUM, 50)


@query("f05_iqr_outliers", doubles=("lower", "upper", "pct_outliers"), oracle=_union("""
SELECT '{c}' AS feature, lower, upper,
       count(*) FILTER (WHERE {c} < lower OR {c} > upper)::BIGINT AS n_outliers,
       count(*) FILTER (WHERE {c} < lower OR {c} > upper) * 100.0 / count(*) AS pct_outliers
FROM lineitem, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower,
                       quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper
                FROM lineitem) q GROUP BY lower, upper""", LI_NUM))
def f05(t):
    return P.iqr_outliers(t.lineitem, LI_NUM)


@query("f06_top_values", doubles=("pct",), oracle=_union("""
SELECT * FROM (SELECT '{c}' AS feature, v AS value, n AS count,
       row_number() OVER (ORDER BY n DESC, v) AS rank, n * 100.0 / (SELECT count(*) FROM orders) AS pct
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*)::BIGINT AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1) x) y
WHERE rank <= 3""", ["o_orderstatus", "o_orderpriority"]).replace("row_number() OVER (ORDER BY n DESC, v) AS rank",
                                                                  "row_number() OVER (ORDER BY n DESC, v)::INTEGER AS rank"))
def f06(t):
    """Top-3 values per categorical column (a top-k report)."""
    return P.top_values(t.orders, ["o_orderstatus", "o_orderpriority"], 3)


_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("f07_cardinality", oracle=_union("""
SELECT '{c}' AS feature, count(DISTINCT {c})::BIGINT AS n_unique, count(DISTINCT {c}) <= 10 AS le_10,
       count(DISTINCT {c}) <= 20 AS le_20, count(DISTINCT {c}) < 50 AS lt_50 FROM orders""", _ORD))
def f07(t):
    return P.cardinality(t.orders, _ORD)


@query("f08_temporal_coverage", doubles=("mean_per_day",), oracle="""
SELECT min(day) AS min_day, max(day) AS max_day, date_diff('day', min(day), max(day))::INTEGER AS range_days,
       count(*)::BIGINT AS n_days, sum(n)::BIGINT AS n_records, avg(n) AS mean_per_day
FROM (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1) d""")
def f08(t):
    return P.temporal_coverage(t.events, "ts")


def _corr_sql(view: str, cols: list[str], name: str = "r") -> str:
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, 1.0 AS {name}")
            else:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS {name} FROM {view}")
    return "\nUNION ALL\n".join(parts)


@query("f09_correlation_matrix", doubles=("r",), oracle=_corr_sql("lineitem", LI_NUM))
def f09(t):
    return P.correlation_matrix(t.lineitem, LI_NUM)


@query("f10_strongest_pairs", doubles=("r",), oracle=f"""
SELECT * FROM ({_corr_sql("lineitem", LI_NUM)}) c
WHERE feature_a < feature_b AND r <> 1.0 AND abs(r) > 0.5 ORDER BY r DESC, feature_a, feature_b LIMIT 10""")
def f10(t):
    """Strongest correlated pairs, each once (a top-10 report)."""
    return P.strongest_pairs(P.correlation_matrix(t.lineitem, LI_NUM), 0.5, 10)


@query("f11_target_correlation", doubles=("r",), oracle=with_views("""
SELECT feature, r, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, feature)::INTEGER AS rank FROM (
""" + _union("SELECT '{c}' AS feature, corr({c}::DOUBLE, target::DOUBLE) AS r FROM feature_store", NUM) + ") x", FS))
def f11(t):
    return P.target_correlation(fx.feature_store(t), NUM, "target")


@query("f12_group_means", doubles=tuple(NUM), oracle=with_views(
    "SELECT target, avg(f_total) AS f_total, avg(f_items) AS f_items, avg(f_disc) AS f_disc "
    "FROM feature_store GROUP BY target", FS))
def f12(t):
    return P.group_means(fx.feature_store(t), NUM, "target")


@query("f13_crosstab", doubles=("pct",), oracle="""
SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS count,
       count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS pct
FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def f13(t):
    return P.crosstab_pct(t.orders, "o_orderpriority", "o_orderstatus")


@query("f14_eda_summary", doubles=("completeness_pct", "duplicate_pct"), oracle=with_views("""
SELECT count(*)::BIGINT AS n_rows, 9 AS n_columns,
       (1.0 - (count(*) FILTER (WHERE f_total IS NULL) + count(*) FILTER (WHERE f_disc IS NULL)
               + count(*) FILTER (WHERE prediction_timestamp IS NULL)) / (count(*) * 9.0)) * 100 AS completeness_pct,
       0.0 AS duplicate_pct, 6 AS n_numeric, 1 AS n_categorical, 2 AS n_datetime,
       (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT CAST(target AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR) AS x
        FROM feature_store_nulls GROUP BY target) d) AS target_distribution
FROM feature_store_nulls""", FSN))
def f14(t):
    return P.eda_summary(fx.feature_store_nulls(t), "target")


def _spearman_ctes() -> list[tuple[str, str]]:
    ctes = [(f"r_{c}", f"""SELECT id, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0
                          AS {c} FROM feature_store_nulls WHERE {c} IS NOT NULL""") for c in NUM]
    ctes.append(("w", "SELECT * FROM r_f_total FULL OUTER JOIN r_f_items USING (id) "
                      "FULL OUTER JOIN r_f_disc USING (id)"))
    return ctes


@query("f15_spearman", doubles=("rho",), oracle=with_views(_corr_sql("w", NUM, "rho"), FSN, ctes=_spearman_ctes()))
def f15(t):
    return P.spearman(fx.feature_store_nulls(t), NUM, "id")
