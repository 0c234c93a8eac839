"""Catalog: projections, filters, sampling, dedup, joins (b01-b14, c02-c03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import relational as R
from vigil.plans.registry import query
from vigil.roles import Roles
from vigil.sources import fixtures as fx
from vigil.sources.fixture_sql import md5u, with_views

FS = "feature_store"


@query("b01_split_features", oracle=with_views("SELECT * EXCLUDE (target) FROM feature_store", FS),
       doubles=("f_total", "f_disc"))
def b01(t):
    return R.split_target(fx.feature_store(t), "target")[0]


@query("b02_feature_columns", doubles=("f_total", "f_disc"), oracle=with_views(
    "SELECT customer_id, f_total, f_items, f_disc, priority FROM feature_store", FS))
def b02(t):
    return R.feature_frame(fx.feature_store(t), Roles())


@query("b03_column_families", oracle="""
SELECT (ordinal_position - 1)::INTEGER AS position, column_name AS "column",
       CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','FLOAT','SMALLINT','TINYINT','HUGEINT')
                 OR data_type LIKE 'DECIMAL%' THEN 'numeric'
            WHEN data_type IN ('VARCHAR','BOOLEAN') THEN 'categorical'
            WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'datetime'
            ELSE 'other' END AS family
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def b03(t):
    """Column families of the line-item table (schema introspection)."""
    return R.column_families(t.lineitem).drop("dtype")


AS_OF_DATE = "2001-08-01"


@query("b04_trailing_window", doubles=("f_total", "f_disc"), oracle=with_views(
    f"SELECT * FROM feature_store WHERE date >= DATE '{AS_OF_DATE}' - 30", FS))
def b04(t):
    return R.trailing_window(fx.feature_store(t), AS_OF_DATE, 30)


PENDING_DAY = "2000-06-15"


@query("b05_pending_rows", doubles=("f_total", "f_disc"), oracle=with_views(
    f"SELECT * FROM feature_store WHERE date = DATE '{PENDING_DAY}' AND prediction_timestamp IS NULL", FS))
def b05(t):
    return R.pending_rows(fx.feature_store(t), PENDING_DAY)


P0, P1 = "2024-01-10 00:00:00", "2024-01-20 12:00:00"


@query("b06_period_filter", doubles=("latency_ms",), oracle=with_views(
    f"SELECT * FROM service_log WHERE ts >= TIMESTAMP '{P0}' AND ts <= TIMESTAMP '{P1}'", "service_log"))
def b06(t):
    return R.period_filter(fx.service_log(t), "ts", P0, P1)


AS_OF_TS = "2024-01-30 00:00:00"


@query("b07_last_n_days", doubles=("value",), oracle=with_views(
    f"SELECT * FROM metric_history WHERE ts >= TIMESTAMP '{AS_OF_TS}' - INTERVAL 7 DAY", "metric_history"))
def b07(t):
    return R.last_n_days(fx.metric_history(t), "ts", AS_OF_TS, 7)


@query("b08_bounded_sample", doubles=("f_total", "f_disc"), oracle=with_views(
    f"SELECT * FROM feature_store ORDER BY {md5u('id')}, id LIMIT 1000", FS))
def b08(t):
    """Deterministic sample of min(1000, n) rows (a sampling operator: the limit is the feature)."""
    return R.bounded_sample(fx.feature_store(t), 1000, "id", 42)


@query("b09_dedup_keep_last", doubles=("f_total", "f_disc"), oracle=with_views("""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, date ORDER BY id DESC) AS rn FROM feature_store) s
WHERE rn = 1""", FS))
def b09(t):
    return R.dedup_keep_last(fx.feature_store(t), ["customer_id", "date"], ["id"])


@query("b10_duplicate_report", oracle=with_views("""
SELECT coalesce(sum(cnt - 1), 0)::BIGINT AS n_duplicates, count(*) FILTER (WHERE cnt > 1)::BIGINT AS n_groups,
       coalesce(sum(CASE WHEN cnt > 1 THEN cnt END), 0)::BIGINT AS n_rows_in_groups
FROM (SELECT customer_id, date, count(*) AS cnt FROM feature_store GROUP BY customer_id, date) g""", FS))
def b10(t):
    return R.duplicate_report(fx.feature_store(t), ["customer_id", "date"])


@query("b10_duplicate_members", doubles=("f_total", "f_disc"), oracle=with_views("""
SELECT * EXCLUDE (c) FROM (
  SELECT *, count(*) OVER (PARTITION BY customer_id, date) AS c FROM feature_store) s WHERE c > 1""", FS))
def b10m(t):
    return R.duplicate_members(fx.feature_store(t), ["customer_id", "date"])


SCORED_AT = "2024-02-01 00:00:00"


@query("b11_append_prediction", doubles=("f_total", "f_disc"), oracle=with_views(f"""
SELECT * EXCLUDE (prediction_timestamp), (f_total > 250000)::INTEGER AS prediction,
       TIMESTAMP '{SCORED_AT}' AS prediction_timestamp, 'v3' AS model_version
FROM feature_store""", FS))
def b11(t):
    fs = fx.feature_store(t).drop("prediction_timestamp")
    return R.append_prediction(fs, (F.col("f_total") > 250000).cast("int"), "v3", SCORED_AT)


@query("b12_risk_band", doubles=("probability",), oracle=with_views("""
SELECT *, CASE WHEN probability > 0.7 THEN 'high' WHEN probability >= 0.4 THEN 'medium' ELSE 'low' END
          AS risk_band FROM predictions""", "predictions"))
def b12(t):
    return R.risk_band(fx.predictions(t))


@query("b13_review_queue", doubles=("probability",), oracle=with_views(
    "SELECT * FROM predictions WHERE probability BETWEEN 0.4 AND 0.6", "predictions"))
def b13(t):
    return R.review_queue(fx.predictions(t))


@query("b14_high_risk_list", doubles=("probability",), oracle=with_views(
    "SELECT * FROM predictions ORDER BY probability DESC, customer_id LIMIT 50", "predictions"))
def b14(t):
    """Top-50 hand-off list (a top-k report: the limit is the feature)."""
    return R.high_risk_list(fx.predictions(t), 50)


@query("c02_enrich_reference", doubles=("c_acctbal",), oracle="""
SELECT c.*, n.n_name, n.n_regionkey, r.r_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def c02(t):
    nation = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return R.enrich(t.customer, [(nation, "c_nationkey"), (region, "n_regionkey")]).select(
        *t.customer.columns, "n_name", "n_regionkey", "r_name")


@query("c03_referential_integrity", oracle="""
SELECT 'orders' AS child, 'o_custkey' AS child_key, 'customer' AS parent,
       (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT AS n_orphans
UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders',
       (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::BIGINT
UNION ALL SELECT 'lineitem', 'l_partkey', 'part',
       (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))::BIGINT
UNION ALL SELECT 'lineitem', 'l_suppkey', 'supplier',
       (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier))::BIGINT
UNION ALL SELECT 'labels', 'doc_id', 'documents',
       (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))::BIGINT""")
def c03(t):
    return R.referential_integrity(t.spark, [
        ("orders", t.orders, "o_custkey", "customer", t.customer, "c_custkey"),
        ("lineitem", t.lineitem, "l_orderkey", "orders", t.orders, "o_orderkey"),
        ("lineitem", t.lineitem, "l_partkey", "part", t.part, "p_partkey"),
        ("lineitem", t.lineitem, "l_suppkey", "supplier", t.supplier, "s_suppkey"),
        ("labels", t.labels, "doc_id", "documents", t.documents, "doc_id"),
    ])
