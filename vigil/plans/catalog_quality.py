"""Catalog: data validation and quality (e01-e15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import quality as Q
from vigil.plans.registry import query
from vigil.roles import DatamartRules
from vigil.sources import fixtures as fx
from vigil.sources import io
from vigil.sources.fixture_sql import with_views

FS, FSN = "feature_store", "feature_store_nulls"


@query("e01_datamart_gate", oracle=with_views("""
SELECT n_rows, 1000 AS min_rows, n_rows >= 1000 AS rows_ok, '' AS missing_columns,
       nulls AS null_critical, (n_rows - n_keys)::BIGINT AS n_duplicates,
       CASE WHEN NOT (n_rows >= 1000) THEN 'error' WHEN nulls > 0 OR n_rows - n_keys > 0 THEN 'warning'
            ELSE 'ok' END AS status
FROM (SELECT count(*)::BIGINT AS n_rows,
             (count(*) FILTER (WHERE customer_id IS NULL) + count(*) FILTER (WHERE date IS NULL)
              + count(*) FILTER (WHERE target IS NULL))::BIGINT AS nulls,
             count(DISTINCT (customer_id, date))::BIGINT AS n_keys FROM feature_store) a""", FS))
def e01(t):
    """Datamart gate: rows, required columns, critical NULLs, duplicate keys -> status row."""
    return Q.datamart_gate(fx.feature_store(t), DatamartRules())[0]


@query("e01_datamart_dedup", doubles=("f_total", "f_disc"), oracle=with_views("""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, date ORDER BY id DESC) AS rn
                            FROM feature_store) s WHERE rn = 1""", FS))
def e01d(t):
    """The gate's deduplicated table (keep last by id), which the reference computes but drops."""
    return Q.datamart_gate(fx.feature_store(t), DatamartRules(), order_by=["id"])[1]


@query("e02_light_gate", oracle=with_views("""
SELECT count(*)::BIGINT AS n_rows, 1000 AS min_rows, count(*) > 1000 AS rows_ok, '' AS missing_columns,
       count(*) FILTER (WHERE target IS NULL)::BIGINT AS null_critical, 0::BIGINT AS n_duplicates,
       CASE WHEN NOT (count(*) > 1000) THEN 'error'
            WHEN count(*) FILTER (WHERE target IS NULL) > 0 THEN 'warning' ELSE 'ok' END AS status
FROM feature_store""", FS))
def e02(t):
    rules = DatamartRules(strict=True, required=("target",), critical=("target",), dedup_keys=())
    return Q.datamart_gate(fx.feature_store(t), rules)[0]


def _e03_sql():
    cols = ["id", "customer_id", "date", "f_total", "f_items", "f_disc", "priority", "prediction_timestamp",
            "target"]
    types = {"id": "bigint", "customer_id": "bigint", "date": "date", "f_total": "double", "f_items": "bigint",
             "f_disc": "double", "priority": "string", "prediction_timestamp": "timestamp_ntz", "target": "int"}
    parts = []
    for c in cols:
        s = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS missing_count,
            round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS missing_percent,
            '{types[c]}' AS dtype, count(DISTINCT {c})::BIGINT AS unique_values,
            (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {s} AS v FROM feature_store_nulls
              WHERE {c} IS NOT NULL ORDER BY v LIMIT 3) x) AS sample_values
        FROM feature_store_nulls""")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") u WHERE missing_count > 0"


@query("e03_missing_report", doubles=("missing_percent",), oracle=with_views(_e03_sql(), FSN))
def e03(t):
    return Q.missing_report(fx.feature_store_nulls(t))


@query("e04_dtype_distribution", oracle="""
SELECT family, count(*)::BIGINT AS n_columns FROM (
  SELECT CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','FLOAT') THEN 'numeric'
              WHEN data_type IN ('VARCHAR','BOOLEAN') THEN 'categorical'
              WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'datetime' ELSE 'other' END AS family
  FROM information_schema.columns WHERE table_name = 'lineitem') c GROUP BY family""")
def e04(t):
    return Q.dtype_distribution(t.lineitem)


_RULES = [
    Q.Rule("customer_id_not_null", "customer_id", "not_null"),
    Q.Rule("id_unique", "id", "unique"),
    Q.Rule("customer_unique", "customer_id", "unique"),
    Q.Rule("items_range", "f_items", "range", lo=1, hi=6),
    Q.Rule("total_positive", "f_total", "positive"),
    Q.Rule("target_binary", "target", "in_set", values=(0, 1)),
    Q.Rule("priority_known", "priority", "in_set", values=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
]


@query("e05_rule_violations", doubles=("pct_violations",), oracle=with_views("""
WITH a AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE customer_id IS NULL) AS v0,
  count(id) - count(DISTINCT id) AS v1,
  count(customer_id) - count(DISTINCT customer_id) AS v2,
  count(*) FILTER (WHERE f_items IS NOT NULL AND (f_items < 1 OR f_items > 6)) AS v3,
  count(*) FILTER (WHERE f_total IS NOT NULL AND f_total <= 0) AS v4,
  count(*) FILTER (WHERE target IS NOT NULL AND target NOT IN (0, 1)) AS v5,
  count(*) FILTER (WHERE priority IS NOT NULL AND priority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW')) AS v6
  FROM feature_store)
SELECT rule, "column", kind, n::BIGINT AS n_checked, v::BIGINT AS n_violations, v * 100.0 / n AS pct_violations,
       v = 0 AS passed FROM (
  SELECT 'customer_id_not_null' AS rule, 'customer_id' AS "column", 'not_null' AS kind, n, v0 AS v FROM a
  UNION ALL SELECT 'id_unique', 'id', 'unique', n, v1 FROM a
  UNION ALL SELECT 'customer_unique', 'customer_id', 'unique', n, v2 FROM a
  UNION ALL SELECT 'items_range', 'f_items', 'range', n, v3 FROM a
  UNION ALL SELECT 'total_positive', 'f_total', 'positive', n, v4 FROM a
  UNION ALL SELECT 'target_binary', 'target', 'in_set', n, v5 FROM a
  UNION ALL SELECT 'priority_known', 'priority', 'in_set', n, v6 FROM a) r""", FS))
def e05(t):
    return Q.rule_violations(fx.feature_store(t), _RULES)


@query("e06_quality_summary", doubles=("completeness_pct", "duplicate_pct"), oracle=with_views("""
SELECT n_rows, 9 AS n_columns, (1.0 - nulls / (n_rows * 9.0)) * 100 AS completeness_pct,
       (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM feature_store_nulls
         GROUP BY ALL_COLS) g) * 100.0 / n_rows AS duplicate_pct,
       6 AS n_numeric, 1 AS n_categorical, 2 AS n_datetime
FROM (SELECT count(*)::BIGINT AS n_rows,
   count(*) FILTER (WHERE f_total IS NULL) + count(*) FILTER (WHERE f_disc IS NULL)
   + count(*) FILTER (WHERE prediction_timestamp IS NULL) + count(*) FILTER (WHERE id IS NULL)
   + count(*) FILTER (WHERE customer_id IS NULL) + count(*) FILTER (WHERE date IS NULL)
   + count(*) FILTER (WHERE f_items IS NULL) + count(*) FILTER (WHERE priority IS NULL)
   + count(*) FILTER (WHERE target IS NULL) AS nulls FROM feature_store_nulls) a""".replace(
    "ALL_COLS", "id, customer_id, date, f_total, f_items, f_disc, priority, prediction_timestamp, target"), FSN))
def e06(t):
    return Q.quality_summary(fx.feature_store_nulls(t))


def _e07_sql():
    sides = []
    for side, view in (("cur", "cur"), ("ref", "ref")):
        for c, num in (("user_id", True), ("value", True), ("event_type", False)):
            x = f"CAST({c} AS DOUBLE)" if num else "NULL::DOUBLE"
            sides.append(f"SELECT '{side}' AS side, '{c}' AS \"column\", {x} AS x, CAST({c} AS VARCHAR) AS s FROM {view}")
    long = "\nUNION ALL\n".join(sides)
    aggs = []
    for side in ("cur", "ref"):
        on = f"side = '{side}'"
        aggs.append(f"""count(*) FILTER (WHERE {on})::BIGINT AS {side}_n,
            count(*) FILTER (WHERE {on} AND s IS NULL) * 100.0 / count(*) FILTER (WHERE {on}) AS {side}_null_pct,
            count(DISTINCT CASE WHEN {on} THEN s END)::BIGINT AS {side}_distinct,
            avg(CASE WHEN {on} THEN x END) AS {side}_mean, stddev_samp(CASE WHEN {on} THEN x END) AS {side}_std,
            min(CASE WHEN {on} THEN x END) AS {side}_min, max(CASE WHEN {on} THEN x END) AS {side}_max""")
    return f"SELECT \"column\", {', '.join(aggs)} FROM ({long}) l GROUP BY \"column\""


@query("e07_quality_profile", doubles=tuple(f"{s}_{m}" for s in ("cur", "ref")
                                             for m in ("null_pct", "mean", "std", "min", "max")),
       oracle=with_views(_e07_sql(), "cur", "ref"))
def e07(t):
    ref, cur = fx.drift_frames(t)
    return Q.quality_profile(cur, ref, ["user_id", "value"], ["event_type"])


_DAYS = (("user_id", True), ("value", True), ("event_type", False))


@query("e07_daily_profile", doubles=("null_pct", "mean", "std", "min", "max"), oracle="\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count(*)::BIGINT AS n, count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_pct,
       {"avg(" + c + "::DOUBLE)" if num else "NULL::DOUBLE"} AS mean, {"stddev_samp(" + c + "::DOUBLE)" if num else "NULL::DOUBLE"} AS std,
       {"min(" + c + "::DOUBLE)" if num else "NULL::DOUBLE"} AS min, {"max(" + c + "::DOUBLE)" if num else "NULL::DOUBLE"} AS max
FROM events""" for c, num in _DAYS))
def e07_daily(t):
    """Profile of the whole period merged from states that were written day by day (its sketches: see the tests)."""
    states = Q.profile_states(t.events, F.to_date("ts"), ["user_id", "value"], ["event_type"])
    path = io.work_path(t.spark, "e07-states")
    states.write.partitionBy("day").parquet(path)
    return Q.merged_profile(t.spark.read.parquet(path), ()).drop("distinct")


@query("e07_value_changes", oracle="""
WITH l AS (SELECT ts::DATE < DATE '2024-01-16' AS old, unnest([{'c': 'user_id', 'v': user_id::VARCHAR}, {'c': 'event_type', 'v': event_type}]) AS s FROM events),
v AS (SELECT s.c AS "column", s.v AS v, bool_or(old) AS o, bool_or(NOT old) AS n FROM l GROUP BY ALL)
SELECT "column", count(*) FILTER (WHERE n AND NOT o)::BIGINT AS new_values, count(*) FILTER (WHERE o AND NOT n)::BIGINT AS vanished_values,
       count(*) FILTER (WHERE o AND n)::BIGINT AS shared_values FROM v GROUP BY "column\"""")
def e07_changes(t):
    """New, vanished and shared values of two periods from their stored sketches (exact below 16,384 values a column)."""
    states = Q.profile_states(t.events, F.to_date("ts"), ["user_id"], ["event_type"])
    old = F.col("day") < F.lit("2024-01-16").cast("date")
    return Q.profile_changes(states.where(old), states.where(~old))


@query("e08_quality_scorecard", doubles=("value", "threshold"), oracle=with_views("""
WITH a AS (SELECT
  (1.0 - (count(*) FILTER (WHERE f_total IS NULL) + count(*) FILTER (WHERE f_disc IS NULL)
          + count(*) FILTER (WHERE prediction_timestamp IS NULL)) / (count(*) * 9.0)) * 100 AS completeness,
  count(*) FILTER (WHERE f_items BETWEEN 1 AND 7) * 100.0 / count(*) AS accuracy,
  count(*) FILTER (WHERE prediction_timestamp IS NULL OR prediction_timestamp >= date) * 100.0 / count(*)
      AS consistency,
  date_diff('microsecond', max(date)::TIMESTAMP, TIMESTAMP '2001-08-02 06:00:00') / 3600000000.0 AS timeliness_hours,
  count(DISTINCT (customer_id, date)) * 100.0 / count(*) AS uniqueness
  FROM feature_store_nulls)
SELECT 'completeness' AS dimension, completeness AS value, '>=' AS op, 95.0 AS threshold,
       completeness >= 95.0 AS passed FROM a
UNION ALL SELECT 'accuracy', accuracy, '>=', 98.0, accuracy >= 98.0 FROM a
UNION ALL SELECT 'consistency', consistency, '>=', 95.0, consistency >= 95.0 FROM a
UNION ALL SELECT 'timeliness_hours', timeliness_hours, '<=', 24.0, timeliness_hours <= 24.0 FROM a
UNION ALL SELECT 'uniqueness', uniqueness, '>=', 99.0, uniqueness >= 99.0 FROM a""", FSN))
def e08(t):
    fs = fx.feature_store_nulls(t)
    return Q.scorecard(fs, F.col("f_items").between(1, 7),
                       F.col("prediction_timestamp").isNull() | (F.col("prediction_timestamp") >= F.col("date")),
                       ["customer_id", "date"], "date", "2001-08-02 06:00:00")


_CROSS = [
    Q.Rule("ship_after_order", "l_shipdate", "expr", expr="l_shipdate < o_orderdate"),
    Q.Rule("discount_fraction", "l_discount", "range", lo=0.0, hi=1.0),
    Q.Rule("tax_non_negative", "l_tax", "expr", expr="l_tax < 0"),
    Q.Rule("price_positive", "l_extendedprice", "positive"),
    Q.Rule("line_total_below_order", "l_extendedprice", "expr", expr="l_extendedprice > o_totalprice"),
]


@query("e09_cross_field_rules", doubles=("pct_violations",), oracle="""
WITH j AS (SELECT * FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
a AS (SELECT count(*) AS n,
   count(*) FILTER (WHERE l_shipdate < o_orderdate) AS v0,
   count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1) AS v1,
   count(*) FILTER (WHERE l_tax < 0) AS v2,
   count(*) FILTER (WHERE l_extendedprice <= 0) AS v3,
   count(*) FILTER (WHERE l_extendedprice > o_totalprice) AS v4 FROM j)
SELECT rule, "column", kind, n::BIGINT AS n_checked, v::BIGINT AS n_violations, v * 100.0 / n AS pct_violations,
       v = 0 AS passed FROM (
  SELECT 'ship_after_order' AS rule, 'l_shipdate' AS "column", 'expr' AS kind, n, v0 AS v FROM a
  UNION ALL SELECT 'discount_fraction', 'l_discount', 'range', n, v1 FROM a
  UNION ALL SELECT 'tax_non_negative', 'l_tax', 'expr', n, v2 FROM a
  UNION ALL SELECT 'price_positive', 'l_extendedprice', 'positive', n, v3 FROM a
  UNION ALL SELECT 'line_total_below_order', 'l_extendedprice', 'expr', n, v4 FROM a) r""")
def e09(t):
    """Cross-field and temporal consistency over line items joined with their orders."""
    j = t.lineitem.join(t.orders, t.lineitem.l_orderkey == t.orders.o_orderkey)
    return Q.rule_violations(j, _CROSS)


AS_OF_FRESH = "2024-02-01 00:00:00"


@query("e10_freshness", doubles=("lag_hours",), oracle=f"""
SELECT 'events' AS "table", CAST(max(ts) AS VARCHAR) AS max_ts,
       date_diff('microsecond', max(ts), TIMESTAMP '{AS_OF_FRESH}') / 3600000000.0 AS lag_hours FROM events
UNION ALL SELECT 'orders', CAST(max(o_orderdate) AS VARCHAR),
       date_diff('microsecond', max(o_orderdate), TIMESTAMP '{AS_OF_FRESH}') / 3600000000.0 FROM orders
UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS VARCHAR),
       date_diff('microsecond', max(l_shipdate), TIMESTAMP '{AS_OF_FRESH}') / 3600000000.0 FROM lineitem""")
def e10(t):
    return (Q.freshness(t.events, "ts", AS_OF_FRESH, "events")
            .unionByName(Q.freshness(t.orders, "o_orderdate", AS_OF_FRESH, "orders"))
            .unionByName(Q.freshness(t.lineitem, "l_shipdate", AS_OF_FRESH, "lineitem")))


@query("e11_volume_changes", doubles=("change_pct",), oracle=with_views("""
SELECT day, n, prev_n, (n - prev_n) * 100.0 / nullif(prev_n, 0) AS change_pct,
       coalesce(abs((n - prev_n) * 100.0 / nullif(prev_n, 0)) > 50, false) AS volume_alert,
       n_null, coalesce(n_null > 0 AND prev_null = 0, false) AS new_nulls
FROM (SELECT day, n, lag(n) OVER (ORDER BY day) AS prev_n, n_null, lag(n_null) OVER (ORDER BY day) AS prev_null
      FROM (SELECT date_trunc('month', date)::DATE AS day, count(*)::BIGINT AS n,
                   count(*) FILTER (WHERE f_total IS NULL)::BIGINT AS n_null
            FROM feature_store_nulls GROUP BY 1) d) w""", FSN))
def e11(t):
    """Monthly loads of the feature store: volume change and new NULLs in f_total."""
    fs = fx.feature_store_nulls(t).withColumn("load_ts", F.trunc("date", "month"))
    return Q.volume_changes(fs, "load_ts", "f_total")


@query("e12_version_diff", oracle=with_views("""
SELECT count(*) FILTER (WHERE a.o_orderkey IS NULL)::BIGINT AS n_added,
       count(*) FILTER (WHERE b.o_orderkey IS NULL)::BIGINT AS n_removed,
       count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND differs)::BIGINT AS n_changed,
       count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND NOT differs)::BIGINT AS n_unchanged
FROM (SELECT a, b, a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
             OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
             OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS differs
      FROM orders_v1 a FULL OUTER JOIN orders_v2 b ON a.o_orderkey = b.o_orderkey) j""", "orders_v1", "orders_v2"))
def e12(t):
    v1, v2 = fx.orders_versions(t)
    return Q.version_diff(v1, v2, "o_orderkey")


@query("e12_diff_by_ranges", oracle=with_views("""
SELECT count(*) FILTER (WHERE a.o_orderkey IS NULL)::BIGINT AS n_added,
       count(*) FILTER (WHERE b.o_orderkey IS NULL)::BIGINT AS n_removed,
       count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND differs)::BIGINT AS n_changed,
       count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND NOT differs)::BIGINT AS n_unchanged
FROM (SELECT a, b, a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
             OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
             OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS differs
      FROM orders_v1 a FULL OUTER JOIN orders_v2 b ON a.o_orderkey = b.o_orderkey) j""", "orders_v1", "orders_v2"))
def e12_ranges(t):
    """Diff of two versions through their digest trees: only key ranges that differ are joined."""
    v1, v2 = fx.orders_versions(t)
    return Q.version_diff_by_ranges(v1, v2, "o_orderkey")


@query("e13_representation", doubles=("dataset_share", "population_share", "ratio"), oracle="""
SELECT n.n_nationkey AS c_nationkey, coalesce(s.share, 0.0) AS dataset_share, 1.0 / 25 AS population_share,
       coalesce(s.share, 0.0) / (1.0 / 25) AS ratio,
       CASE WHEN coalesce(s.share, 0.0) / (1.0 / 25) > 1.2 THEN 'over'
            WHEN coalesce(s.share, 0.0) / (1.0 / 25) < 0.8 THEN 'under' ELSE 'fair' END AS status
FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) * 1.0 / (SELECT count(*) FROM customer) AS share
                         FROM customer GROUP BY c_nationkey) s ON s.c_nationkey = n.n_nationkey""")
def e13(t):
    pop = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.lit(1.0 / 25).alias("share"))
    return Q.representation(t.customer, "c_nationkey", pop)


@query("e14_retention", oracle="""
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '2001-08-02' - 730""")
def e14_retention(t):
    """Orders younger than the retention period of two years."""
    return Q.retention(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "2001-08-02", 730)


@query("e14_pii_protection", oracle=f"""
SELECT doc_id, len(regexp_extract_all(text, '{Q.EMAIL_RE}'))::INTEGER AS n_emails,
       len(regexp_extract_all(text, '{Q.IPV4_RE}'))::INTEGER AS n_ips,
       md5(regexp_replace(regexp_replace(text, '{Q.EMAIL_RE}', '<email>', 'g'), '{Q.IPV4_RE}', '\\1.\\2.\\3.0', 'g'))
           AS text_md5
FROM documents""")
def e14(t):
    """E-mails masked and IPv4 addresses anonymised in every document (whole texts)."""
    p = Q.protect_text(t.documents.select("doc_id", "text"), "text")
    return p.select("doc_id", "n_emails", "n_ips", F.md5("text_protected").alias("text_md5"))


@query("e14_pseudonymise", oracle=f"""
SELECT c_custkey, sha256('s3cr3t' || c_name) AS c_name, c_mktsegment FROM customer""")
def e14p(t):
    return Q.pseudonymise(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_name", "s3cr3t")


@query("e15_mondrian")
def e15_mondrian(t):
    """Orders generalised to ranges of total and items that at least ten orders share: one row per range."""
    o = fx.feature_store(t).select("id", "f_total", F.col("f_items").cast("double").alias("f_items"))
    return Q.mondrian(o, ["f_total", "f_items"], 10)[1]


@query("e15_k_anonymity", oracle="""
SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n FROM customer
GROUP BY c_nationkey, c_mktsegment HAVING count(*) < 10""")
def e15(t):
    return Q.k_anonymity(t.customer, ["c_nationkey", "c_mktsegment"], 10)
