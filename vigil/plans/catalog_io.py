"""Catalog: sources and sinks (a01-a12).

Write-side operators are checked by read-back: each query writes into a
fresh folder under the shared checkpoint folder and returns the re-read data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.operators import business as B
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources import io
from vigil.sources.fixture_sql import with_views

_FS_DOUBLES = ("f_total", "f_disc")


@query("a01_scan_parquet", doubles=("l_extendedprice", "l_discount"), oracle="""
SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_discount > 0.05""")
def a01(t):
    """Projected, filtered scan: both reach the parquet reader (ReadSchema / PushedFilters)."""
    li = io.read_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet")
    return (li.where((F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
                     & (F.col("l_discount") > 0.05))
            .select("l_orderkey", "l_extendedprice", "l_discount"))


@query("a02_write_parquet", doubles=_FS_DOUBLES, oracle=with_views("SELECT * FROM feature_store", "feature_store"))
def a02(t):
    path = io.write_parquet(fx.feature_store(t), io.work_path(t.spark, "a02"), partition_by=None)
    return t.spark.read.parquet(path)


@query("a03_list_files")
def a03(t):
    """Every parquet data file under the table folder with its size (no content read)."""
    return io.list_files(t.spark, t.sf_dir, ".parquet").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


_A04_SQL = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_discount) AS avg_disc,
       count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus"""


@query("a04_lake_sql", doubles=("sum_qty", "sum_disc_price", "avg_disc"), oracle=_A04_SQL.replace(
    "count(*) AS count_order", "count(*)::BIGINT AS count_order"))
def a04(t):
    """SQL text over catalog views of the lake tables."""
    io.register_tables(t.spark, {"lineitem": t.lineitem})
    return io.lake_query(t.spark, _A04_SQL)


_FS_SCHEMA = {"id": "BIGINT", "customer_id": "BIGINT", "f_total": "DOUBLE", "f_items": "BIGINT",
              "f_disc": "DOUBLE", "priority": "STRING", "prediction_timestamp": "TIMESTAMP_NTZ",
              "target": "INT", "date": "DATE", "month": "STRING"}
_FS_COLS = [c for c in _FS_SCHEMA if c != "month"]


def _with_month(df):
    return df.withColumn("month", F.date_format("date", "yyyy-MM"))


def _feature_table(t, tag: str) -> str:
    name = f"vigil_{tag}_{uuid.uuid4().hex[:10]}"
    io.create_feature_table(t.spark, name, _FS_SCHEMA, partitions=["month"],
                            location=io.work_path(t.spark, name))
    return name


@query("a05_create_feature_table", doubles=_FS_DOUBLES, oracle=with_views("""
SELECT id, customer_id, f_total, f_items, f_disc, priority, prediction_timestamp, target, date
FROM feature_store""", "feature_store"))
def a05(t):
    """CREATE TABLE IF NOT EXISTS ... PARTITIONED BY (month) LOCATION ..., filled, read back."""
    name = _feature_table(t, "a05")
    io.write_features(_with_month(fx.feature_store(t)), name)
    return t.spark.table(name).select(*_FS_COLS)


@query("a06_write_features_modes", doubles=_FS_DOUBLES, oracle=with_views("""
SELECT id, customer_id, f_total, f_items, f_disc, priority, prediction_timestamp, target, date
FROM feature_store""", "feature_store"))
def a06(t):
    """overwrite with the training slice, then append the later rows: the table equals the store."""
    name = _feature_table(t, "a06")
    io.write_features(_with_month(fx.train_rows(t)), name, mode="overwrite")
    io.write_features(_with_month(fx.test_rows(t)), name, mode="append")
    return t.spark.table(name).select(*_FS_COLS)


@query("a07_read_features_where", doubles=("f_total",), oracle=with_views("""
SELECT id, f_total, f_items FROM feature_store
WHERE target = 1 AND f_items > 3 AND date >= DATE '1999-01-01'""", "feature_store"))
def a07(t):
    name = _feature_table(t, "a07")
    io.write_features(_with_month(fx.feature_store(t)), name)
    return io.read_features(t.spark, name, "target = 1 AND f_items > 3 AND month >= '1999-01' "
                            "AND date >= DATE'1999-01-01'",
                            ["id", "f_total", "f_items"])


@query("a08_csv_scan", doubles=("c_acctbal",), oracle="SELECT * FROM customer")
def a08(t):
    path = io.work_path(t.spark, "a08")
    t.customer.write.option("header", "true").csv(path)
    return io.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("a10_layer_promotion", doubles=("revenue", "avg_order_value"), oracle="""
SELECT n.n_name, year(o.o_orderdate)::INTEGER AS year, count(*)::BIGINT AS n_orders,
       sum(o.o_totalprice) AS revenue, avg(o.o_totalprice) AS avg_order_value,
       count(DISTINCT o.o_custkey)::BIGINT AS n_customers
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_totalprice > 0 GROUP BY n.n_name, year(o.o_orderdate)""")
def a10(t):
    """bronze (two extractions, appended) -> silver (cast, normalise, dedup, filter, join) -> gold."""
    bronze = io.work_path(t.spark, "bronze")
    io.promote_bronze(t.orders, bronze, "2024-01-01")
    io.promote_bronze(t.orders, bronze, "2024-01-02")  # re-extraction: dedup keeps the latest
    silver = io.promote_silver(t.spark.read.parquet(bronze), t.customer, t.nation)
    gold = io.promote_gold(silver, io.work_path(t.spark, "gold"))
    return t.spark.read.parquet(gold).select("n_name", F.col("year").cast("int").alias("year"),
                                             "n_orders", "revenue", "avg_order_value", "n_customers")


def _escaped(column: str) -> str:
    return f"replace(replace({column}, '\\', '\\\\'), '|', '\\|')"


def _fp_sql(view: str, tag: str) -> str:
    row = ("concat_ws('|', coalesce(cast(o_orderkey AS VARCHAR), '\\N'), coalesce(cast(o_custkey AS VARCHAR), '\\N'), "
           f"coalesce({_escaped('o_orderstatus')}, '\\N'), coalesce(cast(cast(o_totalprice AS DECIMAL(38,6)) AS VARCHAR), '\\N'), "
           f"coalesce(cast(o_orderdate AS VARCHAR), '\\N'), coalesce({_escaped('o_orderpriority')}, '\\N'))")
    h = f"('0x' || substr(md5({row}), 1, 8))::BIGINT"
    return f"""SELECT '{tag}' AS version, n_rows, cast(s AS VARCHAR) AS content_sum,
       substr(md5(cast(n_rows AS VARCHAR) || ':' || cast(s AS VARCHAR)), 1, 8) AS fingerprint
FROM (SELECT count(*)::BIGINT AS n_rows, coalesce(sum({h}), 0)::DECIMAL(38,0) AS s FROM {view}) a"""


@query("a11_snapshot_fingerprint", oracle=with_views(
    _fp_sql("orders_v1", "v1") + "\nUNION ALL\n" + _fp_sql("orders_v2", "v2"), "orders_v1", "orders_v2"))
def a11(t):
    v1, v2 = fx.orders_versions(t)
    return (io.fingerprint(v1).select(F.lit("v1").alias("version"), "*")
            .unionByName(io.fingerprint(v2).select(F.lit("v2").alias("version"), "*")))


@query("a12_json_report", doubles=("value",), oracle=with_views("""
SELECT 'revenue_impact' AS metric, rev AS value, 'BRL' AS unit FROM r
UNION ALL SELECT 'cost_reduction', n * 50.0 - n * 10.0, 'BRL' FROM n
UNION ALL SELECT 'roi', (rev - 105000.0) / 105000.0 * 100, 'percentage' FROM r""",
    "predictions", "actuals", ctes=[
        ("c", """SELECT count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS tp,
                        count(*) FILTER (WHERE prediction = 1 AND actual = 0) AS fp,
                        count(*) FILTER (WHERE prediction = 0 AND actual = 1) AS fn
                 FROM predictions JOIN actuals USING (customer_id)"""),
        ("n", "SELECT count(*) AS n FROM predictions"),
        ("r", "SELECT tp * 1000.0 - fp * 100.0 - fn * 2000.0 AS rev FROM c")]))
def a12(t):
    """Metric rows -> JSON documents -> written -> read back with the metric schema."""
    path = io.write_json_report(B.combined_run(fx.predictions(t), fx.actuals(t)), io.work_path(t.spark, "a12"))
    return t.spark.read.schema("metric string, value double, unit string").json(path)



