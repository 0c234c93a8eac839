"""Catalog: feature preparation and splits (h01-h23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import features as H
from vigil.operators.profile import correlation_matrix
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources.fixture_sql import md5u, with_views

FS, FSN = "feature_store", "feature_store_nulls"
NUM = ["f_total", "f_items", "f_disc"]
U = md5u("id")


@query("h01_mean_impute", doubles=("f_total", "f_disc"), oracle=with_views(f"""
SELECT id, coalesce(f_total, (SELECT avg(f_total) FROM feature_store_nulls WHERE date <= DATE '1999-12-31'))
           AS f_total,
       coalesce(f_disc, (SELECT avg(f_disc) FROM feature_store_nulls WHERE date <= DATE '1999-12-31')) AS f_disc
FROM feature_store_nulls""", FSN))
def h01(t):
    """Mean imputation with means fitted on the training period only (no leakage)."""
    fs = fx.feature_store_nulls(t)
    train = fs.where(F.col("date") <= F.lit("1999-12-31").cast("date"))
    return H.mean_impute(fs, ["f_total", "f_disc"], fit_on=train).select("id", "f_total", "f_disc")


def _pos_sql(part: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return (f"row_number() OVER ({p}ORDER BY {U}, id) AS pos, count(*) OVER ({'PARTITION BY ' + part if part else ''}) AS n")


@query("h02_stratified_holdout", oracle=with_views(f"""
SELECT id, target, CASE WHEN pos <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT id, target, {_pos_sql('target')} FROM feature_store) p""", FS))
def h02(t):
    return H.stratified_holdout(fx.feature_store(t).select("id", "target"), "id", "target", 0.2, 42)


@query("h03_random_holdout", oracle=with_views(f"""
SELECT id, target, CASE WHEN pos <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT id, target, {_pos_sql('')} FROM feature_store) p""", FS))
def h03(t):
    return H.stratified_holdout(fx.feature_store(t).select("id", "target"), "id", None, 0.2, 42)


@query("h04_three_way_split", oracle=with_views(f"""
SELECT id, target, CASE WHEN pos <= round(n * 0.7) THEN 'train' WHEN pos <= round(n * 0.85) THEN 'validation'
                        ELSE 'test' END AS split
FROM (SELECT id, target, {_pos_sql('target')} FROM feature_store) p""", FS))
def h04(t):
    return H.three_way_split(fx.feature_store(t).select("id", "target"), "id", (0.7, 0.15, 0.15), "target")


@query("h05_temporal_split", oracle=with_views("""
SELECT id, date, CASE WHEN date <= DATE '1999-12-31' THEN 'train' WHEN date <= DATE '2000-12-31' THEN 'validation'
                      ELSE 'test' END AS split FROM feature_store""", FS))
def h05(t):
    return H.temporal_split(fx.feature_store(t).select("id", "date"), "date", fx.SPLIT_DATE, fx.SPLIT_DATE_2)


@query("h06_time_series_folds", oracle=with_views("""
WITH d AS (SELECT date AS day, count(*) AS n FROM feature_store GROUP BY date),
s AS (SELECT day, n, least(floor(coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                           / floor((SELECT sum(n) FROM d) / 6)), 5)::INTEGER AS segment FROM d),
f AS (SELECT fold, CASE WHEN segment < fold THEN 'train' WHEN segment = fold THEN 'test' END AS role, day, n
      FROM s, range(1, 6) r(fold))
SELECT fold::INTEGER AS fold, role, sum(n)::BIGINT AS n_rows, min(day) AS first_day, max(day) AS last_day
FROM f WHERE role IS NOT NULL GROUP BY fold, role""", FS))
def h06(t):
    """Five expanding time-series folds (day granularity), summarised per fold and role."""
    seg = H.time_series_folds(fx.feature_store(t), "date", 5)
    return (H.fold_roles(seg, 5).groupBy("fold", "role")
            .agg(F.sum("n").cast("long").alias("n_rows"), F.min("day").alias("first_day"),
                 F.max("day").alias("last_day")))


@query("h07_stratified_kfold", oracle=with_views(f"""
SELECT id, target, ((pos - 1) % 5)::INTEGER AS fold
FROM (SELECT id, target, {_pos_sql('target')} FROM feature_store) p""", FS))
def h07(t):
    return H.stratified_kfold(fx.feature_store(t).select("id", "target"), "id", "target", 5)


AS_OF = "2001-08-01"


@query("h08_rfm", doubles=("monetary", "amount_30d", "amount_60d", "amount_90d"), oracle="""
SELECT o_custkey, date_diff('day', max(o_orderdate::DATE), DATE '2001-08-01')::INTEGER AS recency_days,
       count(*)::BIGINT AS frequency, sum(o_totalprice) AS monetary,
       count(*) FILTER (WHERE o_orderdate::DATE > DATE '2001-08-01' - 30)::BIGINT AS n_30d,
       coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate::DATE > DATE '2001-08-01' - 30), 0.0) AS amount_30d,
       count(*) FILTER (WHERE o_orderdate::DATE > DATE '2001-08-01' - 60)::BIGINT AS n_60d,
       coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate::DATE > DATE '2001-08-01' - 60), 0.0) AS amount_60d,
       count(*) FILTER (WHERE o_orderdate::DATE > DATE '2001-08-01' - 90)::BIGINT AS n_90d,
       coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate::DATE > DATE '2001-08-01' - 90), 0.0) AS amount_90d
FROM orders WHERE o_orderdate::DATE <= DATE '2001-08-01' GROUP BY o_custkey""")
def h08(t):
    """Recency / frequency / monetary plus 30/60/90-day windows per customer (h09 as-of form)."""
    return H.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice", AS_OF)


@query("h09_rolling_point_in_time", doubles=("o_totalprice", "amount_30d"), oracle="""
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
       sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY dn RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)
           AS amount_30d,
       count(*) OVER (PARTITION BY o_custkey ORDER BY dn RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS n_30d,
       (dn - lag(dn) OVER (PARTITION BY o_custkey ORDER BY dn, o_orderdate, o_orderkey))::INTEGER AS days_since_last
FROM (SELECT *, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS dn FROM orders) o""")
def h09(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return H.rolling_point_in_time(o, "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey", 30)


@query("h10_calendar_parts", oracle="""
SELECT o_orderkey, dayofweek(o_orderdate)::INTEGER + 1 AS o_orderdate_weekday, month(o_orderdate)::INTEGER AS o_orderdate_month,
       quarter(o_orderdate)::INTEGER AS o_orderdate_quarter, year(o_orderdate)::INTEGER AS o_orderdate_year FROM orders""")
def h10(t):
    return H.calendar_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("h11_fixed_bands", doubles=("o_totalprice", "o_totalprice_band"), oracle="""
SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 100000 THEN 0.0 WHEN o_totalprice < 200000 THEN 1.0
       WHEN o_totalprice < 300000 THEN 2.0 WHEN o_totalprice < 400000 THEN 3.0 ELSE 4.0 END AS o_totalprice_band
FROM orders""")
def h11(t):
    return H.fixed_bands(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice",
                         [100000.0, 200000.0, 300000.0, 400000.0])


@query("h11_quartile_bins", doubles=("f_total",), oracle=with_views("""
SELECT id, f_total, CASE WHEN f_total IS NULL THEN NULL ELSE
   1 + (f_total >= q[1])::INTEGER + (f_total >= q[2])::INTEGER + (f_total >= q[3])::INTEGER END AS f_total_q4
FROM feature_store_nulls, (SELECT quantile_cont(f_total, [0.25, 0.5, 0.75]) AS q FROM feature_store_nulls) c""", FSN))
def h11q(t):
    return H.quantile_bins(fx.feature_store_nulls(t).select("id", "f_total"), "f_total", 4)


@query("h12_ratio_features", doubles=("l_extendedprice_x_l_quantity", "l_extendedprice_per_l_quantity",
                                      "l_tax_x_l_discount", "l_tax_per_l_discount"), oracle="""
SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity AS l_extendedprice_x_l_quantity,
       l_extendedprice / nullif(l_quantity, 0) AS l_extendedprice_per_l_quantity,
       l_tax * l_discount AS l_tax_x_l_discount, l_tax / nullif(l_discount, 0) AS l_tax_per_l_discount
FROM lineitem""")
def h12(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    return H.ratio_features(li, [("l_extendedprice", "l_quantity"), ("l_tax", "l_discount")]).drop(
        "l_extendedprice", "l_quantity", "l_tax", "l_discount")


_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("h13_label_one_hot", doubles=("o_orderpriority_index",), oracle="""
SELECT o_orderkey, o.o_orderpriority, l.idx AS o_orderpriority_index, """ + ", ".join(
    f"(o.o_orderpriority = '{lv}')::INTEGER AS \"o_orderpriority_is_{lv}\"" for lv in _PRI) + """
FROM orders o LEFT JOIN (SELECT o_orderpriority, (row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1)::DOUBLE
                         AS idx FROM orders GROUP BY o_orderpriority) l USING (o_orderpriority)""")
def h13(t):
    enc, _ = H.label_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return H.one_hot(enc, "o_orderpriority", _PRI)


@query("h14_target_encoding_oof", doubles=("customer_id_te",), oracle=with_views(f"""
WITH k AS (SELECT id, customer_id, target, ((pos - 1) % 5)::INTEGER AS fold
           FROM (SELECT id, customer_id, target, {_pos_sql('target')} FROM feature_store) p),
prior AS (SELECT avg(target) AS pr FROM feature_store),
per AS (SELECT customer_id, fold, sum(target) AS sf, count(target) AS cf FROM k GROUP BY ALL),
lv AS (SELECT customer_id, sum(sf) AS s, sum(cf) AS c FROM per GROUP BY ALL),
oof AS (SELECT per.customer_id, fold, coalesce((s - sf + 10.0 * pr) / nullif(c - cf + 10.0, 0), pr) AS customer_id_te
        FROM per JOIN lv USING (customer_id), prior)
SELECT k.id, k.customer_id, k.fold, oof.customer_id_te FROM k LEFT JOIN oof USING (customer_id, fold)""", FS))
def h14(t):
    """Out-of-fold smoothed target encoding of the high-cardinality customer id (folds from h07)."""
    folds = H.stratified_kfold(fx.feature_store(t).select("id", "customer_id", "target"), "id", "target", 5)
    enc = H.target_encode(folds, "customer_id", "target", smoothing=10.0, fold_col="fold")
    return enc.select("id", "customer_id", "fold", "customer_id_te")


def _scale_sql(method: str) -> str:
    if method == "standard":
        e = {c: f"({c} - (SELECT avg({c}) FROM feature_store)) / nullif((SELECT stddev_samp({c}) FROM feature_store), 0)"
             for c in NUM}
    elif method == "minmax":
        e = {c: f"({c} - (SELECT min({c}) FROM feature_store)) / nullif((SELECT max({c}) - min({c}) FROM feature_store), 0)"
             for c in NUM}
    else:
        e = {c: f"({c} - (SELECT quantile_cont({c}, 0.5) FROM feature_store)) / nullif((SELECT quantile_cont({c}, 0.75) "
                f"- quantile_cont({c}, 0.25) FROM feature_store), 0)" for c in NUM}
    return with_views("SELECT id, " + ", ".join(f"{v} AS {c}" for c, v in e.items()) + " FROM feature_store", FS)


for _m in ("standard", "minmax", "robust"):
    def _mk(m):
        @query(f"h15_{m}_scaling", doubles=tuple(NUM), oracle=_scale_sql(m))
        def h15(t):
            return H.scale(fx.feature_store(t).select("id", *NUM), NUM, m)
        return h15
    _mk(_m)


@query("h16_missing_indicators", oracle=with_views("""
SELECT id, (f_total IS NULL)::INTEGER AS f_total_missing, (f_disc IS NULL)::INTEGER AS f_disc_missing,
       (prediction_timestamp IS NULL)::INTEGER AS prediction_timestamp_missing FROM feature_store_nulls""", FSN))
def h16(t):
    cols = ["f_total", "f_disc", "prediction_timestamp"]
    return H.missing_indicators(fx.feature_store_nulls(t).select("id", *cols), cols).drop(*cols)


@query("h17_iqr_clip", doubles=("f_total", "f_disc"), oracle=with_views("""
SELECT id, least(greatest(f_total, q1t - 1.5 * (q3t - q1t)), q3t + 1.5 * (q3t - q1t)) AS f_total,
       least(greatest(f_disc, q1d - 1.5 * (q3d - q1d)), q3d + 1.5 * (q3d - q1d)) AS f_disc
FROM feature_store_nulls, (SELECT quantile_cont(f_total, 0.25) AS q1t, quantile_cont(f_total, 0.75) AS q3t,
        quantile_cont(f_disc, 0.25) AS q1d, quantile_cont(f_disc, 0.75) AS q3d FROM feature_store_nulls) q""", FSN))
def h17(t):
    return H.iqr_clip(fx.feature_store_nulls(t).select("id", "f_total", "f_disc"), ["f_total", "f_disc"])


@query("h17_zscore_filter", doubles=("l_extendedprice", "l_quantity"), oracle="""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem, (SELECT avg(l_extendedprice) AS m1,
   stddev_samp(l_extendedprice) AS s1, avg(l_quantity) AS m2, stddev_samp(l_quantity) AS s2 FROM lineitem) s
WHERE coalesce(abs((l_extendedprice - m1) / nullif(s1, 0)) <= 2.0, true)
  AND coalesce(abs((l_quantity - m2) / nullif(s2, 0)) <= 2.0, true)""")
def h17z(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return H.zscore_filter(li, ["l_extendedprice", "l_quantity"], 2.0)


def _cat_nulls(t):
    return fx.feature_store_nulls(t).withColumn(
        "priority", F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("priority")))


_CATN = "SELECT *, CASE WHEN id % 13 = 0 THEN NULL ELSE priority END AS pri FROM feature_store_nulls"


@query("h18_fill_mode", oracle=with_views("""
SELECT id, coalesce(pri, (SELECT arg_min(pri, (-n, pri)) FROM (SELECT pri, count(*) AS n FROM c WHERE pri IS NOT NULL
       GROUP BY pri) x)) AS priority FROM c""", FSN, ctes=[("c", _CATN)]))
def h18(t):
    return H.fill_categorical(_cat_nulls(t).select("id", "priority"), ["priority"], "mode")


@query("h18_fill_median", doubles=("f_total", "f_disc"), oracle=with_views("""
SELECT id, coalesce(f_total, (SELECT median(f_total) FROM feature_store_nulls)) AS f_total,
       coalesce(f_disc, (SELECT median(f_disc) FROM feature_store_nulls)) AS f_disc FROM feature_store_nulls""", FSN))
def h18m(t):
    return H.fill_numeric_median(fx.feature_store_nulls(t).select("id", "f_total", "f_disc"), ["f_total", "f_disc"])


@query("h18_forward_fill", doubles=("f_total",), oracle=with_views("""
SELECT id, customer_id, date, last_value(f_total IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY date, id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_total FROM feature_store_nulls""", FSN))
def h18f(t):
    fs = fx.feature_store_nulls(t).select("id", "customer_id", "date", "f_total")
    return H.forward_fill(fs, ["f_total"], "customer_id", ["date", "id"])


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_gross"]


@query("h19_correlated_drop", doubles=("abs_r",), oracle="""
WITH li AS (SELECT *, l_extendedprice * (1 + l_tax) AS l_gross FROM lineitem),
c AS (""" + "\nUNION ALL\n".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM li"
                                  for i, a in enumerate(_LI) for b in _LI[i + 1:]) + """)
SELECT CASE WHEN feature_a < feature_b THEN feature_b ELSE feature_a END AS "drop",
       min(CASE WHEN feature_a < feature_b THEN feature_a ELSE feature_b END) AS because_of, max(abs(r)) AS abs_r
FROM c WHERE abs(r) > 0.95 GROUP BY 1""")
def h19(t):
    """Drop one feature of each pair with |r| > 0.95 (gross price is near-collinear with price)."""
    li = t.lineitem.withColumn("l_gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return H.correlated_drop_list(correlation_matrix(li, _LI), 0.95)


@query("h20_log_skewed", doubles=("skewness",), oracle=with_views(
    "\nUNION ALL\n".join(f"""SELECT '{c}' AS feature, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0))
       AS skewness, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) > 1.0 AS transformed
       FROM feature_store""" for c in NUM), FS))
def h20(t):
    return H.log_skewed(fx.feature_store(t), NUM, 1.0)[1]


@query("h21_class_weights", doubles=("weight",), oracle=with_views("""
SELECT target, count(*)::BIGINT AS n_class, (SELECT count(*) FROM feature_store) * 1.0
       / ((SELECT count(DISTINCT target) FROM feature_store) * count(*)) AS weight FROM feature_store GROUP BY target""", FS))
def h21(t):
    return H.class_weights(fx.feature_store(t), "target")


@query("h21_undersample", oracle=with_views(f"""
SELECT f.id, f.target FROM feature_store f JOIN (SELECT target, count(*) AS nc FROM feature_store GROUP BY target) c
USING (target) WHERE {md5u('f.id')} < (SELECT min(nc) FROM (SELECT count(*) AS nc FROM feature_store GROUP BY target) m)
      * 1.0 / c.nc""", FS))
def h21u(t):
    return H.undersample(fx.feature_store(t).select("id", "target"), "id", "target")


@query("h21_reweighing", doubles=("weight",), oracle=with_views("""
SELECT lang, y_true, n_cell, n_group * n_label / (n * n_cell) AS weight FROM (
  SELECT lang, y_true, count(*)::BIGINT AS n_cell, sum(count(*)) OVER (PARTITION BY lang)::DOUBLE AS n_group,
         sum(count(*)) OVER (PARTITION BY y_true)::DOUBLE AS n_label, sum(count(*)) OVER ()::DOUBLE AS n
  FROM scored_biased GROUP BY lang, y_true) c""", "scored_biased"))
def h21r(t):
    """Weights under which the label does not depend on the language."""
    return H.reweighing(fx.scored_biased(t), "lang", "y_true")


@query("h22_silver_normalise", doubles=("c_acctbal",), oracle="""
SELECT c_custkey, c_name, c_nationkey, TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS c_acctbal,
       lower(trim(c_mktsegment)) AS c_mktsegment FROM customer""")
def h22(t):
    return H.silver_normalise(t.customer, {"c_acctbal": "double"}, ["c_mktsegment"], [])


@query("h23_tfidf")
def h23(t):
    """TF-IDF over every document (whole texts); rows-only check (MLlib hashing)."""
    tf = H.tfidf(t.documents.select("doc_id", "text"), "text", 1 << 18)
    values = F.unwrap_udt("tfidf")["values"]              # of the sparse vector: the document's own terms
    return tf.select("doc_id", F.size(F.filter(values, lambda x: x != 0)).alias("n_terms"),
                     F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("tfidf_sum"))


@query("h23_tfidf_terms", doubles=("tfidf_sum", "tfidf_max"), oracle="""
WITH w AS (SELECT doc_id, lower(w) AS term
           FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS w FROM documents)
           WHERE length(w) >= 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
t AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * ln(((SELECT count(*) FROM documents) + 1) / (df.df + 1)) AS tfidf
      FROM tf JOIN df USING (term))
SELECT doc_id, count(*)::BIGINT AS n_terms, sum(tf)::BIGINT AS n_tokens, sum(tfidf) AS tfidf_sum,
       max(tfidf) AS tfidf_max FROM t GROUP BY doc_id""")
def h23x(t):
    """Exact TF-IDF over every document (whole texts), summarised per document."""
    x = H.tfidf_terms(t.documents.select("doc_id", "text"), "doc_id", "text")
    return x.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"),
                                   F.sum("tfidf").alias("tfidf_sum"), F.max("tfidf").alias("tfidf_max"))
