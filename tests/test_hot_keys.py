"""Operators that used to run one window per entity / query / series now run over range
slices or collapsed cells.  Each is compared with the plain single-window form on frames
where one key holds most rows, with ties, NULL runs and NULL keys."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions.ranks import ordered_previous
from vigil.operators import evaluation as V
from vigil.operators import features as H
from vigil.streaming import telemetry as S


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_forward_fill_equals_window_with_hot_entity_and_null_runs(spark):
    rows = []
    for i in range(60):
        ent = "hot" if i < 45 else ("b" if i % 2 else None)
        v = None if (i % 7 in (1, 2, 3, 4) or i < 3) else float(i)
        rows.append((i, ent, dt.date(2024, 1, 1) + dt.timedelta(days=i // 4), v))
    df = spark.createDataFrame(rows, "id long, e string, d date, v double")
    got = H.forward_fill(df, ["v"], "e", ["d", "id"])
    w = Window.partitionBy("e").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("v", F.last("v", ignorenulls=True).over(w))
    assert rows_of(got, ["id", "e", "d", "v"]) == rows_of(exp, ["id", "e", "d", "v"])


def test_rolling_point_in_time_equals_range_window(spark):
    rows = []
    for i in range(80):
        c = 1 if i < 60 else 2
        day = None if i == 5 else dt.date(2024, 1, 1) + dt.timedelta(days=(i * 3) // 2)
        rows.append((i, c, day, float(i % 9)))
    tx = spark.createDataFrame(rows, "k long, c long, d date, a double")
    got = H.rolling_point_in_time(tx, "c", "d", "a", "k", 30)
    dn = F.datediff("d", F.lit("1970-01-01").cast("date"))
    x = tx.withColumn("_dn", dn)
    w = Window.partitionBy("c").orderBy("_dn").rangeBetween(-29, 0)
    wl = Window.partitionBy("c").orderBy("_dn", "d", "k")
    exp = x.select("k", "c", "d", "a", F.sum("a").over(w).alias("amount_30d"), F.count("*").over(w).alias("n_30d"),
                   (F.col("_dn") - F.lag("_dn").over(wl)).alias("days_since_last"))
    cols = ["k", "c", "d", "a", "amount_30d", "n_30d", "days_since_last"]
    assert rows_of(got, cols) == rows_of(exp, cols)


def test_ranking_metrics_on_hot_query_with_score_ties(spark):
    rows = [("hot" if i < 70 else f"q{i % 4}", i, float((i * 7) % 5) / 5, int(i % 3 == 0)) for i in range(90)]
    rows += [("none", 1000 + i, 0.5, 0) for i in range(4)]  # a query without relevant items
    df = spark.createDataFrame(rows, "q string, item long, s double, rel int")
    got = V.ranking_metrics(df, "q", "item", "s", "rel", 10).collect()[0]
    # brute force in Python: rank by (score desc, item)
    by_q = {}
    for q, item, s, rel in rows:
        by_q.setdefault(q, []).append((-s, item, rel))
    import math
    nd, ap, rr = [], [], []
    for items in by_q.values():
        items.sort()
        rels = [r for _, _, r in items]
        dcg = sum((2 ** r - 1) / math.log2(i + 2) for i, r in enumerate(rels[:10]))
        idcg = sum((2 ** r - 1) / math.log2(i + 2) for i, r in enumerate(sorted(rels, reverse=True)[:10]))
        if idcg:
            nd.append(dcg / idcg)
        hits, s_ap, first = 0, 0.0, None
        for i, r in enumerate(rels, 1):
            if r > 0:
                hits += 1
                s_ap += hits / i
                first = first or i
        ap.append(s_ap / hits if hits else 0.0)
        rr.append(1.0 / first if first else 0.0)
    assert abs(got["ndcg_at_10"] - sum(nd) / len(nd)) < 1e-12
    assert abs(got["map"] - sum(ap) / len(ap)) < 1e-12
    assert abs(got["mrr"] - sum(rr) / len(rr)) < 1e-12
    assert got["n_queries"] == len(by_q)


def test_ordered_previous_equals_lag(spark):
    rows = [("hot" if i % 5 else "x", i, (i * 13) % 7) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = ordered_previous(df, ["g"], [F.col("v"), F.col("k")], ["k"], partitions=6)
    w = Window.partitionBy("g").orderBy("v", "k")
    exp = df.select("g", "k", F.lag("k").over(w).alias("prev_k"), F.row_number().over(w).alias("pos"))
    assert rows_of(got, ["g", "k", "prev_k", "pos"]) == rows_of(exp, ["g", "k", "prev_k", "pos"])


def test_counter_rate_counts_events_per_hour(spark):
    """A daily-restarting counter's increase per hour equals the events in that hour (the first
    sample of a series contributes 0)."""
    base = dt.datetime(2024, 3, 1, 22, 0)
    rows = [("a" if i % 4 else "b", base + dt.timedelta(minutes=7 * i), i) for i in range(60)]
    log = spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, event_id long")
    got = {(r["name"], r["hour"]): r["increase"] for r in S.rate_1h(S.counter_series(log)).collect()}
    exp = {}
    first = {}
    for name, ts, eid in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        h = ts.replace(minute=0, second=0, microsecond=0)
        exp[(name, h)] = exp.get((name, h), 0) + (0 if name not in first else 1)
        first.setdefault(name, eid)
    assert got == exp


def test_label_encode_equals_window_numbering(spark):
    vals = ["a"] * 30 + ["b"] * 5 + ["c"] * 5 + ["d"] * 12 + [None] * 3 + [f"z{i}" for i in range(20)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, lv string")
    enc, levels = H.label_encode(df, "lv")
    w = Window.orderBy(F.col("freq").desc(), F.col("lv"))
    exp = (df.where(F.col("lv").isNotNull()).groupBy("lv").agg(F.count("*").alias("freq"))
           .select("lv", (F.row_number().over(w) - 1).cast("double").alias("lv_index")))
    assert rows_of(levels, ["lv", "lv_index"]) == rows_of(exp, ["lv", "lv_index"])
    got = {r["id"]: r["lv_index"] for r in enc.collect()}
    idx = {r["lv"]: r["lv_index"] for r in exp.collect()}
    assert got == {i: idx.get(v) for i, v in enumerate(vals)}


def test_ordered_last_non_null_carries_across_slices(spark):
    from vigil.functions.ranks import ordered_last_non_null
    rows = [("hot" if i % 6 else None, i, None if (i // 5) % 3 else float(i), None if i % 4 else f"s{i}")
            for i in range(70)]
    df = spark.createDataFrame(rows, "e string, k long, v double, t string")
    w = Window.partitionBy("e").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    exp = rows_of(df.select("e", "k", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("v", "t")]),
                  ["e", "k", "v", "t"])
    for parts in (1, 3, 7):
        got = ordered_last_non_null(df, ["e"], [F.col("k")], ["v", "t"], partitions=parts)
        assert got.columns == df.columns
        assert rows_of(got, ["e", "k", "v", "t"]) == exp


def test_tfidf_terms_hand_computed(spark):
    import math
    docs = spark.createDataFrame([(1, "The cat, the HAT!"), (2, "a cat sat"), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): (r["tf"], r["df"], r["tfidf"])
           for r in H.tfidf_terms(docs, "doc_id", "text").collect()}
    idf = lambda df: math.log((3 + 1) / (df + 1))
    exp = {(1, "the"): (2, 1, 2 * idf(1)), (1, "cat"): (1, 2, idf(2)), (1, "hat"): (1, 1, idf(1)),
           (2, "cat"): (1, 2, idf(2)), (2, "sat"): (1, 1, idf(1))}  # "a" is shorter than 2
    assert got.keys() == exp.keys()
    for k, (tf, df, v) in exp.items():
        assert got[k][:2] == (tf, df) and abs(got[k][2] - v) < 1e-12
