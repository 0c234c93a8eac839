"""Mitigations reach what they promise: equal odds, equal weights, groups of k rows."""

import random

from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from vigil.operators import fairness as L
from vigil.operators import features as H
from vigil.operators import quality as Q
from vigil.sources import fixtures as fx
from vigil.sources.tables import Tables


def biased(spark, n=40_000):
    """Scores of group b are lower and noisier for its positives; group c has one label only; NULL is a group."""
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10_000)) / 10_000.0)
    g = F.when(F.col("id") % 10 < 5, "a").when(F.col("id") % 10 < 8, "b").when(F.col("id") % 10 < 9, F.lit(None).cast("string")).otherwise("c")
    r = spark.range(n).withColumn("g", g).withColumn("y", F.when(F.col("g") == "c", 1).otherwise((u(1) < 0.4).cast("int")))
    return r.withColumn("p", 0.6 * u(2) + F.when(F.col("y") == 1, F.when(F.col("g") == "b", 0.12).otherwise(0.35)).otherwise(0.0))


def test_odds_are_equal_after_mitigation(spark):
    df = biased(spark)
    rates = lambda d, c: {r["g"]: (r["t"], r["f"]) for r in d.where("g IS NULL OR g <> 'c'").groupBy("g").agg(
        F.avg(F.when(F.col("y") == 1, F.col(c))).alias("t"), F.avg(F.when(F.col("y") == 0, F.col(c))).alias("f")).collect()}
    before = rates(df.withColumn("d", (F.col("p") >= 0.45).cast("int")), "d")
    assert max(t for t, _ in before.values()) - min(t for t, _ in before.values()) > 0.25
    table = L.equalised_odds(df, "g", "y", "p")
    plan = {r["group"]: r for r in table.collect()}
    assert set(plan) == {"a", "b", None}
    out = L.equalised_predictions(df, table, "g", "id", "p")
    assert out.where("g = 'c' AND y_fair IS NOT NULL").count() == 0 and out.columns == [*df.columns, "y_fair"]
    after = rates(out, "y_fair")
    for spread in (max(x) - min(x) for x in zip(*after.values())):
        assert spread < 0.04
    want = plan["b"]
    assert abs(after["b"][0] - want["tpr"]) < 0.04 and abs(after["b"][1] - want["fpr"]) < 0.04 and want["tpr"] - want["fpr"] > 0.15


def test_planted_bias_of_the_test_tables(spark):
    df = fx.scored_biased(Tables(spark, MEDIUM))
    out = L.equalised_predictions(df, L.equalised_odds(df, "lang"), "lang", "id")
    rows = out.groupBy("lang").agg(F.avg(F.when(F.col("y_true") == 1, F.col("y_fair"))).alias("t"), F.avg(F.when(F.col("y_true") == 0, F.col("y_fair"))).alias("f")).collect()
    small = [(r["t"] or 0, r["f"] or 0) for r in rows]
    assert len(small) >= 3 and all(0 <= x <= 1 for r in small for x in r)


def test_reweighing_makes_label_and_group_independent(spark):
    df = biased(spark, 5000)
    w = H.reweighing(df, "g", "y")
    j = df.join(w.select(F.col("g").alias("wg"), F.col("y").alias("wy"), "weight"), F.col("g").eqNullSafe(F.col("wg")) & (F.col("y") == F.col("wy")))
    assert j.count() == 5000
    share = [r["s"] for r in j.where("g IS NULL OR g <> 'c'").groupBy("g").agg((F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("s")).collect()]
    assert max(share) - min(share) < 1e-9
    nulls = df.withColumn("id", F.when(F.col("id") % 2 > 0, F.col("id")))
    assert H.undersample(nulls, "id", "y").where("id IS NULL").count() > 0


def plain_mondrian(rows, k, scale):
    """Groups of (rows) by recursive median splits."""
    if len(rows) < 2 * k:
        return [rows]
    def width(i):
        v = [r[i] for r in rows]
        return (max(v) - min(v)) / scale[i]
    for i in sorted(range(len(scale)), key=lambda i: (-width(i), i)):
        v = sorted(r[i] for r in rows)
        m = v[(len(v) + 1) // 2 - 1]
        cut = m if m < v[-1] else max((x for x in v if x < m), default=None)
        if cut is None:
            continue
        left, right = [r for r in rows if r[i] <= cut], [r for r in rows if r[i] > cut]
        if min(len(left), len(right)) >= k:
            return plain_mondrian(left, k, scale) + plain_mondrian(right, k, scale)
    return [rows]


def test_mondrian_is_the_recursive_form(spark):
    r = random.Random(4)
    rows = [(float(r.randint(0, 60)), float(r.choice([1, 2, 2, 2, 3, 9]))) for _ in range(400)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "a double, b double, id int")
    out, groups = Q.mondrian(df, ["a", "b"], 7)
    want = plain_mondrian(rows, 7, (max(x[0] for x in rows) - min(x[0] for x in rows), 8.0))
    assert sorted(tuple(g)[1:] for g in groups.collect()) == sorted(
        (len(g), min(x[0] for x in g), max(x[0] for x in g), min(x[1] for x in g), max(x[1] for x in g)) for g in want)
    assert out.count() == 400 and out.columns == ["a", "b", "id", "region"]


def test_mondrian_edges(spark):
    rows = [(None, 1.0)] * 12 + [(5.0, None)] * 12 + [(5.0, 1.0)] * 3
    groups = Q.mondrian(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 10)[1].collect()
    assert sum(g["n"] for g in groups) == 27 and min(g["n"] for g in groups) >= 10
    few = Q.mondrian(spark.createDataFrame(rows[:4], "a double, b double"), ["a", "b"], 10)[1].collect()
    assert [g["n"] for g in few] == [4]
    assert Q.mondrian(spark.createDataFrame([], "a double, b double"), ["a", "b"], 10)[1].count() == 0
    big = Q.mondrian(spark.range(3000).select((F.col("id") * 7 % 1009).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b")), ["a", "b"], 25)[1]
    assert big.agg(F.min("n")).first()[0] >= 25 and big.count() > 40
