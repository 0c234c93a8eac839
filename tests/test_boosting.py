"""Second-order boosting against a plain-Python form, and on planted data."""

import math

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import boosting as B
from vigil.operators import evaluation as V


def planted(spark, n=3000):
    """y = 1 where a is above 30 and b below 20, with every 50th label flipped; c is NULL for a third of the rows."""
    r = spark.range(n).select("id", (F.col("id") * 37 % 61).cast("double").alias("a"), (F.col("id") * 53 % 43).cast("double").alias("b"),
                              F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("c"))
    rule = (F.col("a") > 30) & (F.col("b") < 20)
    return r.withColumn("y", F.when(F.col("id") % 50 == 7, ~rule).otherwise(rule).cast("int"))


def plain_tree(x, y, p, leaves, l2, rate, least_rows, depth):
    """Best-first tree on bins, row by row: {rows of the leaf: value}."""
    g, h = p - y, p * (1 - p)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)

    def best(m):
        found = (1e-9, None)
        for f in range(x.shape[1]):
            for cut in range(-1, int(x[:, f].max())):
                left, right = m & (x[:, f] <= cut), m & (x[:, f] > cut)
                if min(left.sum(), right.sum()) < least_rows:
                    continue
                gain = score(left) + score(right) - score(m)
                if gain > found[0] + 1e-9:
                    found = (gain, (left, right))
        return found

    open_ = [(np.ones(len(x), bool), 0)]
    while len(open_) < leaves:
        able = [(best(m), i) for i, (m, d) in enumerate(open_) if d < depth]
        (gain, parts), i = max(able, key=lambda t: t[0][0])
        if parts is None:
            break
        _, d = open_.pop(i)
        open_ += [(parts[0], d + 1), (parts[1], d + 1)]
    value = np.zeros(len(x))
    for m, _ in open_:
        value[m] = -rate * g[m].sum() / (h[m].sum() + l2)
    return value


def test_leaf_values_are_newton_steps(spark):
    df = planted(spark, 700)
    model = B.train_newton_trees(df, ["a", "b", "c"], "y", rounds=4, leaves=5, rate=0.3, l2=2.0, depth=4, least_rows=9, bins=8)
    binned = df.select(*[B.bin_of(f, c) for f, c in zip(model.features, model.cuts)], "y").toPandas().to_numpy()
    x, y = binned[:, :3], binned[:, 3]
    total = np.full(len(y), model.base)
    assert math.isclose(model.base, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for tree in model.trees:
        want = plain_tree(x, y, 1 / (1 + np.exp(-total)), 5, 2.0, 0.3, 9, 4)
        assert np.allclose(tree.scores(x), want, atol=1e-9)
        total += want


def test_planted_rule_is_learned(spark, monkeypatch):
    monkeypatch.setattr(B, "WRITE_EVERY", 3)
    df = planted(spark)
    model = B.train_newton_trees(df.where("id % 4 > 0"), ["a", "b", "c"], "y", rounds=10, rate=0.5)
    pred = model.predict(df.where("id % 4 = 0"))
    assert pred.columns == [*df.columns, "probability_1", "prediction"]
    assert V.auc(pred, "y", "probability_1").first()[0] > 0.94
    right = pred.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.95
    assert all(len(t.value) <= 31 for t in model.trees)
    others = B.train_newton_trees(df.where("id % 4 > 0").repartition(7), ["a", "b", "c"], "y", rounds=10, rate=0.5)
    assert [t.split for t in others.trees[:3]] == [t.split for t in model.trees[:3]]


def test_edges(spark):
    none = B.train_newton_trees(planted(spark).limit(0), ["a", "b"], "y", rounds=3)
    assert none.trees == [] and none.predict(planted(spark, 5)).first()["probability_1"] == 0.5
    alike = B.train_newton_trees(planted(spark, 300).withColumn("y", F.lit(1)), ["a", "c"], "y", rounds=2)
    assert all(not t.split for t in alike.trees) and alike.predict(planted(spark, 5)).first()["prediction"] == 1.0
    nulls = planted(spark, 300).withColumns({"a": F.lit(None).cast("double"), "y": F.when(F.col("id") % 2 == 0, F.col("y"))})
    assert B.train_newton_trees(nulls, ["a", "b"], "y", rounds=2).predict(nulls).where("probability_1 IS NULL").count() == 0
