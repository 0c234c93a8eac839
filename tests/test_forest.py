"""i01's forest on counted cells, against MLlib's forest by rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigil.operators import forest
from vigil.operators import training as T

NAMES = ["a", "b", "c"]


def planted(spark, n):
    """Label 1 mostly inside a square of ``a`` and ``b``; ``c`` says nothing; some values are NULL or NaN."""
    u = [(F.xxhash64("id", F.lit(k)) % 1000) / 1000.0 for k in range(4)]
    df = spark.range(n).select("id", (F.abs(u[0]) * 40).alias("a"), F.floor(F.abs(u[1]) * 12).alias("b"), F.abs(u[2]).alias("c"), F.abs(u[3]).alias("u"))
    inside = F.col("a").between(10, 30) & F.col("b").between(3, 8)
    df = df.withColumn("y", (F.when(inside, F.col("u") < 0.9).otherwise(F.col("u") < 0.1)).cast("int"))
    return df.withColumns({"a": F.when(F.col("id") % 31 != 0, F.col("a")), "c": F.when(F.col("id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("c"))})


class Fixed:
    """Every row once, every feature in order."""

    def poisson(self, n):
        return np.array(n)

    def random(self, shape):
        return np.tile(np.arange(shape[1], dtype=float), (shape[0], 1))


def test_a_tree_without_draws_is_mllibs_tree(spark):
    """Same splits, same merged leaves, same votes and importances."""
    r = np.random.default_rng(8)
    bins = np.stack(np.unravel_index(np.arange(7 * 5 * 4), (7, 5, 4)), axis=1)
    for depth in (1, 3, 10):
        odds = np.clip(r.normal(0.5, 0.3, len(bins)), 0, 1)
        train = np.stack([r.binomial(9, 1 - odds), r.binomial(9, odds)]).astype(float)
        rows = [(*map(float, b), float(y)) for k, b in enumerate(bins) for y in (0, 1) for _ in range(int(train[y, k]))]
        df = VectorAssembler(inputCols=NAMES, outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, y double"))
        model = RandomForestClassifier(labelCol="y", numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="all", seed=1).fit(df)
        want = {tuple(x[:3]): x[3] for x in model.transform(df).select(*NAMES, vector_to_array("probability")[1]).distinct().collect()}
        votes, importances = forest.grow(bins, train, 1, depth, 3, Fixed())
        assert all(abs(votes[k] - want[tuple(map(float, b))]) < 1e-9 for k, b in enumerate(bins) if train[:, k].sum())
        assert np.allclose(importances, model.featureImportances.toArray())


def test_many_rows_grow_on_cells_what_mllib_grows_on_rows(spark, monkeypatch):
    df = planted(spark, 20_000)
    by_rows = T.train_random_forest(df, NAMES, "y", num_trees=40, max_depth=6)
    monkeypatch.setattr(T, "FOREST_ROWS", 5_000)
    monkeypatch.setattr(T, "Pipeline", None)             # no pass over the rows per level of trees
    by_cells = T.train_random_forest(df.repartition(7), NAMES, "y", num_trees=40, max_depth=6)
    assert len(by_cells.cuts[1]) == 11 and len(by_cells.cuts[0]) == 31 and by_cells.n_trees == 40
    again = T.train_random_forest(df, NAMES, "y", num_trees=40, max_depth=6)
    assert np.abs(again.votes - by_cells.votes).mean() < 2
    p = [T.predict(m, df, NAMES, "y") for m in (by_rows, by_cells)]
    assert p[0].columns == p[1].columns and p[0].dtypes == p[1].dtypes
    a, b = ({r["id"]: r for r in x.collect()} for x in p)
    assert len(a) == len(b) == 20_000
    diff = np.array([abs(a[k]["probability_1"] - b[k]["probability_1"]) for k in a])
    assert diff.mean() < 0.03 and np.mean([a[k]["prediction"] == b[k]["prediction"] for k in a]) > 0.97
    want, got = ({r["feature"]: r["importance"] for r in T.feature_importance(m, NAMES).collect()} for m in (by_rows, by_cells))
    assert all(abs(want[f] - got[f]) < 0.05 for f in NAMES)


def test_every_tree_is_drawn(spark):
    """Blocks of trees are drawn apart, and the last one may be smaller."""
    df = T._as_double(planted(spark, 3000), NAMES, "y")
    one, some = (forest.train_cells(df, NAMES, "y", n, 4, 3) for n in (forest.TREES, 2 * forest.TREES + 3))
    assert 0 <= some.votes.min() and some.votes.max() <= some.n_trees == 23 and abs(some.importances.sum() - 1) < 1e-9
    rest = some.votes - one.votes
    assert rest.max() > 0.5 and np.abs(rest - one.votes).max() > 0.1


def test_rows_that_cells_cannot_hold_go_to_mllib(spark, monkeypatch):
    df = T._as_double(planted(spark, 2000), NAMES, "y")
    train = lambda d: forest.train_cells(d, NAMES, "y", 2, 2, 1)
    assert train(df) is not None
    assert train(df.withColumn("y", F.when(F.col("id") != 5, F.col("y")))) is None
    assert train(df.withColumn("y", F.lit(1.0))) is None
    assert train(df.withColumn("y", F.col("id") % 3 + 0.0)) is None
    assert train(df.withColumn("c", F.lit(None).cast("double"))) is None
    monkeypatch.setattr(forest, "MOST_CELLS", 100)
    assert train(df) is None
    monkeypatch.setattr(T, "FOREST_ROWS", 10)
    assert len(T.train_random_forest(df, NAMES, "y", num_trees=2, max_depth=2).stages) == 3
    with pytest.raises(Exception, match="NULL|Null"):
        T.train_random_forest(df.withColumn("y", F.when(F.col("id") != 5, F.col("y"))), NAMES, "y", num_trees=2, max_depth=2)
