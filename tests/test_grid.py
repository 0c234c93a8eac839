"""The nested grid search: the whole grid, against direct fits and on planted data."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vigil.operators import training, tuning
from vigil.operators.features import stratified_kfold
from vigil.plans import catalog_eval
from vigil.sources import fixtures as fx
from vigil.sources.tables import Tables

#: Stated tolerance of a nested point against a direct MLlib fit: other draws, other cut points.
TOLERANCE = 0.08


def _folds(spark):
    return stratified_kfold(fx.train_rows(Tables(spark, SMALL)), "id", "target", 5)


def test_i08_has_every_point_near_its_direct_fit(spark):
    got = {tuple(r)[:3]: r["mean_cv_recall"] for r in catalog_eval.i08(Tables(spark, SMALL)).collect()}
    assert set(got) == set(itertools.product([50, 100, 200], [5, 10, 15], [1, 3, 5]))
    direct = {"numTrees": [50], "maxDepth": [5, 10], "minInstancesPerNode": [1, 5]}
    for r in training.grid_by_fits(_folds(spark), catalog_eval.NUM, "target", "fold", direct).collect():
        assert abs(got[tuple(r)[:3]] - r["mean_cv_recall"]) <= TOLERANCE, r
    again = {tuple(r)[:3]: r["mean_cv_recall"] for r in catalog_eval.i08(Tables(spark, SMALL)).collect()}
    assert again == got


def test_planted_rule_is_found(spark):
    """Label 1 inside a square of the two features, a NULL third one: shallow trees miss it, deep ones do not."""
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 67).cast("double").alias("a"), (F.col("id") % 59).cast("double").alias("b"),
                                    F.lit(None).cast("double").alias("c"), (F.col("id") % 5).cast("int").alias("fold"))
    rows = rows.withColumn("y", (F.col("a").between(20, 45) & F.col("b").between(15, 40)).cast("int"))
    grid = {"numTrees": [10, 20], "maxDepth": [1, 8], "minInstancesPerNode": [1, 4]}
    out = {tuple(r)[:3]: r["mean_cv_recall"] for r in training.grid_search_cv(rows, ["a", "b", "c"], "y", "fold", grid).collect()}
    assert len(out) == 8
    assert all(v > 0.9 for (_, depth, _), v in out.items() if depth == 8) and all(v < 0.2 for (_, depth, _), v in out.items() if depth == 1)


def test_more_cells_than_may_ride_along(spark, monkeypatch):
    monkeypatch.setattr(tuning, "MOST_CELLS", 10)
    asked = []
    monkeypatch.setattr(training, "grid_by_fits", lambda df, features, label, fold, grid, *rest: asked.append(grid) or df)
    training.grid_search_cv(_folds(spark), catalog_eval.NUM, "target", "fold")
    assert asked == [training.GRID]


def test_truncated_trees_are_the_shallow_trees():
    """Up to the draws, which a depth limit does not change before it bites."""
    r = np.random.default_rng(3)
    bins, train = r.integers(0, 8, (300, 3)), r.integers(0, 4, (2, 300)).astype(float)
    deep = tuning.grow_votes(bins, train, 6, [2, 4, 9], 2, 2, np.random.default_rng(1))
    for depth in (2, 4):
        assert np.allclose(deep[depth], tuning.grow_votes(bins, train, 6, [depth], 2, 2, np.random.default_rng(1))[depth])
    assert tuning.blocks_of([50, 100, 200], 60) == [(0, 50), (50, 100), (100, 160), (160, 200)]
