"""Every catalog query against its independent DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tools.oracle_check import rows_of
from vigil.plans import registry

ORACLE = registry.ORACLE
QUERIES = registry.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)


def _metrics(rows):
    """One row of test metrics: rates in [0, 1], as many rows as the test period has."""
    (r,) = rows
    return r["n"] > 0 and all(0 <= r[c] <= 1 for c in ("accuracy", "precision", "recall", "f1", "auc")) and r["accuracy"] > 0.4


def _grid(rows):
    points = {(r["numTrees"], r["maxDepth"], r["minInstancesPerNode"]) for r in rows}
    return len(rows) == len(points) == 27 and all(0 <= r["mean_cv_recall"] <= 1 for r in rows)


def _curve(rows):
    n = [r["n_train"] for r in sorted(rows, key=lambda r: r["fraction"])]
    return len(rows) == 10 and n == sorted(n) and n[0] < n[-1] and all(
        r[c] is None or 0 <= r[c] <= 1 for r in rows for c in ("train_recall", "validation_recall"))


def _importance(rows):
    return abs(sum(r["importance"] for r in rows) - 1) < 1e-5 and sorted(r["rank"] for r in rows) == [1, 2, 3] and all(
        a["importance"] >= b["importance"] for a, b in zip(*[iter(sorted(rows, key=lambda r: r["rank"]))] * 2))


#: What must hold for the rows of queries without SQL.
HOLDS = {
    "a03_list_files": lambda rows: len(rows) >= 14 and all(r["length"] > 0 and r["file"].endswith(".parquet") for r in rows),
    "e15_mondrian": lambda rows: min(r["n"] for r in rows) >= 10 and sum(r["n"] for r in rows) == 1500 and len(rows) > 50,
    "h23_tfidf": lambda rows: len(rows) == 200 and all(r["n_terms"] >= 0 for r in rows),
    "i01_random_forest": _metrics,
    "i02_boosted_trees": _metrics,
    "i02_newton_trees": _metrics,
    "i08_grid_search_cv": _grid,
    "i09_learning_curve": _curve,
    "i10_feature_importance": _importance,
    "l12_equalised_odds": lambda rows: len(rows) >= 2 and len({(r["tpr"], r["fpr"]) for r in rows}) == 1 and all(
        0 <= r[c] <= 1 for r in rows for c in ("weight_low", "weight_hull", "coin", "tpr")) and all(r["low"] <= r["high"] for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert HOLDS[name](rows), rows[:5]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["metric"] == "revenue_impact"
