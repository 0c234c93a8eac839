"""The third review's findings on texts that move twice, against plans and plain rows."""

import re
from contextlib import contextmanager

from tests.llm.helpers import frame
from vigil.llm import exact_dedup
from vigil.operators import features


@contextmanager
def large_joins(spark):
    """No side of a join is small enough to be broadcast, as on large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def test_drop_copies_moves_texts_once(spark):
    rows = [(k, f"text {k % 3}") for k in range(9)] + [(1, "text 1"), (None, "x y"), (None, "xy"), (None, "x y"), (5, None)]
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == [
        (True, 0, "text 0"), (True, 1, "text 1"), (True, 2, "text 2"), (True, 5, None)]
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["x y"]
    with large_joins(spark):
        plan = exact_dedup.drop_copies(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    # Under the top join: the rows are dealt once, before their repeats are dropped.
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*__key", plan)) == 2, plan


def test_tfidf_terms_shuffles_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (2, "cc"), (None, "aa")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    with large_joins(spark):
        out = features.tfidf_terms(docs, "doc_id", "text")
        got = {(r["doc_id"], r["term"]): (r["tf"], r["df"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert got == {(1, "aa"): (2, 2), (1, "bb"): (1, 2), (2, "bb"): (1, 2), (2, "cc"): (2, 1), (None, "aa"): (1, 2)}
    assert "ReusedExchange" in plan, plan
