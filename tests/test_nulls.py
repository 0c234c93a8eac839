"""NULL labels, keys and versions are rows like any other; ties do not depend on the order of the input."""

from pyspark.sql import functions as F

from vigil.operators import evaluation as V
from vigil.operators import features as H
from vigil.operators import quality as Q
from vigil.operators import relational as R
from vigil.operators import release as N
from vigil.roles import DatamartRules


def _frame(spark, n=100):
    rows = [(i if i % 10 else None, "a" if i % 4 == 1 else "b" if i % 4 == 2 else None, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string, x double")


def test_splits_keep_rows_with_null_label_or_key(spark):
    df = _frame(spark)
    for out in (H.stratified_holdout(df, "id", "label"), H.stratified_holdout(df, "id", None),
                H.three_way_split(df, "id", label="label"), H.stratified_kfold(df, "id", "label", 5)):
        assert out.count() == 100
    split = H.stratified_holdout(df, "id", "label")
    got = {(r[0], r[1]): r[2] for r in split.groupBy("label", "split").count().collect()}
    assert got == {("a", "test"): 5, ("a", "train"): 20, ("b", "test"): 5, ("b", "train"): 20,
                   (None, "test"): 10, (None, "train"): 40}


def test_holdout_quota_is_exact_when_a_cell_is_cut(spark):
    """All rows share one key: the quota lies inside one (stratum, hash) cell."""
    df = spark.range(50).withColumn("key", F.lit(1)).withColumn("label", F.lit("a"))
    assert {r[0]: r[1] for r in H.stratified_holdout(df, "key", "label").groupBy("split").count().collect()} == {"test": 10, "train": 40}


def test_undersample_keeps_the_null_class(spark):
    out = H.undersample(_frame(spark, 4000), "x", "label")
    n = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert n["a"] == n["b"] == 1000 and 850 < n[None] < 1150


def test_null_version_has_percentiles(spark):
    log = spark.createDataFrame([(None if i % 2 else "v1", float(i), i % 10 == 0, 1) for i in range(200)],
                                "model_version string, latency_ms double, is_error boolean, is_correct int") \
        .withColumn("is_error", F.col("is_error").cast("int"))
    m = {r["model_version"]: r for r in N.service_metrics(log).collect()}
    assert m[None]["n"] == 100 and m[None]["latency_p50"] == 100.0 and m["v1"]["latency_p50"] == 99.0
    assert "latency_p95" not in N.service_metrics(log, percentiles=()).columns


def test_duplicate_members_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None), (2, None), (3, 3)], "a int, b int")
    assert R.duplicate_members(df, ["a", "b"]).count() == 4 == R.duplicate_report(df, ["a", "b"]).first()["n_rows_in_groups"]


def test_version_diff_sees_shifted_nulls_and_column_order(spark):
    old = spark.createDataFrame([(1, None, 7), (2, 1, 1), (None, 3, 3), (4, 4, 4)], "k int, a int, b int")
    new = spark.createDataFrame([(7, None, 1), (1, 1, 2), (3, 3, None), (5, 5, 5)], "a int, b int, k int")
    assert Q.version_diff(old, new, "k").first().asDict() == {"n_added": 1, "n_removed": 1, "n_changed": 1, "n_unchanged": 2}


def test_silver_normalise_bad_values_and_renames(spark):
    df = spark.createDataFrame([("abc", " X ", "2024-01-02"), ("5", "y", "bad")], "`Acct Bal` string, Seg string, `On Day` string")
    out = H.silver_normalise(df, {"Acct Bal": "double"}, ["Seg"], ["On Day"]).collect()
    assert [r["acct_bal"] for r in out] == [None, 5.0] and [r["seg"] for r in out] == ["x", "y"]
    assert [str(r["on_day"]) for r in out] == ["2024-01-02", "None"]


def test_latest_version_and_gate_do_not_depend_on_row_order(spark):
    rows = [("m", "2", i, i / 10) for i in range(6)] + [("m", "10", i, i / 7) for i in range(4)]
    a = spark.createDataFrame(rows, "model string, version string, run_id int, recall double")
    want = V.latest_versions(a).first()
    assert want["version"] == "10" and want["run_id"] == 3
    rules = DatamartRules(dedup_keys=("model", "version"), min_rows=1)
    kept = sorted(map(tuple, Q.datamart_gate(a, rules)[1].collect()))
    for b in (a.orderBy(F.desc("run_id")), a.repartition(16, "run_id"), a.orderBy(F.rand(3))):
        assert V.latest_versions(b).first() == want
        assert sorted(map(tuple, Q.datamart_gate(b, rules)[1].select(*a.columns).collect())) == kept
