"""Small tests of what the third review found."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import quality, suffix_dedup
from vigil.operators import quality as Q
from vigil.operators import stats as S
from vigil.operators import training as T


def _poisson1(key: str, seed: int) -> int:
    u = int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16) / 2 ** 32
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return int((u >= cdf).sum())


def test_bootstrap_weighs_every_row_by_itself(spark):
    rows = [(i, i % 2, (i // 3) % 2, (i // 5) % 2) for i in range(400)]
    got = S.bootstrap_difference(spark.createDataFrame(rows, "id int, y int, a int, b int").repartition(3), "y", "a", "b", 20, 42, key="id").first()
    d = []
    for rep in range(1, 21):
        w = np.array([_poisson1(f"{i}#{rep}", 42) for i, *_ in rows])
        hit1, hit2 = (np.array([r[c] == r[1] for r in rows]) for c in (2, 3))
        d.append((w * hit2).sum() / w.sum() - (w * hit1).sum() / w.sum())
    assert abs(got["mean_difference"] - np.mean(d)) < 1e-12 and got["n_replicates"] == 20
    assert abs(got["ci_lower"] - np.quantile(d, 0.025)) < 1e-12 and abs(got["ci_upper"] - np.quantile(d, 0.975)) < 1e-12


def test_quality_model_counts_every_trusted_document(spark, monkeypatch):
    n, seen = 20_300, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("w%d", F.col("id") % 7).alias("text"),
                                 F.when(F.col("id") < 20_200, "en").otherwise("nl").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    fit = quality.kneser_ney
    monkeypatch.setattr(quality, "kneser_ney", lambda counts: seen.append({r["lang"]: r["n"] for r in counts.groupBy("lang").agg(
        F.sum("n").alias("n")).collect()}) or fit(counts))
    assert quality.quality_scores(docs, labels).filter("NOT rejected").count() == n
    assert seen == [{"en": 2 * 20_200, "nl": 2 * 100}]
    assert quality.quality_scores(docs.withColumn("lang", F.when(F.col("doc_id") > 0, F.col("lang"))), labels).count() == n
    assert seen[1] == {"en": 2 * 20_199, "nl": 2 * 100, quality.ALL: 2 * n}


def test_a_group_over_many_shards_is_not_copied():
    """Windows of earlier shards are searched as they are: nothing found twice, nothing merged."""
    r = np.random.default_rng(3)
    raws = [r.integers(97, 123, 150, dtype=np.uint8).tobytes() for _ in range(40)]
    raws[25], raws[39] = raws[3][10:140], raws[12]
    seen, before = None, []
    for at in range(0, 40, 10):
        some, more = suffix_dedup.repeated_windows(raws[at:at + 10], np.zeros(10, np.int64), seen)
        assert seen is None or all(a is b for a, b in zip(seen, more))
        before, seen = before + some, more
    assert [i for i, b in enumerate(before) if b.any()] == [25, 39] and before[25].all() and before[39].all()
    assert sum(map(len, seen)) == 38 * 51 == len(np.unique(np.concatenate(seen)))


def test_mondrian_ends_small_regions_in_one_task(spark, monkeypatch):
    """The same regions whether they are split by passes over the table or to the end in a task, in few saved tables."""
    r = random.Random(4)
    rows = [(float(r.randint(0, 60)), None if i % 40 == 0 else float(r.choice([1, 2, 2, 2, 3, 9])), i, f"x{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, id int, t string").repartition(3)
    saved, cut = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda d: saved.append(1) or cut(d))
    got = {}
    for most in (1 << 16, 60, 0):
        saved.clear()
        monkeypatch.setattr(Q, "LOCAL_ROWS", most)
        out, groups = Q.mondrian(df, ["a", "b"], 7)
        got[most] = sorted(map(tuple, out.collect()), key=str), sorted(map(tuple, groups.collect()), key=str)
        assert most < 1 << 16 or len(saved) <= 3
    assert got[1 << 16] == got[60] == got[0]
    assert len(got[0][0]) == 400 and {x[:4] for x in got[0][0]} == {*rows}


def test_fits_read_the_input_once_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_A_TASK", 100)
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"), F.lit("text").alias("t"))
    held, cut = [], T.cut_lineage
    monkeypatch.setattr(T, "cut_lineage", lambda d: held.append(d.columns) or cut(d))
    assert T._held(df.coalesce(1), ["x", "y"]).rdd.getNumPartitions() == 10
    T.train_random_forest(df, ["x"], "y", num_trees=2, max_depth=2)
    T.train_boosted_trees(df, ["x"], "y", max_iter=2, max_depth=2)
    assert held == [["x", "y"]] * 3


def test_learning_curve_side_by_side(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.xxhash64("id") % 10 < F.col("id") % 7).cast("int").alias("y"),
                                 (F.col("id") % 2).cast("int").alias("fold"))
    a, b = (sorted(map(tuple, T.learning_curve(df, ["x"], "y", "id", "fold", fractions=(0.5, 1.0), num_folds=2, parallelism=n).collect())) for n in (1, 4))
    assert a == b and len(a) == 2 and a[1][1] == 150.0
