"""Property tests: the distributed rank primitives equal a brute-force computation."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vigil.functions.ranks import cumulative, exact_quantiles, ordered_running_sums

values = st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=values, b=values, buckets=st.sampled_from([2, 3, 8]))
def test_exact_quantiles_equal_numpy(spark, a, b, buckets):
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    long = spark.createDataFrame(rows, "feature string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["feature"], r["q"]): r["value_q"]
           for r in exact_quantiles(long, ["feature"], "value", probs, buckets=buckets).collect()}
    for name, vals in (("a", a), ("b", b)):
        exp = np.percentile(np.array(vals, dtype=float), [p * 100 for p in probs])  # linear interpolation
        for p, e in zip(probs, exp):
            assert abs(got[(name, p)] - e) < 1e-9


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=values, buckets=st.sampled_from([2, 5, 16]))
def test_cumulative_equals_running_sum(spark, a, buckets):
    uniq, counts = np.unique(np.array(a, dtype=float), return_counts=True)
    cells = spark.createDataFrame([("g", float(v), int(c)) for v, c in zip(uniq, counts)], "g string, v double, n long")
    got = {r["v"]: (r["cum_n"], r["next_value"])
           for r in cumulative(cells, ["g"], "v", ["n"], buckets=buckets, with_next=True).collect()}
    run = np.cumsum(counts)
    for i, v in enumerate(uniq):
        nxt = float(uniq[i + 1]) if i + 1 < len(uniq) else None
        assert got[float(v)] == (int(run[i]), nxt)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scores=st.lists(st.integers(min_value=0, max_value=3), min_size=1, max_size=80),
       hot=st.floats(min_value=0.0, max_value=1.0), parts=st.sampled_from([1, 3, 7]))
def test_ordered_running_sums_equal_window(spark, scores, hot, parts):
    """A hot key and heavy score ties: range slices + offsets equal the one-task window."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    n_hot = int(len(scores) * hot)
    rows = [("hot" if i < n_hot else f"k{i % 3}", i, float(s), int(s >= 2)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "q string, item long, s double, rel int").withColumn("one", F.lit(1))
    order = [F.col("s").desc(), F.col("item")]
    got = {(r["q"], r["item"]): (r["cum_one"], r["cum_rel"])
           for r in ordered_running_sums(df, ["q"], order, ["one", "rel"], partitions=parts).collect()}
    w = Window.partitionBy("q").orderBy(*order)
    exp = {(r["q"], r["item"]): (r["rn"], r["hits"])
           for r in df.select("q", "item", F.row_number().over(w).alias("rn"),
                              F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits")).collect()}
    assert got == exp


def test_rank_primitives_without_broadcast(spark, monkeypatch):
    """Above the broadcast limit the side tables join by shuffle: same results."""
    import vigil.functions.ranks as R
    vals = [float((i * 37) % 23) for i in range(200)]
    long = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(vals)], "feature string, value double")
    probs = [0.1, 0.5, 0.9]
    with_bc = sorted(tuple(r) for r in exact_quantiles(long, ["feature"], "value", probs, buckets=4).collect())
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    no_bc = sorted(tuple(r) for r in exact_quantiles(long, ["feature"], "value", probs, buckets=4).collect())
    assert with_bc == no_bc
    cells = long.groupBy("feature", "value").count().withColumnRenamed("count", "n")
    got = {(r["feature"], r["value"]): r["cum_n"] for r in cumulative(cells, ["feature"], "value", ["n"], buckets=4).collect()}
    for f in ("a", "b"):
        xs = sorted(v for i, v in enumerate(vals) if ("a" if i % 3 else "b") == f)
        for v in set(xs):
            assert got[(f, v)] == sum(1 for x in xs if x <= v)
