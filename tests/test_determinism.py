"""Same answers whatever the partitioning (1 vs many buckets / shuffle partitions)."""

from tests.conftest import MEDIUM
from vigil.operators import features as H
from vigil.operators import monitor as K
from vigil.operators import stats as S
from vigil.sources import fixtures as fx
from vigil.sources.tables import Tables


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_mann_whitney_bucket_invariant(spark):
    fs = fx.feature_store(Tables(spark, MEDIUM))
    a = S.mann_whitney(fs, ["f_total", "f_disc"], "target", 0, 1, buckets=1)
    b = S.mann_whitney(fs, ["f_total", "f_disc"], "target", 0, 1, buckets=16)
    assert _rows(a) == _rows(b)


def test_ks_bucket_invariant(spark):
    ref, cur = fx.drift_frames(Tables(spark, MEDIUM))
    assert _rows(K.ks_two_sample(ref, cur, ["value"], buckets=1)) == _rows(K.ks_two_sample(ref, cur, ["value"], buckets=8))


def test_split_partition_invariant(spark):
    fs = fx.feature_store(Tables(spark, MEDIUM)).select("id", "target")
    a = H.stratified_holdout(fs, "id", "target")
    b = H.stratified_holdout(fs.repartition(13), "id", "target")
    assert _rows(a) == _rows(b)
