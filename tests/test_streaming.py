"""Streams equal batches however many files a time slice has; the watermark drops nothing on a log within its
lateness and exactly the planted late rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from vigil.functions.exprs import md5_uniform
from vigil.plans.catalog_streaming import _sentinel
from vigil.sources import fixtures as fx
from vigil.sources import io
from vigil.sources.tables import Tables
from vigil.streaming import telemetry as S


def _run(spark, folder, schema, job, max_files=None):
    sink, ck = io.work_path(spark, "t-sink"), io.work_path(spark, "t-ck")
    q = S.run_available_now(job(S.read_log_stream(spark, folder, schema, max_files)), sink, ck)
    return q, spark.read.parquet(sink)


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_late_rows_dropped(spark):
    """Rows behind the watermark are dropped, and only they."""
    log = fx.service_log(Tables(spark, MEDIUM))
    folder = io.work_path(spark, "t-stream")
    S.stage_log_files(log, folder, "ts", 4)
    late = log.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).limit(5)
    n_late = late.count()
    sink, ck = io.work_path(spark, "t-sink"), io.work_path(spark, "t-ck")
    stream = S.counters(S.read_log_stream(spark, folder, log.schema))
    S.run_available_now(stream, sink, ck)
    late.write.parquet(f"{folder}/part-9998-late")   # arrives after the newest events: behind the watermark
    row = _sentinel(log.schema)
    spark.createDataFrame([tuple(row[f.name] for f in log.schema.fields)], log.schema).write.parquet(f"{folder}/part-9999")
    q = S.run_available_now(S.counters(S.read_log_stream(spark, folder, log.schema)), sink, ck)
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in q.recentProgress
                  if p.get("stateOperators"))
    # the operator counts late rows after the map-side partial aggregation (one per late group)
    assert 0 < dropped <= n_late
    assert spark.read.parquet(sink).groupBy().agg(F.sum("requests")).first()[0] == log.count()


@pytest.mark.parametrize("files", [1, 4, 16])
def test_slices_of_several_files_lose_nothing(spark, files):
    t = Tables(spark, MEDIUM)
    log = fx.service_log(t)
    again = log.where(md5_uniform("event_id", 7) < 0.01)
    folder = io.work_path(spark, "t-files")
    S.stage_log_files(log, folder, "ts", 3, _sentinel(log.schema), files_per_slice=files)
    real = F.col("ts") < F.lit("2090-01-01").cast("timestamp_ntz")
    assert _rows(_run(spark, folder, log.schema, S.ingest)[1].where(real)) == _rows(log)
    assert _rows(_run(spark, folder, log.schema, S.counters)[1]) == _rows(S.counters(log))
    assert _rows(_run(spark, folder, log.schema, S.latency_histogram)[1]) == _rows(S.latency_histogram(log))
    twice = io.work_path(spark, "t-twice")
    S.stage_log_files(log.unionByName(again), twice, "ts", 3, files_per_slice=files)
    assert _rows(_run(spark, twice, log.schema, S.dedup_within_watermark)[1]) == _rows(log)
    hist = fx.metric_history(t)
    folder = io.work_path(spark, "t-history")
    S.stage_log_files(hist, folder, "ts", 3, _sentinel(hist.schema), files_per_slice=files)
    assert _rows(_run(spark, folder, hist.schema, S.avg_over_time)[1]) == _rows(S.avg_over_time(hist))


def test_small_batches_need_a_delay_as_long_as_a_slice(spark):
    """One file per batch: nothing is lost when the watermark delay covers a slice."""
    log = fx.service_log(Tables(spark, MEDIUM))
    folder = io.work_path(spark, "t-small")
    S.stage_log_files(log, folder, "ts", 2, _sentinel(log.schema), files_per_slice=2)
    out = _run(spark, folder, log.schema, lambda x: S.counters(x, "31 days"), max_files=1)[1]
    assert _rows(out) == _rows(S.counters(log))
