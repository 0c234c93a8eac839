"""Streams with own state against their batch forms: rates of counters, percentiles, retried batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from vigil.plans.catalog_streaming import FAR, _sentinel
from vigil.sources import fixtures as fx
from vigil.sources import io
from vigil.sources.tables import Tables
from vigil.streaming import telemetry as S

START = dt.datetime(2024, 3, 1)
KIND = "name string, ts timestamp_ntz, event_id long, value long"


def samples(n=400):
    """Three counters with resets, uneven gaps and equal times, in no order."""
    r, rows = random.Random(8), []
    for name in ("a", "b", "hot"):
        at, value = 0, 0
        for i in range(n if name == "hot" else n // 8):
            at += r.choice([0, 1, 7, 15, 40, 900, 5000 if name == "a" else 20])
            value = r.randint(0, 3) if r.random() < 0.05 else value + r.randint(0, 9)
            rows.append((name, START + dt.timedelta(seconds=at), i, value))
    r.shuffle(rows)
    return rows


def plain_rates(rows, window, step):
    out = {}
    for name in {r[0] for r in rows}:
        mine = sorted((round((ts - START).total_seconds()), i, v) for n, ts, i, v in rows if n == name)
        last = None
        for at, _, v in mine:
            inc = 0 if last is None else v - last if v >= last else v
            last = v
            for end in range(at // step * step + step, at // step * step + window + 1, step):
                out[name, START + dt.timedelta(seconds=end)] = out.get((name, START + dt.timedelta(seconds=end)), 0) + inc
    return out


def run(spark, folder, schema, job, sink=None, ck=None, max_files=None):
    sink, ck = sink or io.work_path(spark, "t-sink"), ck or io.work_path(spark, "t-ck")
    S.run_available_now(job(S.read_log_stream(spark, folder, schema, max_files)), sink, ck)
    return spark.read.parquet(sink)


def rates(df):
    return {(r["name"], r["window_end"]): r["increase"] for r in df.collect()}


@pytest.mark.parametrize("files", [1, 4, 16])
def test_rate_stream_is_the_batch_rate(spark, files):
    rows = samples()
    df = spark.createDataFrame(rows, KIND)
    folder = io.work_path(spark, "t-rate")
    S.stage_log_files(df, folder, "ts", 2, {"name": "v1", "ts": FAR, "event_id": 0, "value": 0}, files_per_slice=files)
    out = run(spark, folder, df.schema, lambda x: S.rate_stream(x, 3600, 15, "1 day"))
    got = rates(out)
    assert out.count() == len(got)
    assert got == plain_rates(rows, 3600, 15)
    hourly = rates(run(spark, folder, df.schema, lambda x: S.rate_stream(x, 3600, 3600)))
    batch = {(r["name"], r["hour"] + dt.timedelta(hours=1)): r["increase"] for r in S.rate_1h(df).collect()}
    assert hourly == batch


def test_rate_stream_goes_on_after_a_restart(spark):
    rows = sorted(samples(), key=lambda r: r[1])
    df = spark.createDataFrame(rows, KIND)
    folder, sink, ck = (io.work_path(spark, f"t-restart-{x}") for x in ("in", "out", "ck"))
    cut = rows[len(rows) // 2][1]
    at = F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz")
    job = lambda x: S.rate_stream(x, 3600, 60, "10 minutes")
    S.stage_log_files(df.where(F.col("ts") < at), f"{folder}/a", "ts", 3)
    first = run(spark, folder, df.schema, job, sink, ck).count()
    S.stage_log_files(df.where(F.col("ts") >= at), f"{folder}/b", "ts", 3, {"name": "v1", "ts": FAR, "event_id": 0, "value": 0})
    out = run(spark, folder, df.schema, job, sink, ck)
    assert 0 < first < out.count()
    assert rates(out) == plain_rates(rows, 3600, 60)


def test_percentiles_within_the_sketch_error(spark):
    """Many values in few windows: every percentile's exact rank is within 1 % of the wanted one; late rows are counted."""
    log = fx.service_log(Tables(spark, MEDIUM))
    many = spark.range(40_000).select((F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 7200)).alias("ts"),
                                      F.lit("v1").alias("model_version"), (F.xxhash64("id") % 100_003).cast("double").alias("latency_ms"),
                                      F.lit(0).alias("is_error"), F.lit(1).alias("is_correct"), F.lit(1).cast("long").alias("num_samples"),
                                      F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"))
    many = many.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in log.schema])
    folder = io.work_path(spark, "t-kll")
    S.stage_log_files(many, folder, "ts", 2, _sentinel(many.schema), files_per_slice=4)
    rows = run(spark, folder, many.schema, S.latency_percentiles).collect()
    assert len(rows) == 2 and sum(r["n"] for r in rows) == 40_000
    for r in rows:
        hour = many.where(F.date_trunc("hour", "ts").cast("timestamp_ntz") == F.lit(r["window_start"]))
        for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            rank = hour.where(F.col("latency_ms") <= r[name]).count() / r["n"]
            assert abs(rank - p) < 0.01


def test_a_retried_batch_is_written_once(spark):
    ref, cur = fx.drift_frames(Tables(spark, MEDIUM))
    alerts = io.work_path(spark, "t-alerts")
    write = S.drift_per_batch(ref, ["value"], [], alerts)
    for batch_id in (0, 1, 1, 0):
        write(cur, batch_id)
    assert sorted(r["batch_id"] for r in io.read_batches(spark, alerts).collect()) == [0, 1]
    io.write_batch(cur.limit(3), alerts, 2)
    spark.range(5).write.parquet(f"{alerts}/batch_id=9")          # a batch that never finished
    assert {r[0] for r in io.read_batches(spark, alerts).select("batch_id").distinct().collect()} == {0, 1, 2}


def test_partitions_are_replaced_not_appended(spark):
    path = io.work_path(spark, "t-parts")
    old = spark.range(30).select("id", (F.col("id") % 3).alias("day"))
    io.overwrite_partitions(old, path, ["day"])
    for _ in range(2):
        io.overwrite_partitions(spark.range(100, 105).select("id", F.lit(1).alias("day")), path, ["day"])
    got = sorted((r["id"], r["day"]) for r in spark.read.parquet(path).collect())
    assert got == sorted([(i, i % 3) for i in range(30) if i % 3 != 1] + [(i, 1) for i in range(100, 105)])
