"""Catalog: streaming telemetry (s01-s08).

Each query stages the prediction log (service_log over the events table) as
parquet files written in event order into a fresh folder under the shared
checkpoint folder, runs the streaming job with ``availableNow`` and a
checkpoint, and returns the sink read back in batch -- so stream = batch is
what the oracle checks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vigil.functions.exprs import md5_uniform
from vigil.plans.catalog_monitor import _drift_sql
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources import io
from vigil.sources.fixture_sql import with_views
from vigil.streaming import telemetry as S

FAR = dt.datetime(2099, 1, 1)


def _sentinel(schema) -> dict:
    vals = {}
    for f in schema.fields:
        t = f.dataType.simpleString()
        vals[f.name] = (FAR if t.startswith("timestamp") else "v1" if t == "string"
                        else 0.0 if t in ("double", "float") else 0)
    return vals


def _staged(t, name: str, log, n_files: int = 6, sentinel: bool = False):
    folder = io.work_path(t.spark, f"{name}-in")
    S.stage_log_files(log, folder, "ts", n_files, _sentinel(log.schema) if sentinel else None)
    return folder


def _run(t, name: str, stream, mode: str = "append"):
    sink, ck = io.work_path(t.spark, f"{name}-out"), io.work_path(t.spark, f"{name}-ckpt")
    S.run_available_now(stream, sink, ck, mode)
    return t.spark.read.parquet(sink)


@query("s01_log_ingestion", doubles=("latency_ms",), oracle=with_views("SELECT * FROM service_log", "service_log"))
def s01(t):
    """Prediction-log ingestion: file stream -> parquet sink, exactly once."""
    log = fx.service_log(t)
    folder = _staged(t, "s01", log)
    return _run(t, "s01", S.ingest(S.read_log_stream(t.spark, folder, log.schema)))


@query("s02_counters", oracle=with_views("""
SELECT date_trunc('hour', ts) AS window_start, model_version, CASE WHEN is_error = 1 THEN 'error' ELSE 'ok' END AS outcome,
       count(*)::BIGINT AS requests, sum(num_samples)::BIGINT AS predictions
FROM service_log GROUP BY ALL""", "service_log"))
def s02(t):
    """Hourly request / prediction counters per model version and outcome (watermarked, append)."""
    log = fx.service_log(t)
    folder = _staged(t, "s02", log, sentinel=True)
    out = _run(t, "s02", S.counters(S.read_log_stream(t.spark, folder, log.schema)))
    return out.withColumn("predictions", F.col("predictions").cast("long"))


@query("s03_latency_histogram", doubles=("latency_sum",), oracle=with_views(
    "SELECT date_trunc('hour', ts) AS window_start, model_version, "
    + ", ".join(f"count(*) FILTER (WHERE latency_ms <= {b})::BIGINT AS le_{int(b)}" for b in S.LATENCY_BUCKETS)
    + ", count(*)::BIGINT AS le_inf, sum(latency_ms) AS latency_sum FROM service_log GROUP BY ALL", "service_log"))
def s03(t):
    log = fx.service_log(t)
    folder = _staged(t, "s03", log, sentinel=True)
    return _run(t, "s03", S.latency_histogram(S.read_log_stream(t.spark, folder, log.schema)))


@query("s03_latency_percentiles", doubles=("p50", "p95", "p99"), oracle=with_views(
    "SELECT date_trunc('hour', ts) AS window_start, model_version, count(*)::BIGINT AS n, "
    + ", ".join(f"quantile_disc(latency_ms, {p}) AS p{int(100 * p)}" for p in (0.5, 0.95, 0.99))
    + " FROM service_log GROUP BY ALL", "service_log"))
def s03_percentiles(t):
    """Hourly latency percentiles per version from KLL sketches (exact while an hour has few requests)."""
    log = fx.service_log(t)
    folder = _staged(t, "s03p", log, sentinel=True)
    return _run(t, "s03p", S.latency_percentiles(S.read_log_stream(t.spark, folder, log.schema)))


_INCREASES = """
c AS (SELECT event_type AS name, ts, event_id,
             count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events),
d AS (SELECT name, ts, CASE WHEN lag(value) OVER (PARTITION BY name ORDER BY ts, event_id) IS NULL THEN 0
                            WHEN value >= lag(value) OVER (PARTITION BY name ORDER BY ts, event_id)
                            THEN value - lag(value) OVER (PARTITION BY name ORDER BY ts, event_id)
                            ELSE value END AS inc FROM c)"""


@query("s04_rate_stream", doubles=("rate_per_s",), oracle=f"""
WITH {_INCREASES},
e AS (SELECT name, inc, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE * (k + 1) AS window_end FROM d, range(0, 4) r(k))
SELECT name, window_end, sum(inc) / 3600.0 AS rate_per_s, sum(inc)::BIGINT AS increase FROM e GROUP BY ALL""")
def s04_stream(t):
    """rate(x[1h]) every 15 minutes of the daily-restarting counter, as a stream with keyed state and timers."""
    series = S.counter_series(t.events.select("event_type", "ts", "event_id"))
    folder = _staged(t, "s04s", series, sentinel=True)
    schema = t.spark.read.option("recursiveFileLookup", "true").parquet(folder).schema
    return _run(t, "s04s", S.rate_stream(S.read_log_stream(t.spark, folder, schema), step=900))


@query("s04_rate_1h", doubles=("rate_per_s",), oracle="""
WITH c AS (SELECT event_type AS name, ts, event_id,
                  count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events),
d AS (SELECT name, ts, CASE WHEN lag(value) OVER (PARTITION BY name ORDER BY ts, event_id) IS NULL THEN 0
                            WHEN value >= lag(value) OVER (PARTITION BY name ORDER BY ts, event_id)
                            THEN value - lag(value) OVER (PARTITION BY name ORDER BY ts, event_id)
                            ELSE value END AS inc FROM c)
SELECT name, date_trunc('hour', ts) AS hour, sum(inc) / 3600.0 AS rate_per_s, sum(inc)::BIGINT AS increase
FROM d GROUP BY ALL""")
def s04(t):
    """rate(x[1h]) of a daily-restarting request counter (resets counted as increases)."""
    series = S.counter_series(t.events.select("event_type", "ts", "event_id"))
    return S.rate_1h(series)


@query("s05_avg_over_time_7d", doubles=("avg_value",), oracle=with_views("""
SELECT name, ws AS window_start, ws + INTERVAL 7 DAY AS window_end, avg(value) AS avg_value, count(*)::BIGINT AS n
FROM (SELECT name, value, date_trunc('day', ts) - k * INTERVAL 1 DAY AS ws FROM metric_history, range(0, 7) r(k)) x
GROUP BY name, ws""", "metric_history"))
def s05(t):
    """avg_over_time(x[7d]) at daily steps, computed by a streaming sliding window."""
    hist = fx.metric_history(t)
    folder = _staged(t, "s05", hist, sentinel=True)
    return _run(t, "s05", S.avg_over_time(S.read_log_stream(t.spark, folder, hist.schema)))


# Arrivals of current events: each is one micro-batch.
_ARRIVALS = (("2024-01-01", "2024-01-21"), ("2024-01-21", "2024-01-26"), ("2024-01-26", "2099-01-01"))


@query("s06_drift_per_batch", doubles=("statistic", "p_value"), oracle=with_views("\nUNION ALL\n".join(
    f"SELECT *, {i}::BIGINT AS batch_id FROM ({_drift_sql(f'cur{i}')}) d{i}" for i in range(len(_ARRIVALS))), "ref", "cur",
    ctes=[(f"cur{i}", f"SELECT * FROM cur WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}'")
          for i, (a, b) in enumerate(_ARRIVALS)]))
def s06(t):
    """Each arrival of current events is one micro-batch, tested against the reference window (foreachBatch)."""
    ref, cur = fx.drift_frames(t)
    folder, ck, alerts = (io.work_path(t.spark, f"s06-{x}") for x in ("in", "ckpt", "alerts"))
    for i, (a, b) in enumerate(_ARRIVALS):
        day = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
        cur.where((F.col("ts") >= day(a)) & (F.col("ts") < day(b))).write.parquet(f"{folder}/arrival-{i}")
        stream = S.read_log_stream(t.spark, folder, cur.schema)
        q = (stream.writeStream.foreachBatch(S.drift_per_batch(ref, ["user_id", "value"], ["event_type"], alerts))
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    return io.read_batches(t.spark, alerts).withColumn("batch_id", F.col("batch_id").cast("long"))


@query("s07_new_files_trigger", doubles=("latency_ms",), oracle=with_views("SELECT * FROM service_log", "service_log"))
def s07(t):
    """Two scheduled availableNow runs on one checkpoint: the second picks up only the new files."""
    log = fx.service_log(t)
    folder = io.work_path(t.spark, "s07-in")
    sink, ck = io.work_path(t.spark, "s07-out"), io.work_path(t.spark, "s07-ckpt")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    S.stage_log_files(log.where(F.col("ts") < cut), f"{folder}/a", "ts", 3)
    S.run_available_now(S.ingest(S.read_log_stream(t.spark, folder, log.schema)), sink, ck)
    S.stage_log_files(log.where(F.col("ts") >= cut), f"{folder}/b", "ts", 3)
    S.run_available_now(S.ingest(S.read_log_stream(t.spark, folder, log.schema)), sink, ck)
    return t.spark.read.parquet(sink)


@query("s08_idempotent_ingestion", doubles=("latency_ms",), oracle=with_views("SELECT * FROM service_log",
                                                                              "service_log"))
def s08(t):
    """About 1 % of log rows redelivered; dropDuplicatesWithinWatermark(event_id) restores the log."""
    log = fx.service_log(t)
    redelivered = log.where(md5_uniform("event_id", 7) < 0.01)
    folder = _staged(t, "s08", log.unionByName(redelivered))
    return _run(t, "s08", S.dedup_within_watermark(S.read_log_stream(t.spark, folder, log.schema)))



