"""Streaming prediction telemetry (s01-s08).

The reference buffers prediction requests in memory and flushes them every
100 requests; its counters and latency histograms go to a metrics server.
Here the durable prediction log is a Structured Streaming source (a folder
of parquet files), and every telemetry view is a streaming query with a
watermark, a checkpoint in the shared folder and a parquet sink:

* s01 ingestion            readStream -> writeStream (append, exactly once)
* s02 counters             window(1 h) x model x version x outcome counts
* s03 latency histogram    window(1 h) cumulative bucket counts + sum + count
* s03 latency percentiles  window(1 h) mergeable KLL sketch as aggregation state
* s04 rate over 1 h        counter deltas (reset aware) summed per hour / 3600: in batch, and as a
                           stream with the last sample of every series as state
* s05 avg_over_time 7 d    sliding window(7 days, 1 day) mean
* s06 drift per batch      foreachBatch -> two-sample KS vs the reference -> alerts
* s07 new files trigger    availableNow runs pick up only unseen files
* s08 idempotent ingest    dropDuplicatesWithinWatermark(event_id)

Time handling: log timestamps are zone-less; they are mapped to instants as
UTC wall-clock (independent of the session zone), so window boundaries fall on
wall-clock hours and days, and mapped back for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions.ranks import ordered_previous, ordered_running_sums

EPOCH_NTZ = "1970-01-01 00:00:00"

# Default watermark delay: the known lateness of the log, which is a day, the time between two deliveries.
LATENESS = "1 day"

# Latency histogram bucket bounds in ms (cumulative "le" buckets).
LATENCY_BUCKETS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def ntz_to_instant(c: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c)
    return F.timestamp_micros(micros)


def instant_to_ntz(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


# --------------------------------------------------------------------------- staging (tests, replays)

def stage_log_files(log: DataFrame, folder: str, ts: str = "ts", n_files: int = 6,
                    sentinel: dict | None = None, files_per_slice: int | None = None) -> list[str]:
    """Write a log as ``n_files`` time slices, one after another in event-time order (the file
    source orders by modification time), each of as many files as Spark writes or of
    ``files_per_slice``, plus an optional far-future sentinel row that lets the watermark pass
    the last real windows.  Returns the written sub-folders."""
    bounds = log.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()  # two values
    lo, hi = bounds["lo"], bounds["hi"]
    span = (hi - lo) / n_files
    paths = []
    def lit_ntz(v):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")

    for i in range(n_files):
        a = lo + span * i
        part = log.where(F.col(ts) >= lit_ntz(a)) if i == n_files - 1 else \
            log.where((F.col(ts) >= lit_ntz(a)) & (F.col(ts) < lit_ntz(a + span)))
        p = f"{folder}/part-{i:04d}"
        if files_per_slice:
            part = part.repartition(files_per_slice)
        part.write.mode("error").parquet(p)
        paths.append(p)
    if sentinel is not None:
        spark = log.sparkSession
        p = f"{folder}/part-{n_files:04d}-sentinel"
        row = spark.createDataFrame([tuple(sentinel[f.name] for f in log.schema.fields)], log.schema)
        row.write.mode("error").parquet(p)
        paths.append(p)
    return paths


def read_log_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """The log folder as a stream.  ``max_files`` per micro-batch only where a batch must be small: files of one
    time slice that land in different batches are as late as the slice is long, and the watermark delay of the
    query must cover that."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet") -> StreamingQuery:
    """Process everything available, exactly once, then stop (checkpointed: a restart after
    executor or driver loss resumes from the last committed batch)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return q


# --------------------------------------------------------------------------- transformations

def with_event_time(log: DataFrame, ts: str = "ts") -> DataFrame:
    return log.withColumn("event_time", ntz_to_instant(F.col(ts)))


def ingest(log: DataFrame) -> DataFrame:
    """s01: one row per prediction, as logged (schema-enforced)."""
    return log


def counters(log: DataFrame, watermark: str = LATENESS, length: str = "1 hour") -> DataFrame:
    """s02: predictions and errors per hour, model version and outcome."""
    x = with_event_time(log).withWatermark("event_time", watermark)
    outcome = F.when(F.col("is_error") == 1, F.lit("error")).otherwise(F.lit("ok"))
    a = x.groupBy(F.window("event_time", length).alias("w"), "model_version", outcome.alias("outcome")) \
        .agg(F.count("*").alias("requests"), F.sum("num_samples").alias("predictions"))
    return a.select(instant_to_ntz(F.col("w.start")).alias("window_start"), "model_version", "outcome",
                    "requests", "predictions")


def latency_histogram(log: DataFrame, watermark: str = LATENESS, length: str = "1 hour",
                      buckets=LATENCY_BUCKETS) -> DataFrame:
    """s03: cumulative latency bucket counts, sum and count per hour and version."""
    x = with_event_time(log).withWatermark("event_time", watermark)
    aggs = [F.count_if(F.col("latency_ms") <= b).alias(f"le_{int(b)}") for b in buckets]
    a = x.groupBy(F.window("event_time", length).alias("w"), "model_version").agg(
        *aggs, F.count("*").alias("le_inf"), F.sum("latency_ms").alias("latency_sum"))
    return a.select(instant_to_ntz(F.col("w.start")).alias("window_start"), "model_version",
                    *[f"le_{int(b)}" for b in buckets], "le_inf", "latency_sum")


def latency_percentiles(log: DataFrame, probs: tuple[float, ...] = (0.5, 0.95, 0.99), watermark: str = LATENESS,
                        length: str = "1 hour", k: int = 400) -> DataFrame:
    """s03: percentiles of the latency per window and version (window_start, model_version, n, p50, p95, p99, ...).

    A window's state is one KLL sketch of bounded size, merged from partial sketches: with k = 400 a percentile's rank is
    within 0.7 % of the exact one (99 % confidence), and exact while a window has no more than k values.  NULL
    latencies are left out; a window without any has NULL percentiles.
    """
    x = with_event_time(log).withWatermark("event_time", watermark)
    a = x.groupBy(F.window("event_time", length).alias("w"), "model_version").agg(
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("sketch"), F.count("latency_ms").alias("n"))
    quantile = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return a.select(instant_to_ntz(F.col("w.start")).alias("window_start"), "model_version", "n",
                    *[quantile(p).alias(f"p{round(100 * p, 4):g}".replace(".", "_")) for p in probs])


def counter_series(log: DataFrame, ts: str = "ts", name: str = "event_type") -> DataFrame:
    """A process-restart counter: running count per name that resets every day (as an
    exporter restarted daily would report).  The count is a running sum in (ts, event_id)
    order per (name, day) over range slices, so a hot name-day is not one task."""
    x = log.select(F.col(name).alias("name"), ts, "event_id", F.to_date(ts).alias("_day"), F.lit(1).alias("_one"))
    c = ordered_running_sums(x, ["name", "_day"], [F.col(ts), F.col("event_id")], ["_one"])
    return c.select("name", ts, "event_id", F.col("cum__one").alias("value"))


def rate_1h(series: DataFrame, ts: str = "ts") -> DataFrame:
    """s04: rate(x[1h]) per hour: non-negative increases (a drop is a counter reset, the new
    value counts as the increase) summed over each hour / 3600.

    Every sample after a series' first contributes the increase from its predecessor to its
    own hour -- inside an hour and across the gap from the previous sampled hour alike.  The
    predecessor comes from ``ordered_previous`` (positions over range slices, then a join on
    position), so no task holds a whole series or a whole series-hour."""
    x = series.select("name", ts, "event_id", "value")
    y = ordered_previous(x, ["name"], [F.col(ts), F.col("event_id")], ["value"])
    prev = F.col("prev_value")
    inc = F.when(prev.isNull(), F.lit(0)).when(F.col("value") >= prev, F.col("value") - prev).otherwise(F.col("value"))
    out = y.groupBy("name", F.date_trunc("hour", ts).alias("hour")).agg(F.sum(inc).alias("increase"))
    return out.select("name", "hour", (F.col("increase") / 3600.0).alias("rate_per_s"),
                      F.col("increase").cast("long").alias("increase"))


class _Series:
    """State of one series in ``rate_stream``: the last sample in order, samples ahead of the watermark, sums per slot."""

    def __init__(self):
        self.last, self.waiting, self.slots, self.done = None, [], {}, None

    def settle(self, upto: int, step: int) -> None:
        """Increases of all samples before the watermark, in (time, id) order."""
        ready = sorted(w for w in self.waiting if w[0] < upto)
        self.waiting = [w for w in self.waiting if w[0] >= upto]
        for at, _, value in ready:
            if self.last is not None:
                slot = at // step * step
                self.slots[slot] = self.slots.get(slot, 0.0) + (value - self.last if value >= self.last else value)
            else:
                self.slots.setdefault(at // step * step, 0.0)
            self.last = value

    def finished(self, upto: int, window: int, step: int) -> list[tuple[int, float]]:
        """(end, increase) of the windows with samples that the watermark has passed, each once."""
        ends = {slot + step + k for slot in self.slots for k in range(0, window, step)}
        ends = sorted(e for e in ends if e <= upto and (self.done is None or e > self.done))
        out = [(e, sum(v for s, v in self.slots.items() if e - window <= s < e)) for e in ends]
        if ends:
            self.done = ends[-1]
        self.slots = {s: v for s, v in self.slots.items() if s + window > upto}
        return out

    def next_event(self, upto: int, step: int) -> int | None:
        """When the watermark must wake the series: at its next sample or the next end of a window."""
        nexts = [w[0] for w in self.waiting]
        if self.slots:
            nexts.append(max(upto // step * step, min(self.slots)) + step)
        return max(min(nexts), upto) if nexts else None


def rate_stream(samples: DataFrame, window: int = 3600, step: int = 15, watermark: str = LATENESS) -> DataFrame:
    """s04 as a stream: (name, window_end, rate_per_s, increase) of a counter's samples (name, ts, event_id, value).

    rate(x[window]) every ``step`` seconds (which divides the window), for windows (end - window, end] that have samples;
    a drop is a reset, and the new value the increase; the first sample of a series has none.  State per series: the last
    sample, the samples that the watermark has not passed (they may still be overtaken) and the sums per step of one
    window.  A series' timer fires when the watermark reaches its next sample or window end.  A series is one counter of
    one process and so one key; slots keep what it holds bounded by the window and the watermark's delay.
    """
    import pickle

    from pyspark.sql.streaming.state import GroupStateTimeout

    length, slot = window * 1_000_000, step * 1_000_000

    def update(key, batches, state):
        import pandas as pd
        series = pickle.loads(state.get[0]) if state.exists else _Series()
        for pdf in batches:
            series.waiting += list(zip(pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["value"].astype(float).tolist()))
        upto = max(state.getCurrentWatermarkMs(), 0) * 1000
        series.settle(upto, slot)
        out = series.finished(upto, length, slot)
        state.update((pickle.dumps(series),))
        wake = series.next_event(upto, slot)
        if wake is not None:
            state.setTimeoutTimestamp(wake // 1000 + 1)
        yield pd.DataFrame({"name": [key[0]] * len(out), "end_us": [e for e, _ in out], "increase": [v for _, v in out]})

    x = with_event_time(samples).withWatermark("event_time", watermark)
    x = x.select("name", "event_time", F.unix_micros("event_time").alias("at"), "event_id", "value")
    out = x.groupBy("name").applyInPandasWithState(update, "name string, end_us long, increase double", "series binary", "append",
                                                   GroupStateTimeout.EventTimeTimeout)
    return out.select("name", instant_to_ntz(F.timestamp_micros("end_us")).alias("window_end"),
                      (F.col("increase") / float(window)).alias("rate_per_s"), F.col("increase").cast("long").alias("increase"))


def avg_over_time(history: DataFrame, range_: str = "7 days", step: str = "1 day",
                  watermark: str = LATENESS) -> DataFrame:
    """s05: avg_over_time(x[7d]) evaluated at each day boundary: a sliding window aggregate
    (same plan in batch and streaming; partial aggregation per window)."""
    x = with_event_time(history)
    if history.isStreaming:
        x = x.withWatermark("event_time", watermark)
    a = x.groupBy("name", F.window("event_time", range_, step).alias("w")).agg(
        F.avg("value").alias("avg_value"), F.count("*").alias("n"))
    return a.select("name", instant_to_ntz(F.col("w.start")).alias("window_start"),
                    instant_to_ntz(F.col("w.end")).alias("window_end"), "avg_value", "n")


def dedup_within_watermark(log: DataFrame, key: str = "event_id", watermark: str = LATENESS) -> DataFrame:
    """s08: redelivered log rows (task retries) dropped by key within the watermark delay."""
    return with_event_time(log).withWatermark("event_time", watermark) \
        .dropDuplicatesWithinWatermark([key]).drop("event_time")


def drift_per_batch(reference: DataFrame, numeric: list[str], categorical: list[str], alerts_path: str):
    """s06: foreachBatch function -- each micro-batch is tested against the reference
    (two-sample KS / chi-square) and its per-column results are the partition ``batch_id`` of an
    alerts table, which a retried batch overwrites."""
    from vigil.operators.monitor import column_drift
    from vigil.sources.io import write_batch

    def fn(batch: DataFrame, batch_id: int):
        write_batch(column_drift(reference, batch, numeric, categorical), alerts_path, batch_id)

    return fn
