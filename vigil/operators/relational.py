"""Projections, filters, sampling, dedup and joins (b01-b14, c01-c04).

All of these are narrow transformations except dedup (one shuffle on the
key, with map-side partial aggregation), duplicate detection (one shuffle on
the full row) and top-k (per-partition heaps, no global sort).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ranks import join_null_safe
from vigil.functions.exprs import md5_uniform
from vigil.roles import Roles, family


def split_target(df: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """b01: (features, target) projections of one table."""
    return df.drop(target), df.select(target)


def feature_frame(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """b02: all columns except keys, time, target and scoring outputs."""
    return df.select(*roles.features(df))


def column_families(df: DataFrame) -> DataFrame:
    """b03: (column, dtype, family) table built from the schema (metadata only)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), family(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, dtype string, family string")


def _as_date(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (_dt.date, _dt.datetime)):
        v = v.isoformat()[:10]
    return F.lit(str(v)).cast("date")


def trailing_window(df: DataFrame, as_of, days: int = 30, date_col: str = "date") -> DataFrame:
    """b04: rows with date >= as_of - days (as_of is a parameter, never now())."""
    return df.where(F.col(date_col) >= F.date_sub(_as_date(as_of), int(days)))


def pending_rows(df: DataFrame, as_of, date_col: str = "date",
                 stamp_col: str = "prediction_timestamp", fail_if_empty: bool = False) -> DataFrame:
    """b05: rows of the day not yet scored; optional error when there are none."""
    out = df.where((F.col(date_col) == _as_date(as_of)) & F.col(stamp_col).isNull())
    if fail_if_empty and out.isEmpty():
        raise ValueError("no pending rows to score")
    return out


def period_filter(df: DataFrame, ts_col: str, start=None, end=None) -> DataFrame:
    """b06: inclusive period filter; either bound may be omitted."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts_col) >= F.lit(start).cast(df.schema[ts_col].dataType))
    if end is not None:
        cond = cond & (F.col(ts_col) <= F.lit(end).cast(df.schema[ts_col].dataType))
    return df.where(cond)


def last_n_days(df: DataFrame, ts_col: str, as_of, days: int) -> DataFrame:
    """b07: ts >= as_of - days."""
    dt = df.schema[ts_col].dataType
    return df.where(F.col(ts_col) >= F.timestamp_add("DAY", F.lit(-int(days)), F.lit(as_of).cast(dt)))


def bounded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """b08: min(n, rows) rows chosen by a keyed hash (deterministic, no global sort:
    ``orderBy().limit()`` plans as TakeOrderedAndProject)."""
    return (df.withColumn("_u", md5_uniform(key, seed))
            .orderBy("_u", key).limit(int(n)).drop("_u"))


def dedup_keep_last(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """b09: one row per key, the greatest by ``order_by`` (list ends with a unique column).

    Expressed as ``max_by`` of the row struct: a hash aggregate with map-side
    partial aggregation, so a hot key is reduced before the shuffle instead of
    being sorted in one task as a row_number window would.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = (df.groupBy(*keys)
           .agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row")))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def duplicate_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """b10: repeats beyond the first, number of duplicate groups, rows in such groups."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count("*").alias("cnt"))
    return g.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                 F.count_if(F.col("cnt") > 1).cast("long").alias("n_groups"),
                 F.coalesce(F.sum(F.when(F.col("cnt") > 1, F.col("cnt"))), F.lit(0))
                 .cast("long").alias("n_rows_in_groups"))


def duplicate_members(df: DataFrame, cols: list[str]) -> DataFrame:
    """b10: every row of a duplicate group (semi join with the groups; AQE splits hot keys)."""
    groups = df.groupBy(*cols).agg(F.count("*").alias("cnt")).where("cnt > 1").drop("cnt")
    return join_null_safe(df, groups, cols, "left_semi")   # NULL equals NULL here


def append_prediction(df: DataFrame, prediction: Column, model_version: str, scored_at) -> DataFrame:
    """b11: prediction, prediction timestamp and model version columns."""
    return df.withColumns({"prediction": prediction,
                           "prediction_timestamp": F.lit(scored_at).cast("timestamp_ntz"),
                           "model_version": F.lit(model_version)})


# Risk bands (p > 0.7 high, 0.4-0.7 medium, < 0.4 low).
RISK_HIGH = 0.7
RISK_MEDIUM = 0.4


def risk_band(df: DataFrame, prob: str = "probability") -> DataFrame:
    """b12."""
    p = F.col(prob)
    return df.withColumn("risk_band", F.when(p > RISK_HIGH, "high")
                         .when(p >= RISK_MEDIUM, "medium").otherwise("low"))


def review_queue(df: DataFrame, prob: str = "probability", lo: float = 0.4, hi: float = 0.6) -> DataFrame:
    """b13: uncertain predictions for human review."""
    return df.where(F.col(prob).between(lo, hi))


def high_risk_list(df: DataFrame, k: int, prob: str = "probability", key: str = "customer_id") -> DataFrame:
    """b14: top-k by probability (ties by key) -- a top-k report, limit is the feature."""
    return df.orderBy(F.col(prob).desc(), F.col(key)).limit(int(k))


def enrich(df: DataFrame, dims: list[tuple[DataFrame, list[str] | str]]) -> DataFrame:
    """c02: left joins to reference tables.  No hint: Spark broadcasts a side only
    when its measured size is under ``autoBroadcastJoinThreshold`` (AQE re-checks at run
    time), otherwise it shuffles both sides."""
    for dim, on in dims:
        df = df.join(dim, on=on, how="left")
    return df


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """c03: child rows whose key is missing in the parent (anti join)."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(p, on=child_key, how="left_anti")


def referential_integrity(spark: SparkSession, checks: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """c03: (child, parent, n_orphans) per check, one anti join each, unioned."""
    out = None
    for child_name, child, ck, parent_name, parent, pk in checks:
        r = orphans(child.select(ck), parent, ck, pk).agg(F.count("*").alias("n_orphans")).select(
            F.lit(child_name).alias("child"), F.lit(ck).alias("child_key"),
            F.lit(parent_name).alias("parent"), F.col("n_orphans"))
        out = r if out is None else out.unionByName(r)
    return out
