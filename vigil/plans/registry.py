"""Registration of catalog queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampNTZType, TimestampType

from vigil.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

ROUND_DP = 6


# Integer columns that can hold NULL (lags, bins of NULL inputs): compared as doubles, since
# pandas turns a nullable integer into float64 on one engine and Int64 on the other.
NULLABLE_INTEGERS: dict[str, tuple[str, ...]] = {
    "e11_volume_changes": ("prev_n",),
    "h09_rolling_point_in_time": ("days_since_last",),
    "h11_quartile_bins": ("f_total_q4",),
}

# Boolean columns that can hold NULL (a pass flag of an undefined spread): compared as text.
NULLABLE_BOOLEANS: dict[str, tuple[str, ...]] = {
    n: ("passes",) for n in ("l01_demographic_parity", "l02_equal_opportunity", "l03_equalized_odds",
                             "l04_disparate_impact", "l05_predictive_parity", "l02_l03_planted_bias",
                             "l07_fairness_summary", "l08_intersectional", "l10_severe_bias",
                             "l11_audit_report")
}


def finish(df: DataFrame, nd: int = ROUND_DP, as_double: tuple[str, ...] = (),
           as_text: tuple[str, ...] = ()) -> DataFrame:
    """Round every floating column so that engines agree to the last digit.

    round(x * 10^nd) / 10^nd (+ 0.0 to fold -0.0 into 0.0): the scaled product is the
    same binary double in every engine, so half-way cases round the same way.
    """
    scale = float(10 ** nd)
    if as_double or as_text:
        df = df.withColumns({**{c: F.col(c).cast("double") for c in as_double},
                             **{c: F.col(c).cast("string") for c in as_text}})
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            x = F.col(f"`{f.name}`").cast("double")
            cols.append((F.round(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (DateType, TimestampNTZType, TimestampType)):
            # ISO text ('2024-01-01', '2024-01-01 00:00:07.179575'): the same characters in every
            # engine, while their native date types convert differently to pandas
            cols.append(F.col(f"`{f.name}`").cast("string").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# Date / timestamp output columns per query: rendered as ISO text on both sides (see ``finish``).
TEMPORAL_COLUMNS: dict[str, tuple[str, ...]] = {
    "a02_write_parquet": ("date", "prediction_timestamp"),
    "a05_create_feature_table": ("date", "prediction_timestamp"),
    "a06_write_features_modes": ("date", "prediction_timestamp"),
    "b01_split_features": ("date", "prediction_timestamp"),
    "b04_trailing_window": ("date", "prediction_timestamp"),
    "b05_pending_rows": ("date", "prediction_timestamp"),
    "b06_period_filter": ("ts",),
    "b07_last_n_days": ("ts",),
    "b08_bounded_sample": ("date", "prediction_timestamp"),
    "b09_dedup_keep_last": ("date", "prediction_timestamp"),
    "b10_duplicate_members": ("date", "prediction_timestamp"),
    "b11_append_prediction": ("date", "prediction_timestamp"),
    "e01_datamart_dedup": ("date", "prediction_timestamp"),
    "e11_volume_changes": ("day",),
    "f08_temporal_coverage": ("min_day", "max_day"),
    "h05_temporal_split": ("date",),
    "h06_time_series_folds": ("first_day", "last_day"),
    "h09_rolling_point_in_time": ("o_orderdate",),
    "h18_forward_fill": ("date",),
    "i14_leaderboard": ("ts",),
    "i15_latest_versions": ("ts",),
    "j01_batch_score": ("date", "prediction_timestamp"),
    "j05_volume_spikes": ("day",),
    "k11_reference_roll_forward": ("ts",),
    "s01_log_ingestion": ("ts",),
    "s02_counters": ("window_start",),
    "s03_latency_histogram": ("window_start",),
    "s04_rate_1h": ("hour",),
    "s05_avg_over_time_7d": ("window_start", "window_end"),
    "s07_new_files_trigger": ("ts",),
    "s08_idempotent_ingestion": ("ts",),
}


def rounded(sql: str, doubles: tuple[str, ...] | list[str] = (), nd: int = ROUND_DP,
            temporals: tuple[str, ...] | list[str] = (), texts: tuple[str, ...] | list[str] = ()) -> str:
    """Wrap oracle SQL so the listed floating columns are rounded and the temporal columns
    rendered as text, exactly as ``finish`` does on the Spark side."""
    if not doubles and not temporals and not texts:
        return sql
    scale = float(10 ** nd)
    rep = ", ".join([f'round(("{c}")::DOUBLE * {scale!r}) / {scale!r} + 0.0 AS "{c}"' for c in doubles]
                    + [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in (*temporals, *texts)])
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def query(name: str, oracle: str | None = None, doubles: tuple[str, ...] = (), raw: bool = False):
    """Register ``fn(t: Tables) -> DataFrame`` as catalog query ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df if raw else finish(df, as_double=NULLABLE_INTEGERS.get(name, ()),
                                         as_text=NULLABLE_BOOLEANS.get(name, ()))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = rounded(oracle, (*doubles, *NULLABLE_INTEGERS.get(name, ())),
                                   temporals=TEMPORAL_COLUMNS.get(name, ()), texts=NULLABLE_BOOLEANS.get(name, ()))
        return fn

    return deco
