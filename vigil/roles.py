"""Column roles and thresholds.

Roles follow the reference's name conventions: target ``target``, never-
feature columns ``id``, ``date``, ``target``, join key ``customer_id`` and
scoring outputs ``prediction``, ``prediction_timestamp``, ``model_version``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import (BooleanType, DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)


@dataclass(frozen=True)
class Roles:
    target: str = "target"
    keys: tuple[str, ...] = ("id",)
    time: str | None = "date"
    sensitive: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("id", "date", "target", "prediction", "prediction_timestamp",
                                "model_version")

    def features(self, df: DataFrame) -> list[str]:
        drop = set(self.exclude) | set(self.keys) | {self.target}
        if self.time:
            drop.add(self.time)
        return [c for c in df.columns if c not in drop]


def family(dt) -> str:
    """numeric / categorical / datetime / other, the three families the reference dispatches on."""
    if isinstance(dt, NumericType):
        return "numeric"
    if isinstance(dt, (StringType, BooleanType)):
        return "categorical"
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, fam: str, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) == fam and f.name not in exclude]


@dataclass(frozen=True)
class DatamartRules:
    min_rows: int = 1000
    strict: bool = False                      # e02: rows must be > min_rows
    required: tuple[str, ...] = ("customer_id", "date", "target")
    critical: tuple[str, ...] = ("customer_id", "date", "target")
    dedup_keys: tuple[str, ...] = ("customer_id", "date")


@dataclass(frozen=True)
class FairnessLimits:
    # Reference compliance thresholds.
    demographic_parity: float = 0.1
    equal_opportunity: float = 0.1
    equalized_odds: float = 0.1
    disparate_impact: float = 0.8
    predictive_parity: float = 0.1
    intersectional: float = 0.15
    severe: float = 0.2


@dataclass(frozen=True)
class ReleaseLimits:
    # Canary limits (error 5 %, p95 200 ms, accuracy drop 3 %, 2x production errors).
    max_error_rate: float = 0.05
    max_latency_p95_ms: float = 200.0
    max_accuracy_drop: float = 0.03
    error_ratio_vs_production: float = 2.0
    stages: tuple[int, ...] = field(default=(5, 10, 25, 50, 100))
