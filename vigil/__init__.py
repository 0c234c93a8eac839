"""vigil: ML data operations on Spark.

Feature-table I/O, datamart validation, profiling, statistical tests,
feature preparation, evaluation, scoring, drift / performance monitoring,
fairness and robustness audits, business-impact metrics, release
comparison and streaming telemetry -- each one a DataFrame -> DataFrame
operator built from Spark's relational, window, MLlib and streaming
primitives.
"""

__version__ = "0.1.0"
