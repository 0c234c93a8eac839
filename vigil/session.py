"""Session helpers.

Operators never create sessions; they take DataFrames.  These helpers exist
for scripts, tests and the bench: they build a session with the settings the
library assumes (AQE with skew-join handling, UTC, Arrow) and resolve the
checkpoint folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "vigil",
                  shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    parts = shuffle_partitions or os.environ.get("VIGIL_SHUFFLE_PARTITIONS")
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    if (master or "").startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it this raises there.  Only a ``local`` master (tests) gets
    a fresh local folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all nodes share")
        d = tempfile.mkdtemp(prefix="vigil-ckpt-")   # one JVM: every task sees it
        try:
            spark.conf.set(CHECKPOINT_CONF, d)
        except Exception:  # noqa: BLE001 -- core conf not settable at runtime: the context keeps it
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet into the shared folder and read back (survives executor loss)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigil-cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
