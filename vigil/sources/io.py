"""Sources and sinks (a01-a12).

Lake I/O is plain ``DataFrameReader`` / ``DataFrameWriter`` / catalog SQL.
Output folders live under the shared folder the cluster names in
``spark.checkpoint.dir`` (never a machine-local temporary folder), each
write into a fresh sub-folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampNTZType, TimestampType

from vigil.session import ensure_checkpoint_dir


def work_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vigil-out/{name}-{uuid.uuid4().hex[:12]}"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """a01."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error",
                  partition_by: list[str] | None = None, compression: str = "snappy") -> str:
    """a02: write, return the URI."""
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """a03: (path, length, modificationTime) of data files under a prefix, every page.

    ``binaryFile`` prunes the ``content`` column, so only the listing is read.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
            .option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for n, df in tables.items():
        df.createOrReplaceTempView(n)


def lake_query(spark: SparkSession, sql: str, database: str | None = None) -> DataFrame:
    """a04: SQL over the lake."""
    if database:
        spark.catalog.setCurrentDatabase(database)
    return spark.sql(sql)


def create_feature_table(spark: SparkSession, name: str, schema: dict[str, str],
                         partitions: list[str] | None = None, location: str | None = None,
                         provider: str = "parquet") -> None:
    """a05: ``CREATE TABLE IF NOT EXISTS`` with columns, partitions and location."""
    cols = ", ".join(f"`{c}` {t}" for c, t in schema.items())
    ddl = f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING {provider}"
    if partitions:
        ddl += " PARTITIONED BY (" + ", ".join(f"`{p}`" for p in partitions) + ")"
    if location:
        ddl += f" LOCATION '{location}'"
    spark.sql(ddl)


def write_features(df: DataFrame, table: str, mode: str = "append") -> None:
    """a06: append / overwrite into an existing table (columns matched by name)."""
    spark = df.sparkSession
    cols = spark.table(table).columns
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    out = df.select(*cols)
    if parts:
        # Cluster rows by partition value so each task writes few partitions (no small-file
        # explosion); adaptive execution splits a hot partition value over several tasks.
        out = out.hint("rebalance", *parts)
    out.write.mode(mode).insertInto(table, overwrite=(mode == "overwrite"))


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> str:
    """a06 / j02: replace exactly the partitions that ``df`` has rows of, and leave the others as they are.

    Writing the same batch again, after a failure or by mistake, changes nothing.
    """
    (df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
    return path


def write_batch(df: DataFrame, path: str, batch_id) -> str:
    """One batch of a growing table, in its own partition ``batch_id``: a retry replaces what an earlier try wrote.

    The files of a batch count once its marker stands beside them, which is written last, so a batch that was lost
    half-way is not read; ``read_batches`` reads the marked ones.
    """
    spark, at = df.sparkSession, f"{path}/batch_id={batch_id}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_done/{batch_id}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path, False)
    df.write.mode("overwrite").parquet(at)
    fs.create(fs_path, True).close()
    return at


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All finished batches of ``write_batch`` with their ``batch_id``; at least one must be there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_done")
    names = [f.getPath().getName() for f in done.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(done)]
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={n}" for n in sorted(names)])


def read_features(spark: SparkSession, table: str, where: str | None = None,
                  columns: list[str] | None = None) -> DataFrame:
    """a07: table scan with a WHERE text (pushed down to the files / partitions)."""
    df = spark.table(table)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """a08: CSV with header; an explicit schema avoids the inference pass at scale."""
    r = spark.read.option("header", "true")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str],
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """a09: JDBC scan, range-partitioned on a numeric column when given (not testable here)."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                               upperBound=upper, numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def _canonical(df: DataFrame):
    """Engine-neutral text of each column: floats as decimal(38,6), everything else as string; backslashes and
    the separator are escaped."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = c.cast("decimal(38,6)")
        text = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        out.append(F.coalesce(text, F.lit("\\N")))
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """a11: order-free content fingerprint of a snapshot.

    Each row's canonical text is hashed with md5; the first 8 hex digits are
    summed (decimal, no overflow) and combined with the row count: one
    aggregate with partial sums, no sort, no driver work.
    """
    row_txt = F.concat_ws("|", *_canonical(df))
    h = F.conv(F.substring(F.md5(row_txt), 1, 8), 16, 10).cast("decimal(38,0)")
    agg = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("content_sum"))
    return agg.select("n_rows", F.col("content_sum").cast("string").alias("content_sum"),
                      F.substring(F.md5(F.concat_ws(":", F.col("n_rows").cast("string"),
                                                    F.col("content_sum").cast("string"))), 1, 8)
                      .alias("fingerprint"))


def to_json_report(df: DataFrame) -> DataFrame:
    """a12: one JSON document per metric row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def write_json_report(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def promote_bronze(raw: DataFrame, path: str, extraction_date: str) -> str:
    """a10 bronze: raw copy partitioned by extraction date; appends, never overwrites."""
    (raw.withColumn("extraction_date", F.lit(extraction_date).cast("date"))
        .write.mode("append").partitionBy("extraction_date").parquet(path))
    return path


def promote_silver(bronze: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """a10 silver: casts, text normalisation, dedup (latest extraction wins), filter, join."""
    from vigil.operators.relational import dedup_keep_last
    norm = bronze.select(
        F.col("o_orderkey").cast("long").alias("order_id"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.lower(F.trim("o_orderpriority")).alias("priority"),
        F.col("o_totalprice").cast("double").alias("amount"),
        "extraction_date")
    dedup = dedup_keep_last(norm, ["order_id"], ["extraction_date"])
    dims = customer.select(F.col("c_custkey").alias("customer_id"), "c_nationkey").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    return dedup.where(F.col("amount") > 0).join(dims, "customer_id", "left").drop("c_nationkey")


def promote_gold(silver: DataFrame, path: str) -> str:
    """a10 gold: KPI aggregate per nation and year, written partitioned by year."""
    kpi = (silver.groupBy("n_name", F.year("order_date").alias("year"))
           .agg(F.count("*").alias("n_orders"), F.sum("amount").alias("revenue"),
                F.avg("amount").alias("avg_order_value"),
                F.countDistinct("customer_id").alias("n_customers")))
    kpi.write.mode("overwrite").partitionBy("year").parquet(path)
    return path
