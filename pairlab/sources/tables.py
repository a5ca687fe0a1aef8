"""A1/A2: Parquet scans of the input tables.

Only the requested columns are read (``ReadSchema`` is pruned) and filters
written on the result are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """A1: ``spark.read.parquet`` with column pruning."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def write_domains(df: DataFrame, path: str, domain: str) -> None:
    """A2: one folder ``domain=...`` for each value of column ``domain``; the rows
    of a domain stay in the tasks that hold them, so a large domain is no hot task."""
    df.withColumnRenamed(domain, "domain").write.partitionBy("domain").parquet(path)


def load_domain(spark: SparkSession, path: str, domain: str | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """A2: dataset source by domain; a ``domain=`` partition filter prunes
    directories at planning time, a column list prunes the Parquet read."""
    df = spark.read.parquet(path)
    if domain is not None:
        df = df.where(df["domain"] == domain)
    return df.select(*columns) if columns else df


#: Stored bytes of a text table that one task takes, about: it derives many times as much from them.
TASK_BYTES = 24_000_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition ``df`` on ``key`` when the scan yields fewer partitions
    than the cluster has cores (e.g. one big file), so the CPU-heavy text work
    that follows runs on every core, or partitions of far more than
    ``TASK_BYTES``, so that what a task derives and sorts fits its memory. With
    many smaller partitions this is a no-op."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    scan = df.rdd.getNumPartitions()
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))   # of the columns read
    wanted = max(-(-stored // TASK_BYTES), cores * 2 if scan < cores else 0)
    if wanted >= 2 * scan or scan < cores:
        return df.repartition(wanted, key)
    return df
