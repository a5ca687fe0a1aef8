"""Sinks and sources (A3-A8). Paths live under a shared folder: callers pass
one explicitly, or ``scratch_path`` derives a fresh one under the session's
``spark.checkpoint.dir`` (shared storage on a cluster)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pairlab/{name}-{uuid.uuid4().hex[:12]}"


def write_splits(sentences: DataFrame, path: str) -> None:
    """A3: Parquet sink partitioned by split (overwrite)."""
    sentences.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A2/A3 read-back: a ``split=`` filter prunes partition directories."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_csv(df: DataFrame, path: str) -> None:
    """A4: CSV with header (overwrite)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A4 read-back with an explicit schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A5: metrics document(s) as JSON lines (overwrite)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.option("multiLine", multiline).json(path)


def write_nested(df: DataFrame, path: str) -> None:
    """Nested record store (arrays/structs/maps) as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon text: per line strip, first tab field, first comma field,
    lower-case; empty lines and lines starting with '#' skipped; distinct."""
    raw = spark.read.text(path)
    w = F.lower(F.split(F.split(F.trim(F.col("value")), "\t").getItem(0), ",").getItem(0))
    return raw.select(w.alias("lemma")).where((F.col("lemma") != "") & ~F.col("lemma").startswith("#")).distinct()


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  recursive: bool = False) -> DataFrame:
    """Scan a folder of Parquet parts, skipping unreadable (corrupt or
    truncated) files instead of failing the job. Partition folders such as
    ``run=...`` are discovered unless ``recursive`` lookup is requested."""
    r = spark.read.option("ignoreCorruptFiles", True)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)
