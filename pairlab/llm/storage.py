"""Shared scratch storage: every intermediate table lives in the folder that
the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A local-mode session
    (one process, one machine) that has none gets a private folder; a cluster
    session without the setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pairlab-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared root."""
    return f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to shared storage, go on from the
    files. A lost executor then costs a re-read, not the whole upstream."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
