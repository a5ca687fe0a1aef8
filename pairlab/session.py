"""SparkSession helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pairlab") -> SparkSession:
    """Build (or reuse) a session tuned for this library.

    AQE is on so that shuffle partition counts coalesce at runtime and skewed
    join partitions are split; the UI server stays off.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAIRLAB_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points to shared storage and is respected as is.
    Only a local-mode session (one machine) that has none gets a private
    folder; on a cluster the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pairlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make ``pairlab`` importable in every Python worker (pandas UDFs and
    mapInPandas functions are pickled by module reference). The package is
    zipped once per SparkContext and distributed with ``addPyFile``, which is
    how executors on a cluster receive it."""
    sc = spark.sparkContext
    if getattr(sc, "_pairlab_shipped", False):
        return
    import zipfile

    import pairlab

    pkg = os.path.dirname(os.path.abspath(pairlab.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="pairlab-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._pairlab_shipped = True


def materialize(df):
    """Cut the lineage of a table that later jobs reuse: compute it once, write
    it as Parquet under the shared ``spark.checkpoint.dir`` and continue from
    these files. There is one compressed copy, of which a later job reads the
    columns it needs; a lost executor costs a re-read, not a replay of the whole
    upstream plan."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
