"""Batch generation jobs.

``generate`` runs a pluggable text generator over a DataFrame with
``mapInPandas``: partitions are the shards, the model is loaded once per
Python worker (``factory()``), inputs go through it in fixed-size batches, and
every output row carries its input id, so nothing depends on positions.

``resumable_generate`` makes a long run restartable: finished ids are read
back from the output folder (unreadable parts are skipped), the remaining
inputs are split into chunks by id hash and each chunk is written as its own
committed Parquet job under ``run=<run_id>``, so an interrupted run loses at
most the chunk in flight and a resumed run never overwrites earlier parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.hashing import md5_bucket
from pairlab.sources.io import read_tolerant

Generator = Callable[[list[str]], list[str]]
OUT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("response", T.StringType())])


def generate(df: DataFrame, factory: Callable[[], Generator], id_col: str = "id", text_col: str = "prompt",
             batch_size: int = 16) -> DataFrame:
    """Sharded batch generation. Returns id, response."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = factory()   # one model load per task
        for pdf in batches:
            ids, texts = pdf[id_col].tolist(), pdf[text_col].tolist()
            out: list[str] = []
            for i in range(0, len(texts), batch_size):
                out.extend(gen(texts[i:i + batch_size]))
            if len(out) != len(ids):
                raise ValueError(f"generator returned {len(out)} outputs for {len(ids)} inputs")
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "response": out})
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)) \
        .mapInPandas(run, OUT_SCHEMA)


def finished_ids(spark: SparkSession, out_dir: str) -> DataFrame:
    """Ids already present in the output folder (corrupt parts ignored)."""
    try:
        return read_tolerant(spark, out_dir, T.StructType(OUT_SCHEMA.fields + [T.StructField("run", T.StringType())])) \
            .select("id").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType())]))


def resumable_generate(inputs: DataFrame, out_dir: str, run_id: str, factory: Callable[[], Generator],
                       id_col: str = "id", text_col: str = "prompt", n_chunks: int = 4,
                       batch_size: int = 16, stop_after_chunks: int | None = None) -> int:
    """Generate what is not finished yet, committing one chunk at a time.

    Returns the number of chunks written. ``stop_after_chunks`` simulates an
    interruption (used by tests and the demo query)."""
    spark = inputs.sparkSession
    todo = inputs.join(finished_ids(spark, out_dir).withColumnRenamed("id", id_col), id_col, "left_anti")   # C6
    todo = todo.withColumn("_chunk", md5_bucket(F.col(id_col), mod=n_chunks)).persist(StorageLevel.MEMORY_AND_DISK)
    written = 0
    try:   # one scan and one anti-join for all chunks
        for c in range(n_chunks):
            if stop_after_chunks is not None and written >= stop_after_chunks:
                break
            out = generate(todo.where(F.col("_chunk") == c), factory, id_col, text_col, batch_size)
            out.withColumn("chunk", F.lit(c)).write.mode("append").parquet(f"{out_dir}/run={run_id}")
            written += 1
    finally:
        todo.unpersist()
    return written


def merge_results(inputs: DataFrame, out_dir: str, id_col: str = "id") -> DataFrame:
    """I3 + C7: every input with its response ('' when missing; the latest run
    wins when an id was produced twice) and a ``missing`` flag."""
    spark = inputs.sparkSession
    parts = read_tolerant(spark, out_dir)
    latest = parts.groupBy("id").agg(F.max_by("response", F.struct("run", "chunk")).alias("response"))
    j = inputs.select(F.col(id_col).cast("long").alias("id")).join(latest, "id", "left")
    return j.select("id", F.coalesce("response", F.lit("")).alias("response"),
                    F.col("response").isNull().alias("missing"))


def restore_order(inputs: DataFrame, outputs: DataFrame, id_col: str = "id", strict: bool = True) -> DataFrame:
    """Outputs matched to inputs by global id (never by position), sorted
    by id for export. If ``strict``, an input without exactly one output, or an
    output without an input, raises while the plan runs."""
    if not strict:
        return inputs.join(outputs, id_col, "left").orderBy(id_col)
    values = [c for c in outputs.columns if c != id_col]
    once = outputs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*values)).alias("_out"))
    j = inputs.withColumn("_in", F.lit(True)).join(once, id_col, "full")
    fits = F.when((F.col("_n") == 1) & F.col("_in"), True).otherwise(F.raise_error(F.concat(
        F.lit("inputs and outputs do not match at id "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast("boolean"))
    return j.where(fits).select(*inputs.columns, *[F.col("_out")[c].alias(c) for c in values]).orderBy(id_col)


Scorer = Callable[[list[str]], list[float]]
SCORE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])


def score(df: DataFrame, factory: Callable[[], Scorer], id_col: str = "id", text_col: str = "text",
          batch_size: int = 64) -> DataFrame:
    """I4: batched classifier scoring with a pluggable scorer (one load per
    task, fixed-size batches), keyed by id. Returns id, score."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = factory()
        for pdf in batches:
            texts = pdf[text_col].tolist()
            out: list[float] = []
            for i in range(0, len(texts), batch_size):
                out.extend(f(texts[i:i + batch_size]))
            yield pd.DataFrame({"id": pdf[id_col].astype("int64"), "score": pd.Series(out, dtype="float64")})
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)) \
        .mapInPandas(run, SCORE_SCHEMA)
