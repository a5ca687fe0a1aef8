"""Streaming form of the resumable generation run.

Prompt files dropped into an input folder are picked up by a Structured
Streaming file source; each micro-batch goes through the pluggable batch
generator (``mapInPandas``) inside ``foreachBatch`` and is written to the
output folder as ``batch=<id>``. The checkpoint location records which input files were
consumed, so a restarted query continues where it stopped and never
reprocesses a committed batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairlab.operators.inference import Generator, generate

PROMPT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("prompt", T.StringType())])


def start_generation_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                            factory: Callable[[], Generator], max_files_per_trigger: int = 1,
                            available_now: bool = True):
    """Start the stream; with ``available_now`` it drains the folder and stops."""
    src = (spark.readStream.schema(PROMPT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(input_dir))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # a batch that is replayed after a crash replaces what it had written
        generate(batch, factory, "id", "prompt").write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")

    w = src.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
