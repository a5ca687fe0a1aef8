"""L3: gating experiment as one Spark plan.

restrict pairs to test originals (C8) -> gold + inputs per id (E7/E8/B14) ->
leakage check against train (C10) -> stratified sample (E6) -> gate threshold
calibrated on val (D13) -> gate decision + quadrant (B13) -> generation (I1, a
pluggable column or batch generator) -> overlap filter (B15) -> route (B12) ->
per-row scores once (I5: SARI, ED 1.5, TER) -> table per quadrant (D28).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.text import tokenize
from pairlab.operators import gating as G
from pairlab.operators import metrics as M
from pairlab.operators import sampling
from pairlab.session import materialize
from pairlab.sources.fixtures import long_share, stub_generate

ID = "original_sentence_idx"


def gate_score(text: Column) -> Column:
    """Stand-in complexity classifier score: share of long words of the text."""
    return long_share(tokenize(text))


def gating_rows(pairs: DataFrame | Callable[[DataFrame, bool], DataFrame], sentences: DataFrame,
                rows_of: Callable[[DataFrame, bool], DataFrame] | None = None, with_texts: bool = True) -> DataFrame:
    """The gating inputs of the test originals. ``pairs``: the pair table, or what
    returns its rows of some ids, with their texts or without, so that no other
    pair is derived. Not ``with_texts``: scores and labels alone."""
    test_ids = sentences.where(F.col("split") == "test").select(ID).distinct()
    if isinstance(pairs, DataFrame):
        return G.gating_inputs(pairs.join(test_ids, ID, "left_semi"), rows_of=rows_of)
    numbers = pairs(test_ids, False)
    return G.gating_inputs(pairs(test_ids, True), rows_of=rows_of, numbers=numbers) if with_texts else G.gating_inputs(numbers)


def calibrated_gate(sentences: DataFrame) -> float:
    val = sentences.where(F.col("split") == "val").select(
        gate_score(F.col("text")).alias("pred"), F.col("is_original").cast("int").alias("label"))
    return M.calibrate_threshold(val, "pred", "label").first()["thr"]


def gated_sample(pairs: DataFrame | Callable[[DataFrame, bool], DataFrame], sentences: DataFrame, n_sample: int | None = 10_000,
                 score: Callable[[Column], Column] = gate_score,
                 rows_of: Callable[[DataFrame, bool], DataFrame] | None = None) -> DataFrame:
    """Gating rows with the gate's decision and quadrant: a stratified sample of
    ``n_sample`` rows (E6), or all rows for None."""
    smp = gating_rows(pairs, sentences, rows_of)
    if n_sample is not None:
        smp = smp.persist(StorageLevel.MEMORY_AND_DISK)   # read by allocation, ranks and sample
        smp = sampling.stratified_sample(smp, "true_label", "gid", n_sample)
    thr = calibrated_gate(sentences)
    smp = smp.withColumn("pred_gate", (F.round(score(F.col("input_text")), M.QUANT_DIGITS) > F.lit(thr)).cast("int"))
    return smp.withColumn("quadrante", G.quadrant())


def stub_output(df: DataFrame) -> DataFrame:
    return df.withColumn("gen_output", stub_generate(F.col("input_text"), F.col("input_text")))


def gating_experiment(pairs: DataFrame | Callable[[DataFrame, bool], DataFrame], sentences: DataFrame, n_sample: int | None = 10_000, with_ter: bool = True,
                      generate: Callable[[DataFrame], DataFrame] = stub_output,
                      rows_of: Callable[[DataFrame, bool], DataFrame] | None = None) -> DataFrame:
    """Returns the scored rows (checkpointed: the table and any drill-down reuse them)."""
    smp = gated_sample(pairs, sentences, n_sample, rows_of=rows_of)
    out = generate(smp)
    clean = G.overlap_filter(out)
    scored = G.score_conditions(G.route(clean), with_ter=with_ter)
    return materialize(scored)   # per-row scores computed once, reused by every table
