"""Gating experiment operators.

Question: does routing only the inputs a complexity classifier flags as
complex through a simplifier (condition B) beat simplifying everything
(condition A)? Everything is keyed by the input row id ``gid``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.editdist import word_edit_distance
from pairlab.functions.sari import with_sari
from pairlab.functions.ter import ter
from pairlab.functions.text import lexical_overlap
from pairlab.operators.prep import gain
from pairlab.operators.sampling import rows_at

ID = "original_sentence_idx"
ROW_STRIDE = 11                 # gid = id * 11 + variant (0..9), originals use variant 10
QUADRANTS = ("TP", "FN", "TN", "FP")
TOTAL_LABEL = "TOTALE"
METRICS = ("sari_A", "ed_A", "ter_A", "sari_B", "ed_B", "ter_B")


def gating_inputs(pairs: DataFrame, delta_filter: float = 0.05, delta_label: float = 0.10,
                  variant_col: str = "idx", rows_of: Callable[[DataFrame, bool], DataFrame] | None = None,
                  numbers: DataFrame | None = None) -> DataFrame:
    """E7 + E8 + B14 (+ C12 without a self-join): per original id, the gold is the
    valid simplification with the lowest score (first by idx on ties); inputs
    are the original and every other valid simplification; gap = score - gold,
    label = gap > delta_label. Ids without a valid simplification are dropped.

    The first and the gold row of an id come from hash aggregates over its
    numbers; their texts are fetched by (id, row), then every input meets its
    gold on id. ``variant_col`` identifies a row of its id. ``rows_of``: see
    ``prepare_sentences``. Of ``pairs`` without texts the inputs have none;
    ``numbers``: such a table with the same rows, where it takes less to derive.
    """
    texts = "simplification" in pairs.columns
    score = F.when(gain() > F.lit(delta_filter), F.col("simplification_all"))   # null: not a valid simplification
    least = (pairs if numbers is None else numbers).select(ID, variant_col, score.alias("_s")).groupBy(ID, "_s").agg(F.min(variant_col).alias("_v"))
    best = least.groupBy(ID).agg(F.min("_v").alias("_first"), F.min_by("_v", "_s").alias("_gold"))
    roles = best.where(F.col("_gold").isNotNull()).select(ID, F.inline(F.array(
        F.struct(F.col("_first").alias(variant_col), F.lit(True).alias("_is_first")),
        F.struct(F.col("_gold").alias(variant_col), F.lit(False).alias("_is_first")))))
    found = rows_at(pairs, roles, [ID, variant_col]) if rows_of is None else rows_of(roles, False)
    text = [F.when(F.col("_is_first"), F.col("original_text")).otherwise(F.col("simplification")).alias("_text")] if texts else []
    chosen = found.select(
        ID, F.col(variant_col).alias("_v"), "_is_first", *text,
        F.when(F.col("_is_first"), F.col("original_all")).otherwise(F.col("simplification_all")).alias("_score"))

    def named(text: str, name: str) -> list[Column]:
        return [F.col(text).alias(name)] if texts else []

    gold = chosen.where(~F.col("_is_first")).select(ID, *named("_text", "gold_text"),
                                                    F.col("_score").alias("gold_score"), F.col("_v").alias("gold_idx"))
    originals = chosen.where("_is_first").select(ID, (F.col(ID) * ROW_STRIDE + 10).alias("gid"),
                                                 *named("_text", "input_text"), F.col("_score").alias("input_score"))
    others = pairs.where(score.isNotNull()).select(
        ID, (F.col(ID) * ROW_STRIDE + F.col(variant_col) % 10).alias("gid"), *named("simplification", "input_text"),
        F.col("simplification_all").alias("input_score"), F.col(variant_col).alias("_v"))
    inputs = originals.unionByName(others, allowMissingColumns=True)
    x = inputs.join(gold, ID).where(F.col("_v").isNull() | (F.col("_v") != F.col("gold_idx"))).drop("_v", "gold_idx")
    gap = F.col("input_score") - F.col("gold_score")
    return x.withColumns({"gap_to_gold": gap,
                          "true_label": (F.round(gap, 9) > F.lit(delta_label)).cast("int")})


def label_counts(df: DataFrame, col: str = "true_label") -> DataFrame:
    """Value counts with shares of the total."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))
    from pyspark.sql import Window
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))   # one row per value


def leakage_count(ids_a: DataFrame, ids_b: DataFrame, key: str = ID) -> DataFrame:
    """Number of ids present in both sets (must be 0)."""
    return ids_a.select(key).distinct().join(ids_b.select(key).distinct(), key, "inner").agg(
        F.count(F.lit(1)).cast("long").alias("n_shared"))


def quadrant(true_col: str = "true_label", pred_col: str = "pred_gate"):
    """TP / FN / TN / FP from (true, predicted); null where either is null."""
    t, p = F.col(true_col), F.col(pred_col)
    return (F.when((t == 1) & (p == 1), F.lit("TP")).when((t == 1) & (p == 0), F.lit("FN"))
            .when((t == 0) & (p == 0), F.lit("TN")).when((t == 0) & (p == 1), F.lit("FP")))


def crosstab(df: DataFrame, true_col: str = "true_label", pred_col: str = "pred_gate") -> DataFrame:
    """D3: true x predicted counts, predicted values as columns 0 and 1."""
    return (df.groupBy(true_col).pivot(pred_col, [0, 1]).agg(F.count(F.lit(1)))
            .select(true_col, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(f"pred_{v}") for v in (0, 1)]))


def overlap_filter(df: DataFrame, a: str = "input_text", b: str = "gold_text", min_overlap: float = 0.2) -> DataFrame:
    """B15 + G14: keep rows whose lexical overlap with the gold is >= min_overlap."""
    return df.withColumn("ov", lexical_overlap(a, b)).where(F.col("ov") >= F.lit(min_overlap))


def route(df: DataFrame, output: str = "gen_output", gate: str = "pred_gate", source: str = "input_text") -> DataFrame:
    """Condition A always takes the generated output, condition B only when gated."""
    return df.withColumns({"out_A": F.col(output),
                           "out_B": F.when(F.col(gate) == 1, F.col(output)).otherwise(F.col(source))})





def score_conditions(df: DataFrame, with_ter: bool = True, source: str = "input_text",
                     gold: str = "gold_text") -> DataFrame:
    """I5 scoring: SARI, word edit distance (substitution 1.5) and TER of both
    conditions against the gold, computed once per row."""
    x = df
    for cond in ("A", "B"):
        out = f"out_{cond}"
        x = with_sari(x, source, out, gold, f"sari_{cond}")
        x = x.withColumn(f"ed_{cond}", word_edit_distance(_words(out), _words(gold), 1.5))
        if with_ter:
            x = x.withColumn(f"ter_{cond}", ter(out, gold))
    return x


def _words(c: str):
    """Whitespace words (empty text -> no words)."""
    return F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")


def result_table(scored: DataFrame, metrics=METRICS) -> DataFrame:
    """Mean of every metric per quadrant plus a TOTALE row with its count;
    empty quadrants are simply absent. One ``rollup``."""
    present = [m for m in metrics if m in scored.columns]
    agg = scored.rollup("quadrante").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                         *[F.avg(m).alias(m) for m in present])
    return agg.select(F.coalesce(F.col("quadrante"), F.lit(TOTAL_LABEL)).alias("quadrante"), "n", *present)
