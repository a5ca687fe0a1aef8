"""Queries of the gating family (L3)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from pairlab.catalog.prep_q import _ALL, _LONG, _split_sql, prepared
from pairlab.catalog.registry import register
from pairlab.functions.sari import with_sari
from pairlab.functions.text import lexical_overlap
from pairlab.operators import gating as G
from pairlab.operators import sampling
from pairlab.oracle.fixtures_sql import with_fixtures
from pairlab.oracle.gating_sql import ALL_ROWS, GATING_BASE, ROUTED, gate_sql, sample_sql, sari_grouped_sql, tok_lower
from pairlab.plans import gating as L3
from pairlab.session import materialize
from pairlab.sources import fixtures

_BASE = [_ALL, _LONG, _split_sql("long"), GATING_BASE]


def _sql(body: str, extra: list[str] = ()) -> str:
    return with_fixtures(["pair_rows"], body, _BASE + list(extra))


def _held(spark, sf_dir, splits=("test",)):
    """The prepared sentences of the splits, and the pairs of their ids, from texts that are stored once."""
    held = fixtures.HeldTexts(spark, sf_dir)
    return prepared(spark, sf_dir, splits=splits, rows_of=held.rows), held


def _rows(spark, sf_dir, with_texts=False):
    sentences, held = _held(spark, sf_dir)
    return L3.gating_rows(held.of, sentences, held.rows, with_texts)


@register("e7_e8_gating_inputs", _sql("""
SELECT original_sentence_idx, gid, round(input_score, 6) AS input_score, round(gold_score, 6) AS gold_score,
  round(gap_to_gold, 6) AS gap_to_gold, true_label FROM g"""))
def e7_e8_gating_inputs(spark, sf_dir):
    """Gold per test original and every input row with its gap and label."""
    g = _rows(spark, sf_dir)
    return g.select("original_sentence_idx", "gid", "input_score", "gold_score", "gap_to_gold", "true_label")


@register("d2_label_counts", _sql("""
SELECT true_label, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY true_label"""))
def d2_label_counts(spark, sf_dir):
    """Label value counts and shares of the gating inputs."""
    return G.label_counts(_rows(spark, sf_dir))


@register("c10_gating_leakage", _sql("""
SELECT CAST(count(*) AS BIGINT) AS n_shared FROM (SELECT DISTINCT original_sentence_idx FROM g)
WHERE original_sentence_idx IN (SELECT id FROM sp WHERE split = 'train')"""))
def c10_gating_leakage(spark, sf_dir):
    """Gating originals that also occur in train (must be 0)."""
    held = fixtures.HeldTexts(spark, sf_dir)
    # ids alone are read of the sentences
    sentences = materialize(prepared(spark, sf_dir, None, None, False, held.rows).select("original_sentence_idx", "split"))
    return G.leakage_count(L3.gating_rows(held.of, sentences, held.rows, with_texts=False),
                           sentences.where(F.col("split") == "train"))


@register("e6_stratified_sample", _sql("SELECT gid, true_label FROM smp", [sample_sql()]))
def e6_stratified_sample(spark, sf_dir):
    """Stratified sample of 10,000 gating inputs (class shares kept)."""
    rows = _rows(spark, sf_dir).select("gid", "true_label").persist(StorageLevel.MEMORY_AND_DISK)   # read by allocation, ranks and sample
    return sampling.stratified_sample(rows, "true_label", "gid", 10_000).select("gid", "true_label")


def _quad(spark, sf_dir):
    sentences, held = _held(spark, sf_dir, ("test", "val"))
    return L3.gated_sample(held.of, sentences, n_sample=None, rows_of=held.rows)


@register("b13_d3_gate_quadrants", _sql("""
SELECT quadrante, true_label, pred_gate, CAST(count(*) AS BIGINT) AS n FROM quad GROUP BY ALL""", [ALL_ROWS, gate_sql()]))
def b13_d3_gate_quadrants(spark, sf_dir):
    """D13 on val + B13: gate decision with the calibrated threshold, quadrant counts."""
    q = _quad(spark, sf_dir)
    return q.groupBy("quadrante", "true_label", "pred_gate").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("d3_crosstab", _sql("""
SELECT true_label, CAST(count(*) FILTER (WHERE pred_gate = 0) AS BIGINT) AS pred_0,
  CAST(count(*) FILTER (WHERE pred_gate = 1) AS BIGINT) AS pred_1 FROM quad GROUP BY true_label""", [ALL_ROWS, gate_sql()]))
def d3_crosstab(spark, sf_dir):
    """D3: true label x gate decision."""
    return G.crosstab(_quad(spark, sf_dir))


@register("g14_b15_overlap_filter", _sql("""
SELECT gid, round(ov, 6) AS ov FROM (SELECT gid, """ + __import__("pairlab.oracle.gating_sql", fromlist=["x"]).overlap_sql("input_text", "gold_text")
    + """ AS ov FROM g) WHERE ov >= 0.2::DOUBLE"""))
def g14_b15_overlap_filter(spark, sf_dir):
    """G14 + B15: lexical overlap with the gold, rows with overlap >= 0.2."""
    return G.overlap_filter(_rows(spark, sf_dir, with_texts=True)).select("gid", "ov")


def _experiment(spark, sf_dir, **how):
    sentences, held = _held(spark, sf_dir, ("test", "val"))
    return L3.gating_experiment(held.of, sentences, rows_of=held.rows, **how)


@register("g13_sari_rows", _sql("""
SELECT gid, round(sari_A, 6) AS sari_A, round(sari_B, 6) AS sari_B, round(ed_A, 6) AS ed_A, round(ed_B, 6) AS ed_B,
  out_B FROM scored""", [ALL_ROWS, gate_sql(), ROUTED]))
def g13_sari_rows(spark, sf_dir):
    """G13 + G10 + B12 + I1 (stub): per-row SARI and ED(1.5) of both conditions."""
    s = _experiment(spark, sf_dir, n_sample=None, with_ter=False)
    return s.select("gid", "sari_A", "sari_B", "ed_A", "ed_B", "out_B")


@register("l3_gating_table", _sql("""
SELECT coalesce(quadrante, 'TOTALE') AS quadrante, CAST(count(*) AS BIGINT) AS n,
  round(avg(sari_A), 6) AS sari_A, round(avg(ed_A), 6) AS ed_A, round(avg(sari_B), 6) AS sari_B, round(avg(ed_B), 6) AS ed_B
FROM scored GROUP BY ROLLUP (quadrante)""", [sample_sql(), gate_sql(), ROUTED]))
def l3_gating_table(spark, sf_dir):
    """L3 + I5 + D28: gating A/B table per quadrant with TOTALE (SARI, ED)."""
    s = _experiment(spark, sf_dir, with_ter=False)
    return G.result_table(s)


@register("l3_gating_table_ter")
def l3_gating_table_ter(spark, sf_dir):
    """L3 + D28 with all six metrics including TER (rows-only check)."""
    s = _experiment(spark, sf_dir, with_ter=True)
    return G.result_table(s)


#: Each pair with the next variant of its original (after the last: the first) as reference.
_NEXT_VARIANT = f"""toks AS MATERIALIZED (SELECT p.idx, {tok_lower('p.original_text')} AS ts, {tok_lower('p.simplification')} AS tc,
    {tok_lower('q.simplification')} AS tr
  FROM pair_rows p JOIN pair_rows q ON q.idx = CASE WHEN p.idx % 10 = 9 THEN p.idx - 9 ELSE p.idx + 1 END)"""


@register("g13_sari_pairs", with_fixtures(
    ["pair_rows"], f"SELECT idx, round(sari, 6) AS sari FROM ({sari_grouped_sql('toks')})", [_NEXT_VARIANT]))
def g13_sari_pairs(spark, sf_dir):
    """G13 on every pair of the table; the reference is the next variant of the same original."""
    p = fixtures.pair_table_with_next(spark, sf_dir)
    return with_sari(p, "original_text", "simplification", "reference").select("idx", F.round("sari", 6).alias("sari"))
