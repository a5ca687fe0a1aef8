"""Stand-alone queries of operators that the plans use internally (A1, B4,
B8, C1, C2, E1, E2, E3, I4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.catalog.prep_q import pairs_table
from pairlab.catalog.registry import register
from pairlab.operators import inference as I
from pairlab.operators import prep, sampling
from pairlab.oracle.fixtures_sql import order_key, with_fixtures
from pairlab.oracle.gating_sql import long_share_sql
from pairlab.plans import gating as L3
from pairlab.sources import fixtures
from pairlab.sources.tables import read_table

ID = "original_sentence_idx"


@register("a1_scan_documents", """
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents
WHERE n_chars > 100 GROUP BY lang""")
def a1_scan_documents(spark, sf_dir):
    """A1: Parquet scan with column pruning (3 of 5 columns) and a pushed-down filter."""
    d = read_table(spark, sf_dir, "documents", ["lang", "n_chars"]).where(F.col("n_chars") > 100)
    return d.groupBy("lang").agg(F.count(F.lit(1)).cast("long").alias("n_docs"), F.sum("n_chars").cast("long").alias("n_chars"))


@register("b4_b8_gain_filter", with_fixtures(["pair_rows"], """
SELECT CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(DISTINCT original_sentence_idx) AS BIGINT) AS n_ids,
  CAST(count(*) FILTER (WHERE simplification_all IS NULL) AS BIGINT) AS n_null_scores
FROM pair_rows WHERE round(original_all - simplification_all, 9) > 0.05::DOUBLE"""))
def b4_b8_gain_filter(spark, sf_dir):
    """B4 + B8: pairs whose complexity drops by more than 0.05 (rounded to 9 digits), boolean masks."""
    p = prep.gain_filter(pairs_table(spark, sf_dir))
    return p.agg(F.count(F.lit(1)).cast("long").alias("n_pairs"), F.count_distinct(ID).cast("long").alias("n_ids"),
                 F.count_if(F.col("simplification_all").isNull()).cast("long").alias("n_null_scores"))


@register("e3_c1_c2_sample_semi_join", with_fixtures(["pair_rows"], f"""
SELECT original_sentence_idx, CAST(count(*) AS BIGINT) AS n_rows FROM pair_rows WHERE original_sentence_idx IN (
  SELECT id FROM (SELECT DISTINCT original_sentence_idx AS id FROM pair_rows) ORDER BY {order_key("concat('7', ':', id)")}, id LIMIT 5000)
GROUP BY original_sentence_idx"""))
def e3_c1_c2_sample_semi_join(spark, sf_dir):
    """E3 + C1 + C2: 5,000 ids sampled without replacement (md5 order, exact,
    no single-task sort) and all their rows kept by a (broadcast, size-checked) semi-join."""
    p = pairs_table(spark, sf_dir)
    ids = sampling.sample_ids(p.select(ID), ID, 5000, "7")
    kept = sampling.semi_join_ids(p, ids, ID, size_bound=5000)
    return kept.groupBy(ID).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


@register("e1_e2_first_and_capped", with_fixtures(["pair_rows"], f"""
SELECT original_sentence_idx, idx, 'first' AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY original_sentence_idx ORDER BY idx) AS rn FROM pair_rows) WHERE rn = 1
UNION ALL
SELECT original_sentence_idx, idx, 'capped' AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY original_sentence_idx ORDER BY {order_key("concat('42', ':', idx)")}, idx) AS rn
  FROM pair_rows) WHERE rn <= 3"""))
def e1_e2_first_and_capped(spark, sf_dir):
    """E1 + E2: first row per id (min_by aggregate) and K = 3 random rows per id
    (two-stage salted top-k: a hot id is ranked by many tasks)."""
    p = pairs_table(spark, sf_dir).select(ID, "idx")
    first = sampling.first_per_group(p, ID, "idx").withColumn("kind", F.lit("first"))
    capped = sampling.cap_per_group(p, ID, "idx", 3, "42").withColumn("kind", F.lit("capped"))
    return first.select(ID, "idx", "kind").unionByName(capped.select(ID, "idx", "kind"))


@register("i4_batched_scoring", with_fixtures(["pair_rows"], f"""
SELECT idx AS id, round({long_share_sql('simplification')}, 6) AS score FROM pair_rows"""))
def i4_batched_scoring(spark, sf_dir):
    """I4: every simplification scored by a pluggable scorer in batches of 64 (mapInPandas)."""
    p = pairs_table(spark, sf_dir).select(F.col("idx").alias("id"), F.col("simplification").alias("text"))
    return I.score(p, fixtures.long_share_scorer_factory, "id", "text", 64)
