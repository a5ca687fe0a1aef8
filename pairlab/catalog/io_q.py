"""Queries of the I/O and batch-inference family.

Each query writes under a fresh folder of the session's checkpoint directory
and answers from what it reads back, so the round trip itself is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.catalog.explain_q import _BASE, eval_set
from pairlab.catalog.prep_q import _ALL, _LONG, _split_sql, prepared
from pairlab.catalog.registry import register
from pairlab.operators import explain as X
from pairlab.operators import inference as I
from pairlab.oracle.explain_sql import CONTENT, PASS_DEPS, SUB_DEPS
from pairlab.oracle.fixtures_sql import with_fixtures
from pairlab.oracle.gating_sql import stub_sql
from pairlab.sources import fixtures
from pairlab.sources import io as IO


def _sql(body: str, extra: list[str] = (), fx=("pair_rows",)) -> str:
    return with_fixtures(list(fx), body, _BASE + list(extra))


@register("a3_split_sink_roundtrip", with_fixtures(["pair_rows"], """
SELECT split, is_original, CAST(count(*) AS BIGINT) AS n_rows FROM long JOIN sp ON long.original_sentence_idx = sp.id
GROUP BY split, is_original""", [_ALL, _LONG, _split_sql("long")]))
def a3_split_sink_roundtrip(spark, sf_dir):
    """A3 (+A2 pruning): sentences written partitioned by split, read back split by split."""
    path = IO.scratch_path(spark, "splits")
    IO.write_splits(prepared(spark, sf_dir), path)
    out = None
    for s in ("train", "val", "test"):
        part = IO.read_split(spark, path, s).groupBy("split", "is_original").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


_EXPL = f"""ex AS (SELECT idx, CASE WHEN dep[i] IN {SUB_DEPS} THEN 'clausola subordinata/participiale (sintattico)'
       WHEN dep[i] IN {PASS_DEPS} THEN 'costruzione passiva (sintattico)'
       WHEN pos[i] IN {CONTENT} AND NOT list_contains(lex, lemmas[i]) THEN 'parola non di base (lessicale)'
       ELSE 'altro' END AS motivo
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM ev), (SELECT list(lemma) AS lex FROM lexicon) WHERE silver[i] = 1)"""


@register("a4_csv_roundtrip", _sql("SELECT motivo, CAST(count(*) AS BIGINT) AS n FROM ex GROUP BY motivo", [_EXPL],
                                   ("pair_rows", "lexicon")))
def a4_csv_roundtrip(spark, sf_dir):
    """A4: token explanations written as CSV and read back with an explicit schema."""
    path = IO.scratch_path(spark, "explanations")
    ex = X.explain_tokens(eval_set(spark, sf_dir), fixtures.lexicon(spark, sf_dir))
    IO.write_csv(ex.select("idx", "token", "operazione", "motivo"), path)
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("token", T.StringType()),
                           T.StructField("operazione", T.StringType()), T.StructField("motivo", T.StringType())])
    back = IO.read_csv(spark, path, schema)
    return back.groupBy("motivo").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("a6_nested_store_roundtrip", _sql("""
SELECT CAST(count(*) AS BIGINT) AS n_sentences, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens,
  CAST(sum(list_sum(silver)) AS BIGINT) AS n_silver, CAST(sum(len(simp_tokens)) AS BIGINT) AS n_simp_tokens FROM ev"""))
def a6_nested_store_roundtrip(spark, sf_dir):
    """The eval set (parallel arrays) stored as nested Parquet and read back."""
    path = IO.scratch_path(spark, "evalset")
    IO.write_nested(eval_set(spark, sf_dir).select("idx", "tokens", "silver", "simp_tokens", "tipo"), path)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).cast("long").alias("n_sentences"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"),
                    F.sum(F.aggregate("silver", F.lit(0), lambda a, x: a + x)).cast("long").alias("n_silver"),
                    F.sum(F.size("simp_tokens")).cast("long").alias("n_simp_tokens"))


@register("a7_lexicon_text_source", with_fixtures(["lexicon"], "SELECT lemma FROM lexicon"))
def a7_lexicon_text_source(spark, sf_dir):
    """Lexicon text file (tab/comma fields, comments, blank lines, mixed case) parsed back to lemmas."""
    path = IO.scratch_path(spark, "lexicon")
    lex = fixtures.lexicon(spark, sf_dir)
    lines = lex.select(F.concat(F.initcap("lemma"), F.lit(",var\t"), F.length("lemma").cast("string")).alias("value"))
    extra = spark.createDataFrame([("# basic lexicon",), ("",), ("   ",)], "value string")
    lines.unionByName(extra).coalesce(1).write.mode("overwrite").text(path)
    return IO.read_lexicon(spark, path)


@register("a5_json_metrics_roundtrip", with_fixtures(["scored"], """
SELECT 'test' AS split, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS support_complex,
  CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS support_simple FROM scored WHERE split = 'test' AND pred IS NOT NULL"""))
def a5_json_metrics_roundtrip(spark, sf_dir):
    """A5: a metrics document written as JSON and read back (multi-line reader)."""
    from pairlab.operators import metrics as M
    s = fixtures.scored(spark, sf_dir).where((F.col("split") == "test") & F.col("pred").isNotNull())
    rep = M.classification_report(M.confusion(s.withColumn("p", (F.col("pred") > 0.2).cast("int")), "label", "p"))
    doc = rep.agg(F.map_from_entries(F.collect_list(F.struct("row", "support"))).alias("support"))
    path = IO.scratch_path(spark, "metrics")
    IO.write_json(doc.select(F.lit("test").alias("split"), "support").coalesce(1), path)
    back = IO.read_json(spark, path, multiline=True)
    return back.select("split", F.col("support.complex").cast("long").alias("support_complex"),
                       F.col("support.simple").cast("long").alias("support_simple"))


def _prompts(spark, sf_dir):
    return eval_set(spark, sf_dir).select(F.col("idx").alias("id"), F.col("original").alias("prompt"))


_GEN_SQL = f"SELECT idx AS id, {stub_sql('original', 'original')} AS response FROM ev"


@register("i1_batch_generation", _sql(_GEN_SQL))
def i1_batch_generation(spark, sf_dir):
    """Sharded batch generation with a pluggable generator (deterministic stub), keyed by id."""
    return I.generate(_prompts(spark, sf_dir), fixtures.stub_generator_factory, "id", "prompt", batch_size=16)


@register("i2_i3_resumable_merge", _sql(f"SELECT id, response, false AS missing FROM ({_GEN_SQL})"))
def i2_i3_resumable_merge(spark, sf_dir):
    """I2 + I3 + C6: a run interrupted after 2 of 4 chunks, resumed by a second run, merged."""
    out = IO.scratch_path(spark, "generation")
    prompts = _prompts(spark, sf_dir)
    I.resumable_generate(prompts, out, "r0001", fixtures.stub_generator_factory, stop_after_chunks=2)
    I.resumable_generate(prompts, out, "r0002", fixtures.stub_generator_factory)
    return I.merge_results(prompts, out)


@register("c7_missing_report", _sql("""
SELECT CAST(count(*) AS BIGINT) AS n_inputs,
  CAST(count(*) FILTER (WHERE ((('0x' || substr(md5(CAST(idx AS VARCHAR)), 1, 8))::BIGINT) % 4) >= 2) AS BIGINT) AS n_missing FROM ev"""))
def c7_missing_report(spark, sf_dir):
    """Merge after an interrupted run: every input kept, missing responses counted."""
    out = IO.scratch_path(spark, "generation")
    prompts = _prompts(spark, sf_dir)
    I.resumable_generate(prompts, out, "r0001", fixtures.stub_generator_factory, stop_after_chunks=2)
    m = I.merge_results(prompts, out)
    return m.agg(F.count(F.lit(1)).cast("long").alias("n_inputs"), F.count_if("missing").cast("long").alias("n_missing"))


@register("a8_e14_tolerant_restore", _sql(f"SELECT id, response FROM ({_GEN_SQL})"))
def a8_e14_tolerant_restore(spark, sf_dir):
    """A8 + E14: output folder with an unreadable part is scanned tolerantly and
    the outputs are restored to input order by id."""
    out = IO.scratch_path(spark, "generation")
    prompts = _prompts(spark, sf_dir)
    I.resumable_generate(prompts, out, "r0001", fixtures.stub_generator_factory)
    spark.createDataFrame([("not a parquet file",)], "value string").write.text(f"{out}/run=r0001/chunk=9")
    parts = IO.read_tolerant(spark, out, I.OUT_SCHEMA, recursive=True).select("id", "response")
    return I.restore_order(prompts.select("id"), parts)


@register("a2_domain_source", """SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars FROM documents
WHERE lang = (SELECT min(lang) FROM documents)""")
def a2_domain_source(spark, sf_dir):
    """A2: documents written once by domain (their language), one domain read
    back: the scan lists that folder and the two columns only."""
    from pairlab.sources.tables import load_domain, read_table, write_domains
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars", "lang"])
    path = IO.scratch_path(spark, "domains")
    write_domains(docs, path, "lang")
    first = docs.agg(F.min("lang")).first()[0]
    return load_domain(spark, path, first, ["doc_id", "n_chars"]).withColumn("n_chars", F.col("n_chars").cast("long"))
