"""Queries of the annotation-parsing / prompt family."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.catalog.explain_q import _BASE, eval_set
from pairlab.catalog.registry import register
from pairlab.functions import text as T
from pairlab.functions.parse import extract_annotation, strict_annotation
from pairlab.operators import explain as X
from pairlab.oracle.explain_sql import random_pred
from pairlab.oracle.fixtures_sql import with_fixtures
from pairlab.oracle.parse_sql import ANNOT_OUT, PARSE_CTES
from pairlab.sources import fixtures


def _sql(body: str, extra: list[str] = (), fx=("pair_rows", "responses")) -> str:
    return with_fixtures(list(fx), body, _BASE + list(extra))


def _annotated(spark, sf_dir):
    ev = eval_set(spark, sf_dir).select("idx", F.size("tokens").alias("n"))
    r = fixtures.responses(spark, sf_dir).select(F.col("id").alias("idx"), "response")
    return ev.join(r, "idx", "left").withColumn("a", extract_annotation("response", "n"))


def _motivi_str(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@register("g22_parse_annotations", _sql(ANNOT_OUT, PARSE_CTES))
def g22_parse_annotations(spark, sf_dir):
    """G17 + G18 + G19 + G20 + G21 + G22 + F4: tolerant parse of every response (status, indices, reasons)."""
    a = _annotated(spark, sf_dir)
    return a.select("idx", F.col("a.status").alias("status"),
                    F.array_join(F.transform("a.complex", lambda x: x.cast("string")), ",").alias("complex"),
                    _motivi_str(F.col("a.motivi")).alias("motivi"))


@register("d24_parse_status_counts", _sql("SELECT status, CAST(count(*) AS BIGINT) AS n FROM annot GROUP BY status", PARSE_CTES))
def d24_parse_status_counts(spark, sf_dir):
    """Parse outcome counts."""
    return X.parse_status_counts(eval_set(spark, sf_dir), fixtures.responses(spark, sf_dir))


@register("b16_failed_records", _sql(
    "SELECT idx, coalesce(substr(response, 1, 90), '') AS head, status FROM annot WHERE complex IS NULL", PARSE_CTES))
def b16_failed_records(spark, sf_dir):
    """Responses that could not be parsed, with id and their first 90 characters."""
    return X.failed_records(eval_set(spark, sf_dir), fixtures.responses(spark, sf_dir))


@register("g8_llm_predictions", _sql("""
SELECT idx, array_to_string(list_transform(range(0, n), lambda i: CASE WHEN list_contains(coalesce(complex, []), i) THEN '1' ELSE '0' END), ',') AS pred
FROM annot""", PARSE_CTES))
def g8_llm_predictions(spark, sf_dir):
    """G8 over parsed annotations: index lists as 0/1 vectors aligned with the tokens."""
    p = X.predict_from_responses(eval_set(spark, sf_dir), fixtures.responses(spark, sf_dir))
    return p.select("idx", F.array_join(F.transform("pred", lambda x: x.cast("string")), ",").alias("pred"))


_STRICT = r"""strict AS (SELECT idx, n, regexp_extract(trim(regexp_replace(trim(response), '(?m)^```(?:json)?|```$', '', 'g')), '(?s)(\{.*\})', 1) AS blob FROM rp),
strict2 AS (SELECT idx, n, CASE WHEN json_valid(blob) THEN blob END AS blob,
  coalesce(CASE WHEN json_valid(blob) THEN json_type(blob) = 'OBJECT' AND json_type(blob, '$.complex') = 'ARRAY' END, false) AS ok FROM strict)"""


@register("g23_strict_parse", _sql(r"""
SELECT idx, array_to_string(list_transform(CASE WHEN ok THEN list_filter(list_transform(list_filter(
    json_extract_string(blob, '$.complex[*]'), lambda e: regexp_full_match(e, '-?\d+')), lambda e: CAST(e AS BIGINT)),
    lambda i: i >= 0 AND i < n) ELSE [] END, lambda x: CAST(x AS VARCHAR)), ',') AS complex FROM strict2""", [PARSE_CTES[0], _STRICT]))
def g23_strict_parse(spark, sf_dir):
    """The older strict parser (code fences stripped, strict JSON, integer items)."""
    ev = eval_set(spark, sf_dir).select("idx", F.size("tokens").alias("n"))
    r = fixtures.responses(spark, sf_dir).select(F.col("id").alias("idx"), "response")
    j = ev.join(r, "idx", "left")
    return j.select("idx", F.array_join(F.transform(strict_annotation("response", "n"), lambda x: x.cast("string")), ",")
                    .alias("complex"))


@register("g15_g16_prompts", _sql(r"""
SELECT idx, original || chr(10) || array_to_string(list_transform(tokens, lambda t, i: CAST(i - 1 AS VARCHAR) || ': ' || t), chr(10)) AS prompt,
  CAST(4 AS BIGINT) AS n_messages FROM ev""", fx=("pair_rows",)))
def g15_g16_prompts(spark, sf_dir):
    """G15 + G16: numbered-token prompt text and chat turns (system, one few-shot pair, user)."""
    ev = eval_set(spark, sf_dir)
    prompt = T.numbered_tokens("original", "tokens")
    msgs = T.chat_messages("Indica i token complessi.", prompt, [("0: Esempio", '{"complex": [0]}')])
    return ev.select("idx", prompt.alias("prompt"), F.size(msgs).cast("long").alias("n_messages"))


@register("d27_g31_prompt_audit", _sql(rf"""
SELECT CAST(max(len(regexp_extract_all(p, '\p{{L}}+|[^\s\p{{L}}]'))) AS BIGINT) AS max_len,
  CAST(count(*) FILTER (WHERE len(regexp_extract_all(p, '\p{{L}}+|[^\s\p{{L}}]')) > 128) AS BIGINT) AS n_over,
  CAST(count(*) AS BIGINT) AS n_prompts,
  CAST(sum(least(len(regexp_extract_all(p, '\p{{L}}+|[^\s\p{{L}}]')), 128)) AS BIGINT) AS kept_tokens
FROM (SELECT original || chr(10) || array_to_string(list_transform(tokens, lambda t, i: CAST(i - 1 AS VARCHAR) || ': ' || t), chr(10)) AS p FROM ev)""",
    fx=("pair_rows",)))
def d27_g31_prompt_audit(spark, sf_dir):
    """D27 + G31: longest prompt, prompts over the 128-token limit, tokens kept after truncation."""
    ev = eval_set(spark, sf_dir).select(T.numbered_tokens("original", "tokens").alias("p"))
    toks = T.tokenize("p")
    return ev.agg(
        F.max(F.size(toks)).cast("long").alias("max_len"), F.count_if(F.size(toks) > 128).cast("long").alias("n_over"),
        F.count(F.lit(1)).cast("long").alias("n_prompts"), F.sum(F.size(T.truncate_tokens(toks, 128))).cast("long").alias("kept_tokens"))


@register("g30_bracket_highlight", _sql("""
SELECT r.idx, array_to_string(list_transform(ev.tokens, lambda t, i: CASE WHEN r.pred[i] = 1 THEN '[' || t || ']' ELSE t END), ' ') AS highlighted
FROM (""" + random_pred(0.3) + """) r JOIN ev ON r.idx = ev.idx""", fx=("pair_rows",)))
def g30_bracket_highlight(spark, sf_dir):
    """Sentence text with the random method's tokens in brackets."""
    ev = eval_set(spark, sf_dir)
    p = X.predict_random(ev, 0.3)
    return ev.join(p, "idx").select("idx", T.bracket_highlight("tokens", "pred").alias("highlighted"))
