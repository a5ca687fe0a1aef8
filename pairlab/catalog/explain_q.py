"""Queries of the token-explanation family (L2)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from pairlab.catalog.prep_q import _ALL, _LONG, _split_sql, prepared
from pairlab.catalog.registry import register
from pairlab.functions.hashing import md5_bucket
from pairlab.operators import explain as X
from pairlab.oracle.explain_sql import (CONTENT, EV, LEXICON_PRED, PAIRS, PASS_DEPS, SUB_DEPS, preds_cte,
                                        random_pred, scores_cte, top_fraction_pred)
from pairlab.oracle.fixtures_sql import bucket, with_fixtures
from pairlab.session import materialize
from pairlab.sources import fixtures

_BASE = [_ALL, _LONG, _split_sql("long"), PAIRS, EV]


def _sql(body: str, extra: list[str] = (), fx: tuple[str, ...] = ("pair_rows",)) -> str:
    return with_fixtures(list(fx), body, _BASE + list(extra))


#: What the predictions and their evaluation read of an eval set.
EVALUATED = ("idx", "tokens", "lemmas", "pos", "silver", "simp_tokens")


def eval_set(spark, sf_dir, silver: str = "set", stored: bool = True, columns: tuple[str, ...] = ("*",)):
    """Eval set of the test pairs; stored because every method branch, the
    evaluation join and the reports read it (the guarded labels run a UDF), each
    some of its ``columns``. Not ``stored``: for one reader, which derives these alone."""
    test = prepared(spark, sf_dir, splits=("test",), persist=False)
    ev = X.build_eval_set(X.build_pairs(test), silver)
    ev = ev.select(*columns)
    return materialize(ev) if stored else ev


def _scores(spark, sf_dir, ev):
    ids = ev.select(F.col("idx").alias("sid"))
    return fixtures.sentence_scores(spark, sf_dir, ids).select(F.col("sid").alias("idx"), "attributions")


def methods(spark, sf_dir, ev, with_trunc: bool = False):
    lex = fixtures.lexicon(spark, sf_dir)
    top = X.predict_top_fraction(ev, _scores(spark, sf_dir, ev), 0.5, "attribution")
    if with_trunc:   # one choice for both methods
        extra = F.when(md5_bucket("extra:", F.col("idx"), mod=3) == 0, F.concat(
            "pred", F.array(F.lit(0)))).otherwise(F.col("pred"))   # one label too many in a third of the sentences
        top = top.select("idx", F.inline(F.array(
            F.struct("method", "pred"), F.struct(F.lit("attribution_extra").alias("method"), extra.alias("pred")))))
    parts = [X.predict_random(ev, 0.3), X.predict_lexicon(ev, lex), top]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_METHODS_SQL = [random_pred(0.3), LEXICON_PRED, top_fraction_pred(0.5, "attribution")]
_FX = ("pair_rows", "lexicon", "tok_scores")


def _arr(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: CAST(x AS VARCHAR)), ',')"


def _sarr(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@register("d17_d22_evaluate_methods", _sql("""
SELECT method, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  round(avg(ed_sub1), 6) AS ed_sub1, round(avg(ed_sub1_5), 6) AS ed_sub1_5, round(avg(ed_sub2), 6) AS ed_sub2,
  CAST(count(*) AS BIGINT) AS n_evaluated FROM sc GROUP BY method""", [preds_cte(_METHODS_SQL), scores_cte()], _FX))
def d17_d22_evaluate_methods(spark, sf_dir):
    """D17 + D22 (+ C3 pairs, C5 key join, E10, G24, E9, G9, G10): token P/R/F1 and word edit distance of
    the kept tokens at three substitution costs, per method, in one job."""
    ev = eval_set(spark, sf_dir, columns=EVALUATED)
    return X.evaluate(ev, methods(spark, sf_dir, ev))


_EXTRA_PRED = f"""SELECT idx, method, CASE WHEN {bucket("concat('extra:', idx)", 3)} = 0 THEN list_append(pred, 0) ELSE pred END AS pred
FROM ({top_fraction_pred(0.5, "attribution_extra")})"""


@register("d18_alignment_check", _sql("""
SELECT method, CAST(count(*) AS BIGINT) AS n_checked,
  CAST(count(*) FILTER (WHERE len(tokens) <> len(silver) OR len(tokens) <> len(pred)) AS BIGINT) AS n_misaligned
FROM ev JOIN preds ON ev.idx = preds.idx GROUP BY method""",
    [preds_cte(_METHODS_SQL + [_EXTRA_PRED])], _FX))
def d18_alignment_check(spark, sf_dir):
    """Size agreement of tokens / silver / predictions per method; one method
    has a label too many in a third of the sentences, chosen by md5."""
    ev = eval_set(spark, sf_dir)
    p = methods(spark, sf_dir, ev, with_trunc=True).persist(StorageLevel.MEMORY_AND_DISK)   # read by the report and the count
    bad = X.alignment_report(ev, p).groupBy("method").agg(F.count(F.lit(1)).cast("long").alias("n_misaligned"))
    checked = ev.select("idx").join(p, "idx").groupBy("method").agg(F.count(F.lit(1)).cast("long").alias("n_checked"))
    return checked.join(bad, "method", "left").select(
        "method", "n_checked", F.coalesce("n_misaligned", F.lit(0).cast("long")).alias("n_misaligned"))


@register("d16_d26_positive_rates", _sql("""
SELECT method, round(avg(r), 6) AS positive_rate, CAST(count(*) FILTER (WHERE e) AS BIGINT) AS n_empty FROM (
  SELECT 'silver' AS method, CASE WHEN len(silver) > 0 THEN CAST(list_sum(silver) AS DOUBLE) / len(silver) END AS r,
         coalesce(list_sum(silver), 0) = 0 AS e FROM ev
  UNION ALL
  SELECT method, CASE WHEN len(pred) > 0 THEN CAST(list_sum(pred) AS DOUBLE) / len(pred) END AS r,
         coalesce(list_sum(pred), 0) = 0 AS e FROM preds) GROUP BY method""", [preds_cte(_METHODS_SQL)], _FX))
def d16_d26_positive_rates(spark, sf_dir):
    """D16 + D26: mean per-sentence positive rate (silver and each method) and empty predictions."""
    ev = eval_set(spark, sf_dir)
    return X.positive_rates(ev, methods(spark, sf_dir, ev))


@register("d23_method_disagreement", _sql("""
SELECT idx, round(avg(sd), 6) AS score FROM (
  SELECT idx, i, stddev_pop(p) AS sd FROM (
    SELECT preds.idx, unnest(range(0, len(pred[1:len(ev.tokens)]))) AS i, unnest(pred[1:len(ev.tokens)]) AS p
    FROM preds JOIN ev ON preds.idx = ev.idx) GROUP BY idx, i) GROUP BY idx
ORDER BY round(avg(sd), 9) DESC, idx DESC LIMIT 10""", [preds_cte(_METHODS_SQL)], _FX))
def d23_method_disagreement(spark, sf_dir):
    """The 10 sentences where the methods disagree most (mean per-token std)."""
    ev = eval_set(spark, sf_dir)
    return X.disagreement(ev, methods(spark, sf_dir, ev), 10)


@register("f2_agreement_sets", _sql(f"""
SELECT idx, method, {_arr('list_intersect(p, s)')} AS common, {_arr('list_filter(p, lambda x: NOT list_contains(s, x))')} AS only_pred,
  {_arr('list_filter(s, lambda x: NOT list_contains(p, x))')} AS only_silver,
  CAST(len(list_intersect(p, s)) AS BIGINT) AS n_common FROM (
  SELECT ev.idx, method, list_filter(range(0, len(pred)), lambda i: pred[i + 1] = 1) AS p,
         list_filter(range(0, len(silver)), lambda i: silver[i + 1] = 1) AS s
  FROM ev JOIN preds ON ev.idx = preds.idx) WHERE len(p) > 0 OR len(s) > 0""", [preds_cte(_METHODS_SQL)], _FX))
def f2_agreement_sets(spark, sf_dir):
    """positions found by both / only predicted / only silver, per sentence and method."""
    ev = eval_set(spark, sf_dir)
    a = X.agreement_sets(ev, methods(spark, sf_dir, ev))
    return a.select("idx", "method", _sarr(F.array_sort("common")).alias("common"),
                    _sarr(F.array_sort("only_pred")).alias("only_pred"),
                    _sarr(F.array_sort("only_silver")).alias("only_silver"),
                    F.size("common").cast("long").alias("n_common"))


_EXPL_SQL = f"""ex AS (SELECT idx, i - 1 AS i, tokens[i] AS token, tipo[i] AS operazione,
  CASE WHEN dep[i] IN {SUB_DEPS} THEN 'clausola subordinata/participiale (sintattico)'
       WHEN dep[i] IN {PASS_DEPS} THEN 'costruzione passiva (sintattico)'
       WHEN pos[i] IN {CONTENT} AND NOT list_contains((SELECT list(lemma) FROM lexicon), lemmas[i]) THEN 'parola non di base (lessicale)'
       ELSE 'altro' END AS motivo
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM ev) WHERE silver[i] = 1)"""


@register("g25_explain_tokens", _sql("SELECT idx, CAST(i AS BIGINT) AS i, token, operazione, motivo FROM ex",
                                     [_EXPL_SQL], ("pair_rows", "lexicon")))
def g25_explain_tokens(spark, sf_dir):
    """Reason of every silver-positive token."""
    ev = eval_set(spark, sf_dir, stored=False)
    return X.explain_tokens(ev, fixtures.lexicon(spark, sf_dir)).withColumn("i", F.col("i").cast("long"))


@register("d25_reason_counts", _sql("SELECT motivo, CAST(count(*) AS BIGINT) AS n FROM ex WHERE motivo <> 'altro' GROUP BY motivo",
                                    [_EXPL_SQL], ("pair_rows", "lexicon")))
def d25_reason_counts(spark, sf_dir):
    """Reason frequencies without "altro"."""
    ev = eval_set(spark, sf_dir, stored=False)
    return X.reason_counts(X.explain_tokens(ev, fixtures.lexicon(spark, sf_dir)))


@register("g26_explain_spans", _sql(f"""
SELECT idx, CAST(min(i) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n_tokens,
  CASE WHEN bool_or(dep IN {SUB_DEPS}) OR bool_or(dep IN {PASS_DEPS}) OR count(*) FILTER (WHERE NOT inlex) > 0 THEN
    array_to_string(list_filter([CASE WHEN bool_or(dep IN {SUB_DEPS}) THEN 'clausola subordinata/participiale' END,
      CASE WHEN bool_or(dep IN {PASS_DEPS}) THEN 'costruzione passiva' END,
      CASE WHEN count(*) FILTER (WHERE NOT inlex) > 0 THEN 'parole non di base: ' || string_agg(CASE WHEN NOT inlex THEN token END, ', ' ORDER BY i) END],
      lambda x: x IS NOT NULL), '; ')
  ELSE 'motivo non chiaro' END AS reasons
FROM (SELECT idx, i - 1 AS i, tokens[i] AS token, dep[i] AS dep, list_contains((SELECT list(lemma) FROM lexicon), lemmas[i]) AS inlex,
        i - row_number() OVER (PARTITION BY idx ORDER BY i) AS span
      FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM ev) WHERE silver[i] = 1)
GROUP BY idx, span""", [], ("pair_rows", "lexicon")))
def g26_explain_spans(spark, sf_dir):
    """Reasons for each run of consecutive silver-positive tokens."""
    ev = eval_set(spark, sf_dir, stored=False)
    return X.explain_spans(ev, fixtures.lexicon(spark, sf_dir)).drop("span")


@register("c9_lexicon_membership", _sql(f"""
SELECT pos, CAST(count(*) FILTER (WHERE inlex) AS BIGINT) AS n_in, CAST(count(*) FILTER (WHERE NOT inlex) AS BIGINT) AS n_out
FROM (SELECT pos[i] AS pos, list_contains((SELECT list(lemma) FROM lexicon), lemmas[i]) AS inlex
      FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM ev)) GROUP BY pos""", [], ("pair_rows", "lexicon")))
def c9_lexicon_membership(spark, sf_dir):
    """Tokens inside / outside the basic lexicon per POS (broadcast left join)."""
    t = X.lexicon_flags(eval_set(spark, sf_dir, stored=False), fixtures.lexicon(spark, sf_dir))
    return t.groupBy("pos").agg(F.count_if("in_lexicon").cast("long").alias("n_in"),
                                F.count_if(~F.col("in_lexicon")).cast("long").alias("n_out"))


@register("e10_e9_g24_predictions", _sql(f"""
SELECT idx, method, {_arr('pred')} AS pred FROM preds""", [preds_cte(_METHODS_SQL + [random_pred(0.34, '42', 'random_34')])], _FX))
def e10_e9_g24_predictions(spark, sf_dir):
    """E10 (rates .30 and .34), G24, E9/H10: every method's 0/1 vector per sentence."""
    ev = eval_set(spark, sf_dir)
    p = methods(spark, sf_dir, ev).unionByName(X.predict_random(ev, 0.34, name="random_34"))
    return p.select("idx", "method", _sarr("pred").alias("pred"))


@register("g32_operation_counts", _sql("""
SELECT idx, CAST(len(list_filter(tipo, lambda x: x = 'del')) AS BIGINT) AS n_del,
  CAST(len(list_filter(tipo, lambda x: x = 'sub')) AS BIGINT) AS n_sub, CAST(len(tokens) AS BIGINT) AS n_tokens FROM ev"""))
def g32_operation_counts(spark, sf_dir):
    """G32 + G5: operation counts per sentence under set-based silver labels."""
    o = X.operation_counts(eval_set(spark, sf_dir, stored=False))
    return o.select("idx", *[F.col(c).cast("long").alias(c) for c in ("n_del", "n_sub", "n_tokens")])


@register("d17_evaluate_guarded_ter")
def d17_evaluate_guarded_ter(spark, sf_dir):
    """D17 with aligned, guarded silver labels (G7) and TER (G12): rows-only check."""
    ev = eval_set(spark, sf_dir, "guarded", columns=EVALUATED)
    return X.evaluate(ev, methods(spark, sf_dir, ev), with_ter=True)


@register("d19_typed_evaluation")
def d19_typed_evaluation(spark, sf_dir):
    """Evaluation per operation type (del / sub) on guarded silver labels."""
    ev = eval_set(spark, sf_dir, "guarded")
    return X.typed_evaluation(ev, methods(spark, sf_dir, ev))


@register("g6_aligned_silver_counts")
def g6_aligned_silver_counts(spark, sf_dir):
    """G6 vs G7: token counts per operation type under plain and guarded alignment."""
    out = None
    pairs = materialize(X.build_pairs(prepared(spark, sf_dir, splits=("test",), persist=False)))   # read by both modes
    for mode in ("aligned", "guarded"):
        ev = X.build_eval_set(pairs, mode)
        t = ev.select(F.explode("tipo").alias("tipo")).groupBy("tipo").agg(F.count(F.lit(1)).cast("long").alias("n"))
        t = t.withColumn("mode", F.lit(mode))
        out = t if out is None else out.unionByName(t)
    return out
