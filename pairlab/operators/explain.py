"""Token-level explanation of complexity (C3, C5, C9, D16-D19, D22-D27, E9,
E10, F2, G24-G26, G32).

Data model: an *eval set* has one row per sentence pair with parallel arrays
(tokens, lemmas, pos, dep, silver, tipo, simp_tokens). A *method* maps the eval
set to ``idx, method, pred`` (0/1 array aligned with tokens). Per-sentence
statistics run inside the row on arrays (no shuffle); only the join of
predictions on ``idx`` and the per-method averages shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.functions.align import labels_from_types, typed_silver
from pairlab.functions.editdist import word_edit_distances
from pairlab.functions.hashing import md5_order
from pairlab.functions.parse import extract_annotation
from pairlab.functions.ter import ter
from pairlab.sources.fixtures import dep_of, pos_of

ID = "original_sentence_idx"

# Dependency relations and POS classes used by the explanations.
SUB_DEPS = ("advcl", "acl", "acl:relcl", "ccomp", "xcomp", "csubj")
PASS_DEPS = ("aux:pass", "nsubj:pass")
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV")
REASON_SUBORDINATE = "clausola subordinata/participiale (sintattico)"
REASON_PASSIVE = "costruzione passiva (sintattico)"
REASON_LEXICAL = "parola non di base (lessicale)"
REASON_OTHER = "altro"
SPAN_SUBORDINATE = "clausola subordinata/participiale"
SPAN_PASSIVE = "costruzione passiva"
SPAN_RARE_PREFIX = "parole non di base: "
SPAN_UNCLEAR = "motivo non chiaro"


def _in(col: Column, values) -> Column:
    return col.isin(*values)


# ------------------------------------------------------------------ pairs / eval set
def build_pairs(sentences: DataFrame) -> DataFrame:
    """(idx, original, simplification) from a melted sentence table; ids
    lacking either side are dropped. One aggregation instead of a self-join."""
    return (sentences.groupBy(ID)
            .agg(F.min(F.when(F.col("is_original"), F.col("text"))).alias("original"),
                 F.min(F.when(~F.col("is_original"), F.col("text"))).alias("simplification"))
            .dropna(subset=["original", "simplification"])
            .withColumnRenamed(ID, "idx"))


def build_eval_set(pairs: DataFrame, silver: str = "set") -> DataFrame:
    """G1 + G5/G6/G7: annotate both sides and attach silver labels.

    silver = "set" (lemma absent from the simplification, SQL-expressible),
    "aligned" (G6) or "guarded" (G7, the default of the explanation study)."""
    x = pairs.select("idx", "original", "simplification",
                     T.tokenize("original").alias("tokens"), T.tokenize("simplification").alias("simp_tokens"))
    x = x.withColumns({"lemmas": T.lemmas_of("tokens"), "simp_lemmas": T.lemmas_of("simp_tokens")})
    x = x.withColumns({"pos": F.transform("lemmas", pos_of), "dep": F.transform("lemmas", dep_of)})
    if silver == "set":
        tipo = T.once("simp_lemmas", lambda there: F.transform("lemmas", lambda l: F.when(
            F.array_contains(there, l), F.lit("keep")).otherwise(F.lit("del"))))
    elif silver in ("aligned", "guarded"):
        tipo = typed_silver("tokens", "lemmas", "simp_tokens", "simp_lemmas", guarded=silver == "guarded")
    else:
        raise ValueError(f"unknown silver mode {silver!r}")
    x = x.withColumn("tipo", tipo)
    return x.withColumn("silver", labels_from_types("tipo", "both"))


# ------------------------------------------------------------------ methods
def predict_random(eval_set: DataFrame, rate: float = 0.3, seed: str = "42", name: str = "random") -> DataFrame:
    """k = round_half_even(rate * n) random positions per sentence (md5 order)."""
    n = F.size("tokens")
    k = F.bround(F.lit(rate) * n, 0).cast("int")
    ranked = F.array_sort(F.transform("tokens", lambda t, i: F.struct(
        md5_order(seed, ":", F.col("idx"), ":", i).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(ranked, 1, F.least(k, n)), lambda s: s["i"])
    return eval_set.select("idx", F.lit(name).alias("method"),
                           T.indices_to_binary(chosen, n).alias("pred"))


def token_table(eval_set: DataFrame, *cols: str) -> DataFrame:
    """Explode parallel arrays to one row per token: idx, i, <cols>."""
    z = F.arrays_zip(*[F.col(c).alias(c) for c in cols])
    return eval_set.select("idx", F.posexplode(z).alias("i", "_z")).select("idx", "i", *[F.col(f"_z.{c}").alias(c) for c in cols])


def regroup(tokens: DataFrame, value: str, name: str) -> DataFrame:
    """Token rows back to one ordered array per sentence (groups are sentences)."""
    return (tokens.groupBy("idx")
            .agg(F.array_sort(F.collect_list(F.struct("i", value))).alias("_a"))
            .select("idx", F.transform("_a", lambda s: s[value]).alias(name)))


def lexicon_flags(eval_set: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Token rows with ``in_lexicon`` via a broadcast left join (the lexicon
    is a bounded word list)."""
    toks = token_table(eval_set, "lemmas", "pos")
    lex = F.broadcast(lexicon.select(F.col("lemma").alias("lemmas"), F.lit(True).alias("_hit")).distinct())
    return toks.join(lex, "lemmas", "left").withColumn("in_lexicon", F.col("_hit").isNotNull()).drop("_hit")


def predict_lexicon(eval_set: DataFrame, lexicon: DataFrame, name: str = "lexicon") -> DataFrame:
    """Content words whose lemma is not in the basic lexicon, a bounded word
    list that every task holds; the choice is made inside the row. Sentences
    without tokens have no prediction."""
    words = lexicon.agg(F.collect_set("lemma").alias("_lexicon"))
    x = eval_set.where(F.size("tokens") > 0).select("idx", "lemmas", "pos").crossJoin(F.broadcast(words))
    pred = T.once(F.array_except("lemmas", "_lexicon"), lambda rare: F.transform(F.arrays_zip("lemmas", "pos"), lambda t: (
        _in(t["pos"], CONTENT_POS) & F.array_contains(rare, t["lemmas"])).cast("int")))
    return x.select("idx", F.lit(name).alias("method"), pred.alias("pred"))


def predict_top_fraction(eval_set: DataFrame, scores: DataFrame, frac: float,
                         name: str = "attribution") -> DataFrame:
    """The k = max(1, round_half_even(frac * n)) highest-scored tokens
    (ties: larger position first). ``scores``: idx and either ``attributions``,
    an array by position, or token rows (i, attribution). The choice is made
    inside the row after one join on the id; positions without a score are
    never chosen, scores past the sentence's end are ignored."""
    if "attributions" in scores.columns:
        ranked = scores.select("idx", F.transform(
            "attributions", lambda a, i: F.struct(a.cast("double").alias("attribution"), i.alias("i"))).alias("_s"))
    else:
        ranked = scores.groupBy("idx").agg(F.collect_list(F.struct(
            F.col("attribution").cast("double").alias("attribution"), F.col("i").cast("int").alias("i"))).alias("_s"))
    n = F.size("tokens")
    k = F.greatest(F.lit(1), F.bround(F.lit(frac) * n, 0).cast("int"))
    j = eval_set.select("idx", "tokens").join(ranked, "idx")
    best = F.sort_array(F.filter("_s", lambda s: s["i"] < n), asc=False)
    chosen = F.transform(F.slice(best, 1, k), lambda s: s["i"])
    return j.select("idx", F.lit(name).alias("method"), T.indices_to_binary(chosen, n).alias("pred"))


def predict_from_responses(eval_set: DataFrame, responses: DataFrame, name: str = "llm") -> DataFrame:
    """G22 + G8: parsed model annotations (``id, response``) as 0/1 vectors;
    sentences without a response or with a failed parse get all zeros."""
    e = eval_set.select("idx", F.size("tokens").alias("n"))
    r = responses.select(F.col("id").alias("idx"), "response")
    j = e.join(r, "idx", "left").withColumn("a", extract_annotation("response", "n"))
    idx = F.coalesce(F.col("a.complex"), F.array().cast("array<bigint>"))
    return j.select("idx", F.lit(name).alias("method"), T.indices_to_binary(idx, F.col("n")).alias("pred"))


# ------------------------------------------------------------------ evaluation
def alignment_report(eval_set: DataFrame, preds: DataFrame) -> DataFrame:
    """Sentences whose tokens / silver / prediction sizes differ."""
    j = eval_set.join(preds, "idx")
    return j.select("idx", "method", F.size("tokens").alias("n_tokens"), F.size("silver").alias("n_silver"),
                    F.size("pred").alias("n_pred")).where(
        (F.col("n_tokens") != F.col("n_silver")) | (F.col("n_tokens") != F.col("n_pred")))


def checked_predictions(eval_set: DataFrame, preds: DataFrame, strict: bool = True) -> DataFrame:
    """The predictions that can be evaluated, each method's sentences
    matched by id. Sizes of tokens, silver labels and predictions that differ,
    and sentences without a prediction or predictions without a sentence, raise
    while the plan runs if ``strict``, else they are left out (``alignment_report``
    lists them)."""
    sizes = eval_set.select("idx", F.size("tokens").alias("_t"), F.size("silver").alias("_s"))
    wanted = sizes.crossJoin(F.broadcast(preds.select("method").distinct()))   # a row a method
    j = wanted.join(preds.withColumn("_there", F.lit(True)), ["idx", "method"], "full")
    fits = F.coalesce((F.col("_t") == F.col("_s")) & (F.col("_t") == F.size("pred")) & F.col("_there"), F.lit(False))
    if strict:
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(
            F.lit("tokens, silver labels and predictions do not match: sentence "), F.col("idx").cast("string"),
            F.lit(", method "), F.coalesce("method", F.lit("?")))).cast("boolean"))
    return j.where(fits).select(*preds.columns)


def _confusion_arrays(y: Column, p: Column) -> dict[str, Column]:
    z = F.arrays_zip(y.alias("y"), p.alias("p"))
    cnt = lambda f: F.size(F.filter(z, f))
    return {"tp": cnt(lambda e: (e["y"] == 1) & (e["p"] == 1)),
            "fp": cnt(lambda e: (e["y"] == 0) & (e["p"] == 1)),
            "fn": cnt(lambda e: (e["y"] == 1) & (e["p"] == 0))}


def sentence_scores(eval_set: DataFrame, preds: DataFrame, with_ter: bool = False) -> DataFrame:
    """Per (method, sentence): P/R/F1 (0/0 = 0), word edit distance of the kept
    tokens to the simplification at substitution cost 1, 1.5, 2 [and TER].
    Misaligned sentences are skipped (see ``alignment_report``)."""
    j = eval_set.join(preds, "idx")   # C5: by key, never by position
    j = j.where((F.size("tokens") == F.size("silver")) & (F.size("tokens") == F.size("pred")))
    # counted once, each is used several times
    j = j.select("idx", "method", "tokens", "simp_tokens", "pred", *[
        x.alias(c) for c, x in _confusion_arrays(F.col("silver"), F.col("pred")).items()])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    div = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
    kept = T.kept_tokens("tokens", "pred")
    out = j.select("idx", "method", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
                   div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                   word_edit_distances(kept, F.col("simp_tokens")).alias("_ed"),
                   *([F.array_join(kept, " ").alias("_hyp"), F.array_join("simp_tokens", " ").alias("_ref")]
                     if with_ter else []))
    out = out.select("*", "_ed.*").drop("_ed")
    if with_ter:
        out = out.withColumn("ter", ter("_hyp", "_ref")).drop("_hyp", "_ref")
    return out


def evaluate(eval_set: DataFrame, preds: DataFrame, with_ter: bool = False) -> DataFrame:
    """D17 + D22: mean per-sentence metrics per method, with the number of
    evaluated sentences; all methods in one job."""
    s = sentence_scores(eval_set, preds, with_ter)
    metrics = ["precision", "recall", "f1", "ed_sub1", "ed_sub1_5", "ed_sub2"] + (["ter"] if with_ter else [])
    return s.groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics],
                                   F.count(F.lit(1)).cast("long").alias("n_evaluated"))


def typed_evaluation(eval_set: DataFrame, preds: DataFrame) -> DataFrame:
    """Per target in {del, sub}: positives are tokens of that type, negatives
    ``keep``; the other type is excluded; sentences without positives skipped."""
    j = eval_set.join(preds, "idx").where(F.size("tipo") == F.size("pred"))
    rows = []
    for target in ("del", "sub"):
        z = F.filter(F.arrays_zip(F.col("tipo").alias("t"), F.col("pred").alias("p")),
                     lambda e: e["t"].isin("keep", target))
        cnt = lambda f: F.size(F.filter(z, f))
        tp = cnt(lambda e: (e["t"] == target) & (e["p"] == 1))
        fp = cnt(lambda e: (e["t"] == "keep") & (e["p"] == 1))
        fn = cnt(lambda e: (e["t"] == target) & (e["p"] == 0))
        rows.append(j.select("method", F.lit(target).alias("target"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))
    x = rows[0].unionByName(rows[1]).where(F.col("tp") + F.col("fn") > 0)
    div = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return x.groupBy("method", "target").agg(
        F.avg(div(tp, tp + fp)).alias("precision"), F.avg(div(tp, tp + fn)).alias("recall"),
        F.avg(div(2 * tp, 2 * tp + fp + fn)).alias("f1"), F.count(F.lit(1)).cast("long").alias("n_sentences"))


def positive_rates(eval_set: DataFrame, preds: DataFrame) -> DataFrame:
    """D16 + D26: mean per-sentence positive rate of silver and of each method,
    and the number of empty predictions per method."""
    silver = eval_set.select(F.lit("silver").alias("method"), T.positive_rate("silver").alias("r"),
                             (F.aggregate("silver", F.lit(0), lambda a, x: a + x) == 0).alias("e"))
    p = preds.select("method", T.positive_rate("pred").alias("r"),
                     (F.aggregate("pred", F.lit(0), lambda a, x: a + x) == 0).alias("e"))
    return silver.unionByName(p).groupBy("method").agg(
        F.avg("r").alias("positive_rate"), F.count_if("e").cast("long").alias("n_empty"))


def disagreement(eval_set: DataFrame, preds: DataFrame, top_k: int = 10) -> DataFrame:
    """Sentences where methods disagree most: per token the population std
    of the 0/1 predictions across methods, averaged over the sentence; top-k,
    ties broken by the larger index. A token that fewer than two methods label
    raises while the plan runs."""
    n = eval_set.select("idx", F.size("tokens").alias("n"))
    t = (preds.join(n, "idx").select("idx", "method", F.posexplode(F.slice("pred", 1, F.col("n"))).alias("i", "p")))
    per_tok = t.groupBy("idx", "i").agg(F.stddev_pop("p").alias("sd"), F.count(F.lit(1)).alias("m"))
    per_tok = per_tok.where(F.when(F.col("m") >= 2, True).otherwise(F.raise_error(F.lit(
        "disagreement needs the predictions of two methods at least")).cast("boolean")))
    per_sent = per_tok.groupBy("idx").agg(F.round(F.avg("sd"), 9).alias("score"))   # engine-independent ties
    return per_sent.orderBy(F.desc("score"), F.desc("idx")).limit(top_k)


def agreement_sets(eval_set: DataFrame, preds: DataFrame) -> DataFrame:
    """per sentence and method, positions found by both, only predicted and
    only silver, with counts; sentences with neither side positive skipped."""
    j = eval_set.join(preds, "idx")
    p_idx, s_idx = T.binary_to_indices("pred"), T.binary_to_indices("silver")
    x = j.select("idx", "method", p_idx.alias("p"), s_idx.alias("s")).where((F.size("p") > 0) | (F.size("s") > 0))
    return x.select("idx", "method",
                    F.array_intersect("p", "s").alias("common"), F.array_except("p", "s").alias("only_pred"),
                    F.array_except("s", "p").alias("only_silver"))


def explain_tokens(eval_set: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row per silver-positive token: idx, token, operation, reason
    (subordinate clause > passive > non-basic content word > other)."""
    t = token_table(eval_set, "tokens", "lemmas", "pos", "dep", "silver", "tipo").where(F.col("silver") == 1)
    lex = F.broadcast(lexicon.select(F.col("lemma").alias("lemmas"), F.lit(True).alias("_hit")).distinct())
    t = t.join(lex, "lemmas", "left")
    reason = (F.when(_in(F.col("dep"), SUB_DEPS), F.lit(REASON_SUBORDINATE))
              .when(_in(F.col("dep"), PASS_DEPS), F.lit(REASON_PASSIVE))
              .when(_in(F.col("pos"), CONTENT_POS) & F.col("_hit").isNull(), F.lit(REASON_LEXICAL))
              .otherwise(F.lit(REASON_OTHER)))
    return t.select("idx", "i", F.col("tokens").alias("token"), F.col("tipo").alias("operazione"),
                    reason.alias("motivo"))


def reason_counts(explanations: DataFrame) -> DataFrame:
    """Explanation reasons by frequency, "altro" excluded."""
    return (explanations.where(F.col("motivo") != REASON_OTHER)
            .groupBy("motivo").agg(F.count(F.lit(1)).cast("long").alias("n")))


def explain_spans(eval_set: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Reasons for each span (maximal run of silver-positive tokens):
    subordinate clause, passive, listed non-basic words, else "unclear"."""
    t = token_table(eval_set, "tokens", "lemmas", "dep", "silver").where(F.col("silver") == 1)
    # consecutive positions share (i - rank): a span id without any ordering over the whole table
    w = Window.partitionBy("idx").orderBy("i")
    t = t.withColumn("span", F.col("i") - F.row_number().over(w))
    lex = F.broadcast(lexicon.select(F.col("lemma").alias("lemmas"), F.lit(True).alias("_hit")).distinct())
    t = t.join(lex, "lemmas", "left")
    g = t.groupBy("idx", "span").agg(
        F.min("i").alias("start"), F.count(F.lit(1)).alias("n_tokens"),
        F.max(_in(F.col("dep"), SUB_DEPS).cast("int")).alias("sub"),
        F.max(_in(F.col("dep"), PASS_DEPS).cast("int")).alias("pas"),
        F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.struct("i", "tokens")))).alias("rare"))
    rare = F.transform("rare", lambda s: s["tokens"])
    reasons = F.filter(F.array(
        F.when(F.col("sub") == 1, F.lit(SPAN_SUBORDINATE)),
        F.when(F.col("pas") == 1, F.lit(SPAN_PASSIVE)),
        F.when(F.size(rare) > 0, F.concat(F.lit(SPAN_RARE_PREFIX), F.array_join(rare, ", ")))),
        lambda x: x.isNotNull())
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(SPAN_UNCLEAR)))
    return g.select("idx", "start", F.col("n_tokens").cast("long").alias("n_tokens"),
                    F.array_join(reasons, "; ").alias("reasons"))


def operation_counts(eval_set: DataFrame) -> DataFrame:
    """Deletions, substitutions and tokens per sentence."""
    return eval_set.select("idx", T.count_ops("tipo", "del").alias("n_del"), T.count_ops("tipo", "sub").alias("n_sub"),
                           F.size("tokens").alias("n_tokens"))


def parse_status_counts(eval_set: DataFrame, responses: DataFrame) -> DataFrame:
    """Parse outcome counts (ok / recovered_regex / unparsable / empty)."""
    e = eval_set.select("idx", F.size("tokens").alias("n"))
    r = responses.select(F.col("id").alias("idx"), "response")
    a = e.join(r, "idx", "left").select(extract_annotation("response", "n")["status"].alias("status"))
    return a.groupBy("status").agg(F.count(F.lit(1)).cast("long").alias("n"))


def failed_records(eval_set: DataFrame, responses: DataFrame, width: int = 90) -> DataFrame:
    """Unparsed responses with their id and first ``width`` characters."""
    e = eval_set.select("idx", F.size("tokens").alias("n"))
    r = responses.select(F.col("id").alias("idx"), "response")
    a = e.join(r, "idx", "left").withColumn("a", extract_annotation("response", "n"))
    return a.where(F.col("a.complex").isNull()).select(
        "idx", F.coalesce(F.substring("response", 1, width), F.lit("")).alias("head"), F.col("a.status").alias("status"))


def prompt_audit(prompts: DataFrame, text: str, limit: int) -> DataFrame:
    """Longest prompt (in tokens of the library tokenizer) and how many exceed ``limit``."""
    n = F.size(T.tokenize(text))
    return prompts.agg(F.max(n).cast("long").alias("max_len"), F.count_if(n > limit).cast("long").alias("n_over"),
                       F.count(F.lit(1)).cast("long").alias("n_prompts"))
