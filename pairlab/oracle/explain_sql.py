"""DuckDB SQL for the explanation family (eval set, methods, metrics)."""

from __future__ import annotations

from pairlab.oracle.fixtures_sql import bucket, order_key

TOKEN_RE = r"'\p{L}+|[^\s\p{L}]'"
CONTENT = "('NOUN', 'VERB', 'ADJ', 'ADV')"
SUB_DEPS = "('advcl', 'acl', 'acl:relcl', 'ccomp', 'xcomp', 'csubj')"
PASS_DEPS = "('aux:pass', 'nsubj:pass')"


def ed_sql(a: str, b: str, sub: str) -> str:
    """Word edit distance DP as nested list_reduce (insert = delete = 1)."""
    return (f"(list_reduce({a}, lambda acc, x: {{'i': acc.i + 1, 'row': list_reduce(range(1, len({b}) + 1), "
            f"lambda cur, j: list_append(cur, least(acc.row[j + 1] + 1, cur[j] + 1, acc.row[j] + "
            f"CASE WHEN x = {b}[j] THEN 0.0 ELSE {sub} END)), [CAST(acc.i + 1 AS DOUBLE)])}}, "
            f"{{'i': 0, 'row': list_transform(range(0, len({b}) + 1), lambda j: CAST(j AS DOUBLE))}}).row[len({b}) + 1])")


def _tag(lem: str, prefix: str, tags: tuple[str, ...], other: str) -> str:
    arr = "[" + ", ".join(f"'{t}'" for t in tags) + "]"
    return (f"CASE WHEN regexp_full_match({lem}, '\\p{{L}}+') THEN {arr}[{bucket(f'concat({prefix!r}, {lem})', len(tags))} + 1] "
            f"ELSE '{other}' END")


POS_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "DET")
DEP_TAGS = ("advcl", "acl", "nsubj:pass", "aux:pass", "obj", "root")

PAIRS = """pairs AS (SELECT l.original_sentence_idx AS idx,
    min(CASE WHEN is_original THEN text END) AS original, min(CASE WHEN NOT is_original THEN text END) AS simplification
  FROM long l JOIN sp ON l.original_sentence_idx = sp.id WHERE split = 'test' GROUP BY 1)"""

EV = f"""ev0 AS (SELECT idx, original, simplification, regexp_extract_all(original, {TOKEN_RE}) AS tokens,
    regexp_extract_all(simplification, {TOKEN_RE}) AS simp_tokens
  FROM pairs WHERE original IS NOT NULL AND simplification IS NOT NULL),
ev1 AS (SELECT *, list_transform(tokens, lambda t: lower(t)) AS lemmas,
    list_transform(simp_tokens, lambda t: lower(t)) AS simp_lemmas FROM ev0),
ev AS (SELECT *, list_transform(lemmas, lambda l: {_tag('l', 'pos:', POS_TAGS, 'PUNCT')}) AS pos,
    list_transform(lemmas, lambda l: {_tag('l', 'dep:', DEP_TAGS, 'punct')}) AS dep,
    list_transform(lemmas, lambda l: CASE WHEN list_contains(simp_lemmas, l) THEN 'keep' ELSE 'del' END) AS tipo,
    list_transform(lemmas, lambda l: CASE WHEN list_contains(simp_lemmas, l) THEN 0 ELSE 1 END) AS silver
  FROM ev1)"""


def random_pred(rate: float, seed: str = "42", name: str = "random") -> str:
    ranked = (f"list_sort(list_transform(tokens, lambda t, i: {{'h': {order_key(f'concat({seed!r}, chr(58), idx, chr(58), i - 1)')}, "
              f"'i': i - 1}}))")
    k = f"CAST(round_even({rate!r}::DOUBLE * len(tokens), 0) AS INTEGER)"
    return (f"SELECT idx, '{name}' AS method, list_transform(range(0, len(tokens)), lambda i: CASE WHEN "
            f"list_contains(list_transform({ranked}[1:{k}], lambda s: s.i), i) THEN 1 ELSE 0 END) AS pred FROM ev")


LEXICON_PRED = f"""SELECT idx, 'lexicon' AS method, list_transform(range(1, len(tokens) + 1), lambda i:
    CASE WHEN pos[i] IN {CONTENT} AND NOT list_contains(lex, lemmas[i]) THEN 1 ELSE 0 END) AS pred
  FROM ev, (SELECT list(lemma) AS lex FROM lexicon)"""


def top_fraction_pred(frac: float, name: str, max_len: int | None = None) -> str:
    body = f"""SELECT idx, '{name}' AS method, list(p ORDER BY i) AS pred FROM (
    SELECT s.sid AS idx, s.i, CASE WHEN row_number() OVER (PARTITION BY s.sid ORDER BY s.attribution DESC, s.i DESC)
        <= greatest(1, CAST(round_even({frac!r}::DOUBLE * len(ev.tokens), 0) AS INTEGER)) THEN 1 ELSE 0 END AS p
    FROM tok_scores s JOIN ev ON s.sid = ev.idx WHERE s.i < len(ev.tokens)) GROUP BY idx"""
    if max_len is not None:
        body = f"SELECT idx, method, pred[1:{max_len}] AS pred FROM ({body})"
    return body


def preds_cte(parts: list[str]) -> str:
    return "preds AS (" + "\nUNION ALL\n".join(parts) + ")"


def scores_cte() -> str:
    kept = "list_filter(tokens, lambda t, i: pred[i] = 0)"
    n = "len(tokens)"
    cnt = lambda cond: f"len(list_filter(range(1, {n} + 1), lambda i: {cond}))"
    tp, fp, fn = cnt("silver[i] = 1 AND pred[i] = 1"), cnt("silver[i] = 0 AND pred[i] = 1"), cnt("silver[i] = 1 AND pred[i] = 0")
    return f"""sc0 AS (SELECT ev.idx, method, tokens, simp_tokens, pred, {tp} AS tp, {fp} AS fp, {fn} AS fn
  FROM ev JOIN preds ON ev.idx = preds.idx WHERE len(tokens) = len(silver) AND len(tokens) = len(pred)),
sc AS (SELECT idx, method,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
  {ed_sql(kept, 'simp_tokens', '1.0')} AS ed_sub1, {ed_sql(kept, 'simp_tokens', '1.5')} AS ed_sub1_5,
  {ed_sql(kept, 'simp_tokens', '2.0')} AS ed_sub2 FROM sc0)"""
