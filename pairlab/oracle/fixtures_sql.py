"""DuckDB SQL of the derived fixtures, for the independent oracle.

``with_fixtures(["pair_rows"], body)`` prefixes a query with the CTEs it needs,
in dependency order. The definitions mirror ``pairlab.sources.fixtures``.
"""

from __future__ import annotations


def bucket(expr: str, mod: int = 100) -> str:
    return f"((('0x' || substr(md5({expr}), 1, 8))::BIGINT) % {mod})"


def order_key(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 15))::BIGINT)"


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def gulpease_sql(t: str) -> str:
    n = f"CAST(len({t}) AS DOUBLE)"
    chars = f"CAST(list_sum(list_transform({t}, lambda w: length(w))) AS DOUBLE)"
    raw = f"((89.0::DOUBLE + 300.0::DOUBLE / {n} - 10.0::DOUBLE * {chars} / {n}) / 100.0::DOUBLE)"
    return f"(CASE WHEN len({t}) > 0 THEN 1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, {raw})) END)"


def _features_sql(t: str) -> dict[str, str]:
    n = f"CAST(len({t}) AS DOUBLE)"
    nz = f"len({t}) > 0"
    return {
        "n_tokens": f"CAST(len({t}) AS DOUBLE)",
        "char_per_tok": f"(CASE WHEN {nz} THEN CAST(list_sum(list_transform({t}, lambda w: length(w))) AS DOUBLE) / {n} END)",
        "ttr": f"(CASE WHEN {nz} THEN CAST(len(list_distinct({t})) AS DOUBLE) / {n} END)",
        "punct_share": f"(CASE WHEN {nz} THEN CAST(len(list_filter({t}, lambda w: NOT regexp_full_match(w, '\\p{{L}}+'))) AS DOUBLE) / {n} END)",
        "long_share": f"(CASE WHEN {nz} THEN CAST(len(list_filter({t}, lambda w: length(w) > 6)) AS DOUBLE) / {n} END)",
    }


FEATURES = ("n_tokens", "char_per_tok", "ttr", "punct_share", "long_share")

def hex_threshold(share: float) -> str:
    return format(min(4095, round(4096 * share)), "03x")


DROP_HEX = "[" + ", ".join(f"'{hex_threshold((5 + 3 * v) / 100)}'" for v in range(10)) + "]"
REVERSE_HEX = hex_threshold(0.20)


def token_hashes_sql(tokens: str, key: str) -> str:
    return (f"list_transform({tokens}, lambda t, i: md5(concat('a:', {key}, ':', i - 1)) || "
            f"md5(concat('b:', {key}, ':', i - 1)))")


def simplify_sql(tokens: str, hashes: str, v: str) -> str:
    return (f"list_filter(list_transform({tokens}, lambda t, i: CASE "
            f"WHEN substr({hashes}[i], {v} * 6 + 1, 3) < {DROP_HEX}[{v} + 1] THEN NULL "
            f"WHEN length(t) > 6 AND substr({hashes}[i], {v} * 6 + 4, 3) < '{REVERSE_HEX}' THEN reverse(t) "
            f"ELSE t END), lambda x: x IS NOT NULL)")


_SIMP = simplify_sql("tokens", "hs", "v")


def _profile_cols() -> str:
    out = []
    slot = 0
    for side, t in (("original", "tokens"), ("simplification", "simp_tokens")):
        feats = _features_sql(t)
        for f in FEATURES:
            na = f"substr(md5(concat('na:', sid * 10 + v)), {2 * slot + 1}, 2) < '08'"
            slot += 1
            out.append(f"CASE WHEN {na} THEN 'n/a' ELSE CAST(round({feats[f]}, 6) AS VARCHAR) END AS {f}_{side}")
    return ",\n    ".join(out)


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sents": ((), r"""sents AS (
  SELECT doc_id * 1000000 + p AS sid, doc_id, p, tokens FROM (
    SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS p, unnest(parts) AS tokens FROM (
      SELECT doc_id, flatten(list_transform(list_transform(string_split_regex(text, '[.][ \n]+'),
          lambda piece: regexp_extract_all(piece, '\p{L}+|[^\s\p{L}]')),
        lambda ts: list_transform(range(0, len(ts), 40), lambda k: ts[k + 1:k + 40]))) AS parts FROM documents)))"""),
    "variants": (("sents",), f"""variants AS (
  SELECT sid, v, tokens, {_SIMP} AS simp_tokens
  FROM (SELECT sid, tokens, hs, unnest(generate_series(0, 9)) AS v
        FROM (SELECT sid, tokens, """ + token_hashes_sql("tokens", "sid") + """ AS hs FROM sents)))"""),
    "pair_rows": (("variants",), f"""pair_rows AS (
  SELECT sid * 10 + v AS idx, sid AS original_sentence_idx,
    array_to_string(tokens, ' ') AS original_text, array_to_string(simp_tokens, ' ') AS simplification,
    {gulpease_sql('tokens')} AS original_all, {gulpease_sql('simp_tokens')} AS simplification_all
  FROM variants)"""),
    "pair_rows_prof": (("variants",), f"""pair_rows_prof AS (
  SELECT sid * 10 + v AS idx, sid AS original_sentence_idx,
    array_to_string(tokens, ' ') AS original_text, array_to_string(simp_tokens, ' ') AS simplification,
    {gulpease_sql('tokens')} AS original_all, {gulpease_sql('simp_tokens')} AS simplification_all,
    {_profile_cols()}
  FROM variants)"""),
    "ann": (("sents",), f"""ann AS (
  SELECT sid, i - 1 AS i, token, lower(token) AS lemma,
    CASE WHEN regexp_full_match(token, '\\p{{L}}+')
         THEN ['NOUN', 'VERB', 'ADJ', 'ADV', 'DET'][{bucket("concat('pos:', lower(token))", 5)} + 1] ELSE 'PUNCT' END AS pos,
    CASE WHEN regexp_full_match(token, '\\p{{L}}+')
         THEN ['advcl', 'acl', 'nsubj:pass', 'aux:pass', 'obj', 'root'][{bucket("concat('dep:', lower(token))", 6)} + 1] ELSE 'punct' END AS dep
  FROM (SELECT sid, unnest(generate_series(1, len(tokens))) AS i, unnest(tokens) AS token FROM sents))"""),
    "lexicon": ((), r"""lexicon AS (
  SELECT lemma FROM (
    SELECT lemma, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS lemma FROM documents)
    GROUP BY lemma ORDER BY n DESC, lemma ASC LIMIT 200))"""),
    "tok_scores": (("sents",), f"""tok_scores AS (
  SELECT sid, i - 1 AS i, token, CAST({bucket("concat('a:', sid, ':', i - 1)")} - 50 AS DOUBLE) AS attribution
  FROM (SELECT sid, unnest(generate_series(1, len(tokens))) AS i, unnest(tokens) AS token FROM sents))"""),
    "responses": (("sents",), f"""resp_base AS (
  SELECT sid, len(tokens) AS n,
    list_filter(list_transform(tokens, lambda t, i: CASE WHEN {bucket("concat('r:', sid, ':', i - 1)")} < 30 THEN i - 1 END),
                lambda x: x IS NOT NULL) AS ids,
    {bucket("concat('f:', sid)", 6)} AS form
  FROM sents),
resp_txt AS (
  SELECT sid, n, form,
    array_to_string(list_transform(ids, lambda i: CAST(i AS VARCHAR)), ', ') AS ids_txt,
    array_to_string(list_transform(ids, lambda i: '"' || CAST(i AS VARCHAR) || '": "motivo ' || CAST(i AS VARCHAR) || '"'), ', ') AS reasons
  FROM resp_base),
responses AS (
  SELECT sid AS id, n, CASE form
    WHEN 0 THEN '{{"complex": [' || ids_txt || '], "motivi": {{' || reasons || '}}}}'
    WHEN 1 THEN translate('{{"complex": [' || ids_txt || '], "motivi": {{' || reasons || '}}}}', '"', '''')
    WHEN 2 THEN 'Ecco: ' || '{{"complex": [' || ids_txt || '], "motivi": {{' || reasons || '}}}}' || '}}}}'
    WHEN 3 THEN '{{"complex": [' || ids_txt || ', nota: vedi 0], "motivi": {{' || reasons || '}}}}'
    WHEN 4 THEN '   '
    ELSE 'Non so rispondere.' END AS response
  FROM resp_txt)"""),
}


def _long_share(t: str) -> str:
    return f"(CASE WHEN len({t}) > 0 THEN CAST(len(list_filter({t}, lambda w: length(w) > 6)) AS DOUBLE) / CAST(len({t}) AS DOUBLE) END)"


CTES["scored"] = (("variants",), f"""scored AS (
  SELECT * FROM (
    SELECT sid * 11 + v AS row_id, sid, 0 AS label, {gulpease_sql('simp_tokens')} AS y, {_long_share('simp_tokens')} AS pred,
      CASE WHEN {bucket("concat('cal:', sid)")} < 50 THEN 'val' ELSE 'test' END AS split FROM variants
    UNION ALL
    SELECT sid * 11 + 10 AS row_id, sid, 1 AS label, {gulpease_sql('tokens')} AS y, {_long_share('tokens')} AS pred,
      CASE WHEN {bucket("concat('cal:', sid)")} < 50 THEN 'val' ELSE 'test' END AS split FROM sents)
  WHERE y IS NOT NULL)""")


def with_fixtures(names: list[str], body: str, extra: list[str] = ()) -> str:
    """Prefix ``body`` with the CTEs of ``names`` (and dependencies), then ``extra`` CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [CTES[n][1] for n in order] + list(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
