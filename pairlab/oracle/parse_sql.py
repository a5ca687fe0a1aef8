"""DuckDB SQL of the annotation-parsing cascade (oracle for G17-G23, F4, D24, B16).

RE2 has no backreferences, so the reason-pair pattern uses the equivalent
alternation of a double-quoted and a single-quoted value.
"""

from __future__ import annotations

COMPLEX_LIST = r"""'(?s)"?complex"?\s*:\s*\[(.*?)\]'"""
REASONS_REGION = r"""'(?s)"?motivi"?\s*:\s*\{(.*)\}'"""
PAIR = r"""'["'']([0-9]+)["'']\s*:\s*(?:"([^"]*)"|''([^'']*)'')'"""


def first_balanced(x: str) -> str:
    """Prefix of x up to the first position where the brace depth returns to 0."""
    red = (f"list_reduce(string_split({x}, ''), lambda acc, ch: {{'d': acc.d + CASE WHEN ch = '{{' THEN 1 "
           f"WHEN ch = '}}' THEN -1 ELSE 0 END, 'p': acc.p + 1, 'c': CASE WHEN acc.c = 0 AND ch = '}}' AND "
           f"acc.d = 1 THEN acc.p + 1 ELSE acc.c END}}, {{'d': 0, 'p': 0, 'c': 0}}).c")
    return f"(CASE WHEN {red} > 0 THEN substr({x}, 1, {red}) ELSE {x} END)"


PARSE_CTES = [
    """rp AS (SELECT ev.idx, len(ev.tokens) AS n, r.response FROM ev LEFT JOIN responses r ON r.id = ev.idx)""",
    """rb AS (SELECT *, CASE WHEN strpos(response, '{') > 0 AND strpos(reverse(response), '}') > 0
      AND length(response) - strpos(reverse(response), '}') + 1 > strpos(response, '{')
    THEN substr(response, strpos(response, '{'), length(response) - strpos(reverse(response), '}') + 2 - strpos(response, '{'))
    ELSE response END AS blob FROM rp)""",
    f"""rj AS (SELECT *, CASE WHEN json_valid({first_balanced('blob')}) AND json_type({first_balanced('blob')}) = 'OBJECT'
      THEN {first_balanced('blob')}
    WHEN json_valid({first_balanced("replace(blob, '''', '\"')")}) AND json_type({first_balanced("replace(blob, '''', '\"')")}) = 'OBJECT'
      THEN {first_balanced("replace(blob, '''', '\"')")} END AS j FROM rb)""",
    r"""rv AS (SELECT *,
    j IS NOT NULL AND (NOT json_exists(j, '$.complex') OR (json_type(j, '$.complex') = 'ARRAY' AND coalesce(list_bool_and(
      list_transform(json_extract_string(j, '$.complex[*]'), lambda e: coalesce(regexp_full_match(e, '\s*-?\d+\s*'), false))), true)))
      AS json_ok,
    CASE WHEN j IS NOT NULL AND json_exists(j, '$.complex') AND json_type(j, '$.complex') = 'ARRAY'
      THEN list_sort(list_distinct(list_filter(list_transform(json_extract_string(j, '$.complex[*]'), lambda e: TRY_CAST(trim(e) AS BIGINT)),
        lambda i: i >= 0 AND i < n))) ELSE CAST([] AS BIGINT[]) END AS json_complex,
    CASE WHEN j IS NOT NULL AND json_type(j, '$.motivi') = 'OBJECT'
      THEN list_transform(json_keys(j, '$.motivi'), lambda k: {'k': k, 'v': json_extract_string(json_extract(j, '$.motivi'), '$."' || k || '"')})
      ELSE [] END AS json_motivi
    FROM rj)""",
    f"""rx AS (SELECT *,
    list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(
      CASE WHEN regexp_matches(blob, {COMPLEX_LIST}) THEN regexp_extract(blob, {COMPLEX_LIST}, 1) ELSE blob END, '\\b\\d+\\b'),
      lambda x: TRY_CAST(x AS BIGINT)), lambda i: i >= 0 AND i < n))) AS rx_idx,
    CASE WHEN regexp_matches(blob, {REASONS_REGION}) THEN regexp_extract(blob, {REASONS_REGION}, 1) ELSE '' END AS mreg
    FROM rv)""",
    f"""rx2 AS (SELECT *, list_filter(list_transform(range(1, len(regexp_extract_all(mreg, {PAIR}, 1)) + 1), lambda i:
      {{'k': regexp_extract_all(mreg, {PAIR}, 1)[i],
        'v': regexp_replace(coalesce(regexp_extract_all(mreg, {PAIR}, 2)[i], regexp_extract_all(mreg, {PAIR}, 3)[i]), '^\\s+|\\s+$', '', 'g')}}),
      lambda e: TRY_CAST(e.k AS BIGINT) >= 0 AND TRY_CAST(e.k AS BIGINT) < n) AS pairs FROM rx)""",
    """rx3 AS (SELECT *, list_filter(pairs, lambda e, i: NOT list_contains(list_transform(pairs[i + 1:], lambda o: o.k), e.k)) AS rx_motivi
    FROM rx2)""",
    """parsed AS (SELECT idx, n, response,
    CASE WHEN response IS NULL OR regexp_full_match(response, '\\s*') THEN 'empty' WHEN json_ok THEN 'ok'
         WHEN len(rx_idx) > 0 OR len(rx_motivi) > 0 THEN 'recovered_regex' ELSE 'unparsable' END AS status,
    json_complex, json_motivi, rx_motivi,
    list_sort(list_distinct(list_filter(list_concat(rx_idx, list_transform(rx_motivi, lambda e: TRY_CAST(e.k AS BIGINT))),
      lambda i: i >= 0 AND i < n))) AS rx_complex FROM rx3)""",
    """annot AS (SELECT idx, n, response, status,
    CASE status WHEN 'ok' THEN json_complex WHEN 'recovered_regex' THEN rx_complex END AS complex,
    CASE status WHEN 'ok' THEN json_motivi WHEN 'recovered_regex' THEN rx_motivi END AS motivi FROM parsed)""",
]

ANNOT_OUT = """SELECT idx, status, array_to_string(list_transform(complex, lambda x: CAST(x AS VARCHAR)), ',') AS complex,
  array_to_string(list_sort(list_transform(motivi, lambda e: e.k || '=' || e.v)), ';') AS motivi FROM annot"""
