"""DuckDB SQL for the gating family (gold/inputs, sample, gate, routing, scores)."""

from __future__ import annotations

from pairlab.oracle.explain_sql import TOKEN_RE, ed_sql
from pairlab.oracle.fixtures_sql import bucket, order_key
from pairlab.oracle.sqlfn import f1, qlist, sdiv


def long_share_sql(text: str) -> str:
    t = f"regexp_extract_all({text}, {TOKEN_RE})"
    return (f"(CASE WHEN len({t}) > 0 THEN CAST(len(list_filter({t}, lambda w: length(w) > 6)) AS DOUBLE) "
            f"/ CAST(len({t}) AS DOUBLE) END)")


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def overlap_sql(a: str, b: str) -> str:
    wa = f"list_distinct(list_filter(string_split_regex(trim(lower({a})), '\\s+'), lambda w: w <> ''))"
    wb = f"list_distinct(list_filter(string_split_regex(trim(lower({b})), '\\s+'), lambda w: w <> ''))"
    return f"(CAST(len(list_intersect({wa}, {wb})) AS DOUBLE) / CAST(greatest(len({wa}), 1) AS DOUBLE))"


def stub_sql(text: str, key: str) -> str:
    from pairlab.oracle.fixtures_sql import simplify_sql, token_hashes_sql
    t = f"regexp_extract_all({text}, {TOKEN_RE})"
    return f"array_to_string({simplify_sql(t, token_hashes_sql(t, key), '9')}, ' ')"


def grams_sql(t: str, n: int) -> str:
    return (f"(CASE WHEN len({t}) >= {n} THEN list_transform(range(0, len({t}) - {n} + 1), "
            f"lambda i: array_to_string({t}[i + 1:i + {n}], ' ')) ELSE CAST([] AS VARCHAR[]) END)")


def gram_counts_sql(s: str, c: str, r: str, n: int) -> str:
    S, C, R = grams_sql(s, n), grams_sql(c, n), grams_sql(r, n)
    return (f"list_transform(list_distinct(list_concat(list_concat({S}, {C}), {R})), lambda g: "
            f"{{'s': len(list_filter({S}, lambda x: x = g)), 'c': len(list_filter({C}, lambda x: x = g)), "
            f"'r': len(list_filter({R}, lambda x: x = g))}})")


def _one(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 1.0::DOUBLE END)"


def _lsum(lst: str, expr: str) -> str:
    return f"coalesce(list_sum(list_transform({lst}, lambda x: CAST({expr} AS DOUBLE))), 0.0::DOUBLE)"


def _f1(p: str, r: str) -> str:
    return f"(CASE WHEN ({p}) > 0 OR ({r}) > 0 THEN 2.0::DOUBLE * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0::DOUBLE END)"


def sari_parts_sql(cnt: str) -> tuple[str, str, str]:
    keep = f"list_filter({cnt}, lambda x: x.s > 0 AND x.c > 0)"
    keep_all = f"list_filter({cnt}, lambda x: x.s > 0 AND x.r > 0)"
    kp = _one(_lsum(keep, "least(x.s, x.c, x.r) / least(x.s, x.c)"), f"len({keep})")
    kr = _one(_lsum(keep, "least(x.s, x.c, x.r)"), _lsum(keep_all, "least(x.s, x.r)"))
    dele = f"list_filter({cnt}, lambda x: x.s > x.c)"
    dp = _one(_lsum(dele, "greatest(x.s - x.c - x.r, 0) / (x.s - x.c)"), f"len({dele})")
    good = f"len(list_filter({cnt}, lambda x: x.c > 0 AND x.s = 0 AND x.r > 0))"
    addn = f"len(list_filter({cnt}, lambda x: x.c > 0 AND x.s = 0))"
    alln = f"len(list_filter({cnt}, lambda x: x.r > 0 AND x.s = 0))"
    return _f1(kp, kr), dp, _f1(_one(good, addn), _one(good, alln))


def sari_from_counts_sql(prefix: str) -> str:
    parts = [sari_parts_sql(f"{prefix}{n}") for n in range(1, 5)]
    k = " + ".join(p[0] for p in parts)
    d = " + ".join(p[1] for p in parts)
    a = " + ".join(p[2] for p in parts)
    return f"((({k}) / 4 + ({d}) / 4 + ({a}) / 4) / 3.0::DOUBLE * 100.0::DOUBLE)"


def tok_lower(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {TOKEN_RE})"


def sari_grouped_sql(source: str) -> str:
    """(idx, sari) of the rows (idx, ts, tc, tr) of ``source``: grams are rows, counted by (idx, n, gram)."""
    sides = " UNION ALL ".join(
        f"SELECT idx, {n} AS n, unnest({grams_sql(t, n)}) AS g, {int(t == 'ts')} AS s, {int(t == 'tc')} AS c, "
        f"{int(t == 'tr')} AS r FROM {source}" for n in range(1, 5) for t in ("ts", "tc", "tr"))

    def share(num: str, den: str) -> str:
        return f"CASE WHEN coalesce({den}, 0) > 0 THEN {num} / {den} ELSE 1.0::DOUBLE END"

    return f"""SELECT idx, sum({_f1('kp', 'kr')} + dp + {_f1('ap', 'ar')}) / 4 / 3.0::DOUBLE * 100.0::DOUBLE AS sari FROM (
  SELECT i.idx, i.n, {share('kps', 'nk')} AS kp, {share('krs', 'wanted')} AS kr, {share('dps', 'nd')} AS dp,
    {share('good', 'added')} AS ap, {share('good', 'due')} AS ar
  FROM (SELECT idx, unnest([1, 2, 3, 4]) AS n FROM {source}) i LEFT JOIN (
    SELECT idx, n, CAST(count(*) FILTER (WHERE s > 0 AND c > 0) AS DOUBLE) AS nk,
      coalesce(sum(least(s, c, r) / CAST(least(s, c) AS DOUBLE)) FILTER (WHERE s > 0 AND c > 0), 0) AS kps,
      CAST(coalesce(sum(least(s, c, r)) FILTER (WHERE s > 0 AND c > 0), 0) AS DOUBLE) AS krs,
      CAST(sum(least(s, r)) AS DOUBLE) AS wanted,
      CAST(count(*) FILTER (WHERE s > c) AS DOUBLE) AS nd,
      coalesce(sum(greatest(s - c - r, 0) / CAST(s - c AS DOUBLE)) FILTER (WHERE s > c), 0) AS dps,
      CAST(count(*) FILTER (WHERE s = 0 AND c > 0 AND r > 0) AS DOUBLE) AS good,
      CAST(count(*) FILTER (WHERE s = 0 AND c > 0) AS DOUBLE) AS added,
      CAST(count(*) FILTER (WHERE s = 0 AND r > 0) AS DOUBLE) AS due
    FROM (SELECT idx, n, g, sum(s) AS s, sum(c) AS c, sum(r) AS r FROM ({sides}) GROUP BY idx, n, g)
    GROUP BY idx, n) x ON i.idx = x.idx AND i.n = x.n) GROUP BY idx"""


GATING_BASE = f"""pt AS (SELECT * FROM pair_rows WHERE original_sentence_idx IN (SELECT id FROM sp WHERE split = 'test')),
valid AS (SELECT * FROM pt WHERE round(original_all - simplification_all, 9) > 0.05::DOUBLE),
gold AS (SELECT original_sentence_idx, simplification AS gold_text, simplification_all AS gold_score, idx AS gold_idx
  FROM (SELECT *, row_number() OVER (PARTITION BY original_sentence_idx ORDER BY simplification_all, idx) AS rn FROM valid) WHERE rn = 1),
g_orig AS (SELECT original_sentence_idx, original_sentence_idx * 11 + 10 AS gid, original_text AS input_text,
    original_all AS input_score, CAST(NULL AS BIGINT) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY original_sentence_idx ORDER BY idx) AS rn FROM pt) WHERE rn = 1),
g_oth AS (SELECT original_sentence_idx, original_sentence_idx * 11 + idx % 10 AS gid, simplification AS input_text,
    simplification_all AS input_score, idx AS v FROM valid),
g AS (SELECT i.original_sentence_idx, gid, input_text, input_score, gold_text, gold_score,
    input_score - gold_score AS gap_to_gold,
    CASE WHEN round(input_score - gold_score, 9) > 0.10::DOUBLE THEN 1 ELSE 0 END AS true_label
  FROM (SELECT * FROM g_orig UNION ALL SELECT * FROM g_oth) i JOIN gold ON i.original_sentence_idx = gold.original_sentence_idx
  WHERE v IS NULL OR v <> gold_idx)"""


def sample_sql(n: int = 10000) -> str:
    return f"""cnt AS (SELECT true_label, count(*) AS ns FROM g GROUP BY true_label),
alloc0 AS (SELECT *, {float(n)!r}::DOUBLE * ns / sum(ns) OVER () AS ex FROM cnt),
alloc AS (SELECT true_label, least(ns, floor(ex) + CASE WHEN row_number() OVER (ORDER BY ex - floor(ex) DESC, true_label)
    <= {n} - sum(floor(ex)) OVER () THEN 1 ELSE 0 END) AS take FROM alloc0),
smp AS (SELECT g.* FROM (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY {order_key("concat('42', ':', gid)")}, gid) AS rn FROM g) g
  JOIN alloc ON g.true_label = alloc.true_label WHERE rn <= take)"""


#: All gating rows under the sample's name.
ALL_ROWS = "smp AS (SELECT * FROM g)"


def gate_sql(lo: float = 0.1, hi: float = 0.9, n: int = 81) -> str:
    from pairlab.operators.metrics import linspace
    qs = linspace(lo, hi, n)
    p, r = sdiv("tp", "tp + fp"), sdiv("tp", "tp + fn")
    return f"""vs AS (SELECT {long_share_sql('text')} AS pred, CASE WHEN is_original THEN 1 ELSE 0 END AS label
  FROM long JOIN sp ON long.original_sentence_idx = sp.id WHERE split = 'val'),
gc AS (SELECT DISTINCT round(unnest(quantile_cont(pred, {qlist(qs)})), 9) AS thr FROM vs WHERE pred IS NOT NULL),
gev AS (SELECT thr, count(*) FILTER (WHERE label = 1 AND round(pred, 9) > thr) AS tp,
  count(*) FILTER (WHERE label = 0 AND round(pred, 9) > thr) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT round(pred, 9) > thr) AS fn
  FROM gc, (SELECT * FROM vs WHERE pred IS NOT NULL) v GROUP BY thr),
gthr AS (SELECT thr FROM gev ORDER BY {f1(p, r)} DESC, thr ASC LIMIT 1),
gated AS (SELECT smp.*, CASE WHEN round({long_share_sql('input_text')}, 9) > (SELECT thr FROM gthr) THEN 1 ELSE 0 END AS pred_gate
  FROM smp),
quad AS (SELECT *, CASE WHEN true_label = 1 AND pred_gate = 1 THEN 'TP' WHEN true_label = 1 AND pred_gate = 0 THEN 'FN'
  WHEN true_label = 0 AND pred_gate = 0 THEN 'TN' ELSE 'FP' END AS quadrante FROM gated)"""


ROUTED = f"""gen AS (SELECT *, {stub_sql('input_text', 'input_text')} AS gen_output FROM quad),
clean AS (SELECT *, {overlap_sql('input_text', 'gold_text')} AS ov FROM gen),
routed AS (SELECT *, gen_output AS out_A, CASE WHEN pred_gate = 1 THEN gen_output ELSE input_text END AS out_B
  FROM clean WHERE ov >= 0.2::DOUBLE),
rt AS (SELECT *, {tok_lower('input_text')} AS ts, {tok_lower('out_A')} AS ta, {tok_lower('out_B')} AS tb,
  {tok_lower('gold_text')} AS tr FROM routed),
rc AS (SELECT *, {", ".join(f"{gram_counts_sql('ts', 'ta', 'tr', n)} AS ca{n}" for n in range(1, 5))},
  {", ".join(f"{gram_counts_sql('ts', 'tb', 'tr', n)} AS cb{n}" for n in range(1, 5))} FROM rt),
scored AS (SELECT *, {sari_from_counts_sql('ca')} AS sari_A, {sari_from_counts_sql('cb')} AS sari_B,
  {ed_sql(words_sql('out_A'), words_sql('gold_text'), '1.5')} AS ed_A,
  {ed_sql(words_sql('out_B'), words_sql('gold_text'), '1.5')} AS ed_B FROM rc)"""
