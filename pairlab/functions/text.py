"""Scalar, string and array functions on token arrays (G1, G2, G5, G8, G9,
G11, G14-G16, G30-G32) as built-in Column expressions.

Everything here compiles to Catalyst higher-order functions, but G11, which
runs in NumPy for a batch; no Python runs per row.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlab.functions import chardist

# Fixed values (must stay as they are for equal results).
SENTENCE_SPLIT = r"[.][ \n]+"
TOKEN_PATTERN = r"\p{L}+|[^\s\p{L}]"
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV")
SUBORDINATE_DEPS = ("advcl", "acl", "ccomp", "xcomp", "csubj", "mark")
PASSIVE_DEPS = ("nsubj:pass", "aux:pass", "csubj:pass")


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """From the Unicode decompositions: lower-case letters whose base is one
    letter and those bases, followed by the combining marks (which have no
    counterpart, so that translate drops them); and ligatures with their letters."""
    one, many = {}, {}
    for c in map(chr, [*range(0xC0, 0x2000), *range(0xFB00, 0xFB07)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and base != c and base:
            (one if len(base) == 1 else many)[c] = base
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
    return "".join(one) + marks, "".join(one.values()), {k: v for k, v in many.items() if ord(k) >= 0xFB00}


ACCENTED, UNACCENTED, LIGATURES = _plain_letters()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """G1 (token part): letters runs or single non-space symbols."""
    return F.regexp_extract_all(_c(text), F.lit(f"({TOKEN_PATTERN})"), 1)


def split_sentences(text) -> Column:
    return F.split(_c(text), SENTENCE_SPLIT)


def join_tokens(tokens) -> Column:
    return F.array_join(_c(tokens), " ")


def char_count(tokens) -> Column:
    """Total characters of the tokens (native: length of their concatenation)."""
    return F.length(F.array_join(_c(tokens), ""))


def gulpease_of(n_tokens, n_chars) -> Column:
    """Sentence complexity 1 - Gulpease/100 clamped to [0, 1] (one sentence) of
    a sentence with so many tokens and characters; null without tokens."""
    n, chars = _c(n_tokens), _c(n_chars)
    total = n.cast("double")
    raw = (F.lit(89.0) + F.lit(300.0) / total - F.lit(10.0) * chars.cast("double") / total) / F.lit(100.0)
    return F.when(n > 0, F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def gulpease_complexity(tokens) -> Column:
    """``gulpease_of`` a token list."""
    t = _c(tokens)
    return gulpease_of(F.size(t), char_count(t))


def norm_token(tok) -> Column:
    """Lower, trim, strip accents, drop apostrophes and backticks."""
    t = F.lower(F.btrim(_c(tok), F.lit(" \t\n\r\x0b\x0c")))
    for ligature, letters in LIGATURES.items():
        t = F.replace(t, F.lit(ligature), F.lit(letters))
    t = F.translate(t, ACCENTED, UNACCENTED)
    return F.translate(t, "'’`", "")


def lemmas_of(tokens) -> Column:
    return F.transform(_c(tokens), lambda t: F.lower(t))


def silver_set_labels(lemmas, simp_lemmas) -> Column:
    """1 when a lemma is not among the simplified lemmas."""
    return F.transform(_c(lemmas),
                       lambda l: F.when(F.array_contains(_c(simp_lemmas), l), 0).otherwise(1))


def once(value, of) -> Column:
    """``of(value)`` for an ``of`` that uses the value inside a lambda: as a lambda's
    argument it is worked out once, as an expression for every element."""
    return F.get(F.transform(F.array(_c(value)), of), 0)


def indices_to_binary(indices, n) -> Column:
    """Index list -> 0/1 vector of length n, out-of-range indices ignored."""
    n = _c(n)
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(once(indices, lambda chosen: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.when(F.array_contains(chosen, i), 1).otherwise(0))))


def binary_to_indices(pred) -> Column:
    """Inverse of G8: positions holding 1."""
    return F.filter(F.transform(_c(pred), lambda p, i: F.when(p == 1, i)), lambda x: x.isNotNull())


def kept_tokens(tokens, pred) -> Column:
    """Tokens whose prediction is 0."""
    p = _c(pred)
    return F.filter(_c(tokens), lambda t, i: F.coalesce(F.try_element_at(p, i + 1), F.lit(0)) == 0)


def char_edit_distance(a, b) -> Column:
    """Character Levenshtein distance, many pairs at once (see ``chardist``)."""
    return chardist.char_edit_distance(_c(a), _c(b))


def whitespace_words(text) -> Column:
    return F.filter(F.split(F.trim(F.lower(_c(text))), r"\s+"), lambda w: w != "")


def lexical_overlap(a, b) -> Column:
    """|set(a) & set(b)| / max(|set(a)|, 1), lower-cased whitespace words."""
    wa = F.array_distinct(whitespace_words(a))
    wb = F.array_distinct(whitespace_words(b))
    return F.size(F.array_intersect(wa, wb)).cast("double") / F.greatest(F.size(wa), F.lit(1)).cast("double")


def numbered_tokens(text, tokens) -> Column:
    """The sentence followed by one "i: token" line per token."""
    lines = F.transform(_c(tokens), lambda t, i: F.concat(i.cast("string"), F.lit(": "), t))
    return F.concat_ws("\n", _c(text), F.array_join(lines, "\n"))


def chat_messages(system_text: str, user_text, examples: list[tuple[str, str]] = ()) -> Column:
    """array<struct<role, content>> of a system turn, few-shot turns and the user turn."""
    msgs = [F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content"))]
    for user, assistant in examples:
        msgs.append(F.struct(F.lit("user").alias("role"), F.lit(user).alias("content")))
        msgs.append(F.struct(F.lit("assistant").alias("role"), F.lit(assistant).alias("content")))
    msgs.append(F.struct(F.lit("user").alias("role"), _c(user_text).cast("string").alias("content")))
    return F.array(*msgs)


def bracket_highlight(tokens, pred) -> Column:
    """Tokens joined by blanks with highlighted ones as [tok]."""
    p = _c(pred)
    return F.array_join(F.transform(_c(tokens), lambda t, i: F.when(
        F.coalesce(F.try_element_at(p, i + 1), F.lit(0)) == 1, F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)), " ")


def truncate_tokens(tokens, max_len: int) -> Column:
    """Keep the first ``max_len`` tokens (model input limit)."""
    return F.slice(_c(tokens), 1, max_len)


def count_ops(tipo, op: str) -> Column:
    """Number of tokens with a given operation label."""
    return F.size(F.filter(_c(tipo), lambda x: x == op))


def positive_rate(pred) -> Column:
    """Per-sentence share of ones (null for an empty vector); D16 averages it."""
    p = _c(pred)
    return F.when(F.size(p) > 0, F.aggregate(p, F.lit(0), lambda a, x: a + x).cast("double") / F.size(p))
