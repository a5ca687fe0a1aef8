"""SARI of (source, output, one reference), computed inside each row.

Per n = 1..4 the n-grams of the three token arrays are counted, then the
keep-F1, deletion precision and addition-F1 of the public SARI definition are
formed; SARI = 100 * mean of the three 4-gram averages. Tokens: lower-cased
text split by the rule of the library tokenizer (G1).

Execution path: an Arrow UDF over the lower-cased texts. Within a batch equal
texts, and equal words of them, are cut into tokens once, and the n-grams of all
rows are counted together as runs of sorted (row, gram, side) numbers in NumPy;
a row's grams never leave its task, so nothing is shuffled. Time and memory grow with the number of tokens, whatever their
spread over rows. The same formula as Catalyst higher-order functions
(``with_sari_expr``) needs O(L^2) interpreted lambda calls per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from pairlab.functions.ragged import token_ids
from pairlab.functions.text import TOKEN_PATTERN, tokenize

MAX_N = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ngrams(tokens: Column, n: int) -> Column:
    k = F.size(tokens) - n
    return F.when(k >= 0, F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(0))),
                                      lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def _count(arr: Column, g: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x == g))


def _div_or_one(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(1.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p > 0) | (r > 0), 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))


def gram_counts(s: Column, c: Column, r: Column) -> Column:
    """Per distinct gram of the row: its counts in source, output and reference."""
    u = F.array_distinct(F.concat(s, c, r))
    return F.transform(u, lambda g: F.struct(_count(s, g).alias("s"), _count(c, g).alias("c"),
                                            _count(r, g).alias("r")))


def sari_parts(cnt: Column) -> Column:
    """(keep, del, add) scores of one gram order from its gram counts, as a struct."""
    keep = F.filter(cnt, lambda x: (x["s"] > 0) & (x["c"] > 0))
    keep_all = F.filter(cnt, lambda x: (x["s"] > 0) & (x["r"] > 0))
    kp = _div_or_one(_sum(keep, lambda x: F.least(x["s"], x["c"], x["r"]) / F.least(x["s"], x["c"])), F.size(keep))
    kr = _div_or_one(_sum(keep, lambda x: F.least(x["s"], x["c"], x["r"]).cast("double")),
                     _sum(keep_all, lambda x: F.least(x["s"], x["r"]).cast("double")))
    dele = F.filter(cnt, lambda x: x["s"] > x["c"])
    dp = _div_or_one(_sum(dele, lambda x: F.greatest(x["s"] - x["c"] - x["r"], F.lit(0)) / (x["s"] - x["c"])),
                     F.size(dele))
    add_good = F.size(F.filter(cnt, lambda x: (x["c"] > 0) & (x["s"] == 0) & (x["r"] > 0)))
    add_n = F.size(F.filter(cnt, lambda x: (x["c"] > 0) & (x["s"] == 0)))
    add_all = F.size(F.filter(cnt, lambda x: (x["r"] > 0) & (x["s"] == 0)))
    ap, ar = _div_or_one(add_good, add_n), _div_or_one(add_good, add_all)
    return F.struct(_f1(kp, kr).alias("keep"), dp.alias("del"), _f1(ap, ar).alias("add"))


def with_sari_expr(df, src: str, out: str, ref: str, name: str = "sari"):
    """Add column ``name`` = SARI(src, out, ref) * 100. Gram counts are
    materialised once per order in a projection of their own, then scored."""
    tok = lambda x: tokenize(F.lower(F.col(x)))
    s, c, r = tok(src), tok(out), tok(ref)
    tmp = [f"_sari_cnt{n}_{name}" for n in range(1, MAX_N + 1)]
    x = df.withColumns({t: gram_counts(ngrams(s, n), ngrams(c, n), ngrams(r, n))
                        for n, t in zip(range(1, MAX_N + 1), tmp)})
    parts = [sari_parts(F.col(t)) for t in tmp]
    keep = sum(p["keep"] for p in parts) / MAX_N
    dele = sum(p["del"] for p in parts) / MAX_N
    add = sum(p["add"] for p in parts) / MAX_N
    return x.withColumn(name, (keep + dele + add) / 3.0 * 100.0).drop(*tmp)


def sari_py(src: list[str], out: list[str], ref: list[str]) -> float:
    """Plain-Python statement of the same formula (tests)."""
    from collections import Counter

    def grams(t, n):
        return [" ".join(t[i:i + n]) for i in range(len(t) - n + 1)]

    tot = [0.0, 0.0, 0.0]
    for n in range(1, MAX_N + 1):
        s, c, r = Counter(grams(src, n)), Counter(grams(out, n)), Counter(grams(ref, n))
        keep = s & c
        kp = sum(min(keep[g], r[g]) / keep[g] for g in keep) / len(keep) if keep else 1.0
        kall = s & r
        kr = sum(min(keep[g], r[g]) for g in keep) / sum(kall.values()) if kall else 1.0
        k = 2 * kp * kr / (kp + kr) if (kp > 0 or kr > 0) else 0.0
        dele = s - c
        dp = sum(max(dele[g] - r[g], 0) / dele[g] for g in dele) / len(dele) if dele else 1.0
        add = set(c) - set(s)
        good = add & set(r)
        aall = set(r) - set(s)
        ap = len(good) / len(add) if add else 1.0
        ar = len(good) / len(aall) if aall else 1.0
        a = 2 * ap * ar / (ap + ar) if (ap > 0 or ar > 0) else 0.0
        tot[0] += k
        tot[1] += dp
        tot[2] += a
    return sum(x / MAX_N for x in tot) / 3.0 * 100.0


def _ratio(num: np.ndarray, den: np.ndarray, empty: float) -> np.ndarray:
    return np.divide(num, den, out=np.full(len(num), empty), where=den > 0)


def _harmonic(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    return _ratio(2 * p * r, p + r, 0.0)


def _numbered(codes: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Codes and a number above them; numbered anew where keys of ``least`` times
    as many would not fit 63 bits."""
    span = int(codes.max(initial=0)) + 1
    if least * span >= 1 << 63:
        codes = pd.factorize(codes)[0].astype(np.int64)
        span = int(codes.max(initial=0)) + 1
    return codes, span


def _scores(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> np.ndarray:
    """SARI of rows whose source, output and reference (rows of ``of``) are the
    texts of these numbers."""
    rows = of.shape[1]
    owner, side = np.tile(np.arange(rows), 3), np.repeat(np.arange(3), rows)
    begin, size = starts[of.ravel()], lengths[of.ravel()]
    vocabulary, total = int(ids.max(initial=0)) + 1, np.zeros(rows)
    # the gram that begins at each token, also beyond its text's end, where no row looks
    pairs = pd.factorize(ids[:-1] * vocabulary + ids[1:])[0].astype(np.int64)
    kinds = int(pairs.max(initial=0)) + 1
    grams = (ids, pairs, pairs[:-1] * vocabulary + ids[2:], pairs[:-2] * kinds + pairs[2:])
    for n, gram in enumerate(grams, 1):
        held = np.maximum(size - n + 1, 0)
        at = np.arange(int(held.sum())) + np.repeat(begin - (np.cumsum(held) - held), held)
        gram, span = _numbered(gram, 4 * rows)
        keys = (gram[at] + np.repeat(owner * span, held)) * 4 + np.repeat(side, held)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))             # of the equal grams of a side of a row
        count, run = np.diff(first, append=len(keys)), keys[first]
        gram_of, which = run >> 2, run & 3
        new = np.diff(gram_of, prepend=-1) != 0
        group = np.cumsum(new) - 1
        counts = np.zeros((3, int(new.sum())), np.int64)
        counts[which, group] = count
        s, c, r = counts
        row = gram_of[new] // span

        def each(where: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(row[where], weights=None if values is None else values[where], minlength=rows)

        kept, wanted, gone = np.minimum(s, c), np.minimum(s, r), s - c
        good, stays, goes = np.minimum(kept, r), kept > 0, gone > 0
        precision = _ratio(each(stays, _ratio(good, kept, 0.0)), each(stays), 1.0)
        keep = _harmonic(precision, _ratio(each(stays, good), each(wanted > 0, wanted), 1.0))
        dele = _ratio(each(goes, _ratio(np.maximum(gone - r, 0), gone, 0.0)), each(goes), 1.0)
        added, due = (c > 0) & (s == 0), (r > 0) & (s == 0)
        hits = each(added & due)
        add = _harmonic(_ratio(hits, each(added), 1.0), _ratio(hits, each(due), 1.0))
        total += keep + dele + add
    return total / MAX_N / 3.0 * 100.0


def batched_sari(src: pd.Series, out: pd.Series, ref: pd.Series) -> np.ndarray:
    """SARI of each row of three token array columns; NaN where one is null."""
    scores = np.full(len(src), np.nan)
    known = np.flatnonzero((src.notna() & out.notna() & ref.notna()).to_numpy())
    if len(known):
        ids, starts, lengths = token_ids([x.iloc[known] for x in (src, out, ref)])
        scores[known] = _scores(ids, starts.ravel(), lengths.ravel(), np.arange(3 * len(known)).reshape(3, -1))
    return scores


#: White space of the tokenizer (what ``\s`` means in Java): no token holds any.
_SPACE = r" \t\n\x0b\f\r"
_TOKEN = regex.compile(TOKEN_PATTERN.replace(r"\s", _SPACE))


def _tokens(texts: pa.Array) -> pa.ListArray:
    """What ``tokenize`` returns for each text; a word between white space is cut once a batch."""
    words = pc.split_pattern_regex(texts, f"[{_SPACE}]+")
    each = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    cut = [_TOKEN.findall(w) for w in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    pieces = pc.dictionary_encode(pa.array([t for w in cut for t in w], pa.string()))
    code = coded.indices.to_numpy(zero_copy_only=False)
    n = sizes[code]                                                   # tokens of each word
    at = np.arange(int(n.sum())) + np.repeat((np.cumsum(sizes) - sizes)[code] - (np.cumsum(n) - n), n)
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(each)])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.indices.take(pa.array(at)))


@arrow_udf(DoubleType())
def _sari_udf(s: pa.Array, c: pa.Array, r: pa.Array) -> pa.Array:
    known = pc.and_(pc.and_(s.is_valid(), c.is_valid()), r.is_valid())
    texts = pc.dictionary_encode(pa.concat_arrays([x.filter(known) for x in (s, c, r)]))   # equal texts are cut once
    scores = np.full(len(s), np.nan)
    if len(texts):
        lists = _tokens(texts.dictionary)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        of = texts.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(3, -1)
        scores[known.to_numpy(zero_copy_only=False)] = _scores(ids, np.cumsum(lengths) - lengths, lengths, of)
    return pa.array(scores, mask=~known.to_numpy(zero_copy_only=False))


def sari(src, out, ref) -> Column:
    """SARI of three text columns (lower-cased, library tokenizer)."""
    return _sari_udf(*[F.lower(_c(x)) for x in (src, out, ref)])


def with_sari(df, src: str, out: str, ref: str, name: str = "sari"):
    """Add column ``name`` = SARI(src, out, ref)."""
    return df.withColumn(name, sari(src, out, ref))
