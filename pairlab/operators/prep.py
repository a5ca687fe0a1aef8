"""Projections, filters and cleaning of pair / sentence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META_COLUMNS = ("original_sentence_idx", "text", "score", "is_original")


def suffix_columns(df: DataFrame, suffix: str) -> list[str]:
    """Columns ending in ``suffix`` (feature discovery by name)."""
    return [c for c in df.columns if c.endswith(suffix)]


def strip_suffix_select(df: DataFrame, suffix: str, keep: list[str] = ()) -> DataFrame:
    """B1: select ``keep`` plus every ``*suffix`` column renamed without the suffix."""
    cols = [F.col(c) for c in keep] + [F.col(c).alias(c[: -len(suffix)]) for c in suffix_columns(df, suffix)]
    return df.select(*cols)


def shared_features(df: DataFrame, a_suffix: str = "_original", b_suffix: str = "_simplification") -> list[str]:
    """Feature names present with both suffixes, sorted (schema-only, no job)."""
    a = {c[: -len(a_suffix)] for c in suffix_columns(df, a_suffix)}
    b = {c[: -len(b_suffix)] for c in suffix_columns(df, b_suffix)}
    return sorted(a & b)


def gain(orig_col: str = "original_all", simp_col: str = "simplification_all"):
    """Readability gain, rounded to 9 decimals so that float noise never decides
    a boundary case differently on different engines."""
    return F.round(F.col(orig_col) - F.col(simp_col), 9)


def gain_filter(df: DataFrame, delta: float = 0.05, orig_col: str = "original_all",
                simp_col: str = "simplification_all") -> DataFrame:
    """Keep pairs whose complexity drops by more than ``delta``."""
    return df.where(gain(orig_col, simp_col) > F.lit(delta))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tolerant numeric coercion; unparsable values become null (ANSI-safe)."""
    repl = {c: F.expr(f"try_cast(`{c}` as double)") for c in columns}
    return df.withColumns(repl)


def drop_invalid(df: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    """Drop rows with null text/score or empty text."""
    return df.dropna(subset=[text, score]).where(F.length(text) > 0)


def feature_columns(df: DataFrame, meta: tuple[str, ...] = META_COLUMNS) -> list[str]:
    """Every column that is not a meta column."""
    return [c for c in df.columns if c not in meta and c != "split"]


def melt_pairs(pairs: DataFrame, originals: DataFrame, simplifications: DataFrame,
               features: list[str] | None = None) -> DataFrame:
    """B2 + F1: originals (one row per id) and simplifications as one sentence
    table with ``is_original``; feature columns are stripped of their suffix."""
    feats = features or []
    o = originals.select(
        "original_sentence_idx", F.col("original_text").alias("text"),
        F.col("original_all").alias("score"), F.lit(True).alias("is_original"),
        *[F.col(f"{f}_original").alias(f) for f in feats])
    s = simplifications.select(
        "original_sentence_idx", F.col("simplification").alias("text"),
        F.col("simplification_all").alias("score"), F.lit(False).alias("is_original"),
        *[F.col(f"{f}_simplification").alias(f) for f in feats])
    return o.unionByName(s, allowMissingColumns=True)


def variants_of(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """All variants of the given ids ordered by simplified score, desc."""
    return (pairs.join(ids, "original_sentence_idx", "left_semi")
            .orderBy("original_sentence_idx", F.desc("simplification_all"), "idx"))


def id_stats(df: DataFrame, key: str = "original_sentence_idx") -> DataFrame:
    """Distinct ids, null-key rows, mean rows per id."""
    return df.agg(F.count_distinct(key).cast("long").alias("n_ids"),
                  F.sum(F.col(key).isNull().cast("long")).alias("n_null"),
                  F.count(F.lit(1)).cast("long").alias("n_rows")).select(
        "n_ids", "n_null", "n_rows",
        F.round(F.col("n_rows") / F.col("n_ids"), 6).alias("rows_per_id"))


def split_report(sentences: DataFrame) -> DataFrame:
    """Rows and mean score per split and sentence kind."""
    return sentences.groupBy("split", "is_original").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_distinct("original_sentence_idx").cast("long").alias("n_ids"),
        F.avg("score").alias("avg_score"))


def split_overlaps(sentences: DataFrame, key: str = "original_sentence_idx") -> DataFrame:
    """Pairwise id overlap between splits (must be 0 everywhere).

    One aggregation: ids present in more than one split are counted per pair
    of splits, without materialising per-split id sets."""
    per_id = sentences.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    return per_id.agg(*[
        F.sum((F.array_contains("splits", a) & F.array_contains("splits", b)).cast("long")).alias(f"{a}_{b}")
        for a, b in pairs]).select(*[F.coalesce(F.col(f"{a}_{b}"), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
