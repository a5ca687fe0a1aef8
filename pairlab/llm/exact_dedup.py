"""Exact dedup by progressive refinement: group by length, then by the hash
of a prefix, then by the hash of the whole text.

Each step looks closer at fewer rows. The first two need the length and a few
leading characters of each row; only rows that still share both with another
row are hashed in full. Groups are counted by pre-aggregated sums, and the
counts come back to the rows by a join with one row a group on the other side,
which is split where a group is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.storage import stored

PREFIX_CHARS = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def full_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, lower-case hex."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _keys(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> list[Column]:
    text = docs[text_col].cast("string")
    return [docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).alias("length"),
            F.xxhash64(normalised(F.substring(text, 1, prefix_chars))).alias("prefix")]


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that have the same keys as another row."""
    groups = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    return rows.join(groups, keys, "left_semi")


def _on_keys(a: DataFrame, b: DataFrame) -> Column:
    return (a["length"] == b["length"]) & (a["prefix"] == b["prefix"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row for each distinct (id, text): doc_id, length, prefix, hash (null
    if length and prefix already tell the row from all others), copies (rows
    with this id and text), group_size, keep_id."""
    rows = stored(docs.select(*_keys(docs, id_col, text_col, prefix_chars)), "dedup-rows")
    close = stored(_shared(_shared(rows, ["length"]), ["length", "prefix"]).distinct(), "dedup-close")
    texts = docs.select(*_keys(docs, id_col, text_col, prefix_chars), docs[text_col].alias("text"))
    # the narrow side is hashed: no sort of texts
    full = texts.join(close.hint("shuffle_hash"), _on_keys(texts, close), "left_semi").select(
        "doc_id", "length", "prefix", full_hash(F.col("text")).alias("hash"))
    full = stored(full.groupBy("doc_id", "length", "prefix", "hash").agg(F.count("*").alias("copies")), "dedup-full")
    groups = full.groupBy("length", "prefix", "hash").agg(
        F.sum("copies").alias("group_size"), F.max("doc_id").alias("keep_id"))
    columns = ["doc_id", "length", "prefix", "hash", "copies", "group_size", "keep_id"]
    alike = full.join(groups, ["length", "prefix", "hash"]).select(*columns)
    alone = rows.join(close, _on_keys(rows, close), "left_anti").select(
        "doc_id", "length", "prefix", F.lit(None).cast("string").alias("hash"), F.lit(1).cast("long").alias("copies"),
        F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"))
    return alike.unionByName(alone)


def _each_copy(groups: DataFrame) -> DataFrame:
    """A row for each document row again; one of the copies of keep_id stays."""
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = groups.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.withColumn("kept", stays & (F.col("copy") == 1))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) for every row of ``docs``; texts are
    equal if identical after lower-casing A-Z. Of equal texts the row with the
    largest id stays; of repeated rows (one id, one text) exactly one.

    Null texts count as empty; null ids come before all others, so keep_id is
    null only if all ids of the group are; an empty table gives no rows; other
    columns are not read."""
    return _each_copy(duplicate_groups(docs, id_col, text_col, prefix_chars)).select(
        "doc_id", "keep_id", "group_size", "kept")


def with_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``exact_duplicates`` with text_sha256 of every row's normalised text."""
    groups = duplicate_groups(docs, id_col, text_col)
    digests = docs.select(*_keys(docs, id_col, text_col, PREFIX_CHARS),
                          full_hash(docs[text_col]).alias("text_sha256")).distinct()
    same = _on_keys(digests, groups) & F.coalesce(groups["hash"] == digests["text_sha256"], F.lit(True))
    joined = digests.join(groups, same).select(digests["doc_id"], "keep_id", "group_size", "copies", "text_sha256")
    return _each_copy(joined).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, without the rows that are not kept."""
    groups = duplicate_groups(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keys = docs.select(*_keys(docs, id_col, text_col, PREFIX_CHARS), F.struct("*").alias("row"))
    same = _on_keys(keys, groups) & F.when(
        groups["hash"].isNotNull(), groups["hash"] == full_hash(keys["row"][text_col])).otherwise(F.lit(True))
    kept = keys.join(groups.hint("shuffle_hash"), same)
    single = kept.where("copies = 1").select("row.*")
    # repeated rows with one id and one text: any one of them, reduced before the shuffle
    repeated = kept.where("copies > 1").groupBy(keys["doc_id"], keys["length"], keys["prefix"], "hash").agg(
        F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
