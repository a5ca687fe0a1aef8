"""Token counts as delta-maintained rollups.

A store is a folder with two tables: ``entries`` (signed counts by document)
and ``deltas`` (the same summed by source, language and tokenizer version),
both with one folder a batch, and ``commits``, one small file a batch, written
last. Inserts, deletes and revised counts become signed entries against what
the store holds for the document; totals are sums of committed deltas and never
read the entries. A batch that is committed already is not applied again; one
that broke off before its commit is written anew from its start."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.byte_bpe import loaded, vocabulary_text

INSERT, DELETE, REVISE = "insert", "delete", "revise"
GROUP = ["source", "lang", "tokenizer"]


class RollupStore:
    def __init__(self, spark: SparkSession, folder: str, id_type: T.DataType | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        group = [T.StructField(c, T.StringType()) for c in GROUP]
        sums = [T.StructField(c, T.LongType()) for c in ("docs", "tokens")]
        self.entry_schema = T.StructType([T.StructField("doc_id", id_type or T.LongType()), *group, *sums])
        self.delta_schema = T.StructType([*group, *sums])

    def committed(self) -> list[str]:
        """Ids of the committed batches (as many rows as there are batches)."""
        try:
            rows = self.spark.read.schema("batch string").parquet(f"{self.folder}/commits/*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.batch for r in rows)

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        paths = [f"{self.folder}/{name}/{b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self) -> DataFrame:
        """(doc_id, source, lang, tokenizer, docs, tokens) held now."""
        return (self._table("entries", self.entry_schema).groupBy("doc_id", *GROUP)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens): sums of committed deltas."""
        return (self._table("deltas", self.delta_schema).groupBy(*GROUP)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, source, lang, tokenizer, tokens); False
        if the batch was committed before.

        insert adds a document's count; delete takes away all that the store
        holds for the id under the tokenizer; revise does both. Repeated rows
        of a batch: inserts add up, deletes and revisions of an id and
        tokenizer count once (of revisions, the greatest count). Null sources,
        languages and ids are groups and ids of their own; a delete of what is
        not held changes nothing; an empty batch is committed as such."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch id is made of letters, digits, '_', '.' and '-'")
        if batch in self.committed():
            return False
        columns = ["doc_id", *GROUP, "tokens"]
        added = changes.where(F.col("op") == INSERT).select(*columns, F.lit(1).cast("long").alias("docs"))
        revised = (changes.where(F.col("op") == REVISE).groupBy("doc_id", *GROUP).agg(F.max("tokens").alias("tokens"))
                   .select(*columns, F.lit(1).cast("long").alias("docs")))
        gone = changes.where(F.col("op").isin(DELETE, REVISE)).select(
            F.col("doc_id").alias("gone_id"), F.col("tokenizer").alias("gone_tokenizer")).distinct()
        held = self.current()
        taken = held.join(gone, held["doc_id"].eqNullSafe(gone["gone_id"]) & held["tokenizer"].eqNullSafe(
            gone["gone_tokenizer"]), "left_semi").select("doc_id", *GROUP, (-F.col("tokens")).alias("tokens"),
                                                         (-F.col("docs")).alias("docs"))
        entries = added.unionByName(revised).unionByName(taken).select(
            [F.col(f.name).cast(f.dataType) for f in self.entry_schema])
        entries.write.mode("overwrite").parquet(f"{self.folder}/entries/{batch}")
        written = self.spark.read.schema(self.entry_schema).parquet(f"{self.folder}/entries/{batch}")
        (written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}"))
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/commits/{batch}")
        return True


def counted(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, n_bytes, n_tokens, n_bytes_trimmed, n_trimmed):
    bytes and byte-level BPE ids of each whole text, and of the text without
    surrounding white space. Null texts count as empty. One pass, no shuffle."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    rows = docs.select(docs[id_col].alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    names = ["n_bytes", "n_tokens", "n_bytes_trimmed", "n_trimmed"]
    schema = T.StructType([*rows.schema.fields[:3], *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value)
        for b in batches:
            sums = []
            for x in b.column(3):
                text = x.as_py() or ""
                trimmed = text.strip()
                n = len(bpe.encode(text)) // 4
                sums.append((len(text.encode()), n, len(trimmed.encode()),
                             n if trimmed == text else len(bpe.encode(trimmed)) // 4))
            columns = list(zip(*sums, strict=True)) if sums else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, pa.int64()) for c in columns)],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)
