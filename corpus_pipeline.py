"""The training-data pipeline: STAGES over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.exact_dedup import drop_exact_duplicates
from pairlab.llm.packing import pack_documents
from pairlab.llm.queries import BYTE_BPE
from pairlab.llm.secret_scan import redact_secrets
from pairlab.llm.simhash_trie import drop_near_duplicates
from pairlab.llm.storage import stored
from pairlab.llm.toxicity import fit, with_scores
from pairlab.session import ship_package

TOXIC = 0.5


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ``TOXIC``."""
    ship_package(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model).where(F.col("toxic_score") < TOXIC).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return drop_exact_duplicates(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets in its text replaced by a mask."""
    return redact_secrets(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    ship_package(spark)
    return pack_documents(docs, BYTE_BPE)


STAGES = [
    ("toxicity", keep_civil),
    ("exact dedup", keep_distinct),
    ("simhash near dedup", keep_one_of_near),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: The classifier, fingerprints and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
