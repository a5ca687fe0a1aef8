"""The registered queries of this subpackage and, where SQL can state them,
their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import (exact_dedup, hmm_lm, html_consensus, packing, piece_codec, secret_scan, simhash_trie,
                         spelling_variants, token_alignment, token_rollup, toxicity, warc_zip, weighted_minhash)
from pairlab.llm.storage import scratch_folder, stored
from pairlab.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Vocabulary files (parameters of the operators, never part of this repository).
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids in sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE)


def _rule_sql(rules: tuple[secret_scan.Rule, ...]) -> str:
    """Spans of every rule: places are sums of the lengths of what lies between
    the matches and of the matches."""
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    lists = ", ".join(f"regexp_extract_all(t, {quoted(r.java)}, 0) AS m{k}, "
                      f"regexp_extract_all(t, {quoted(r.java)}, {r.group}) AS g{k}, "
                      f"string_split_regex(t, {quoted(r.java)}) AS b{k}" for k, r in enumerate(rules))
    spans = ", ".join(
        f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': "
        f"length(array_to_string(b{k}[1:i], '')) + length(array_to_string(m{k}[1:i - 1], '')), 'k': {k}, 'e': "
        f"length(array_to_string(b{k}[1:i], '')) + length(array_to_string(m{k}[1:i], '')), 'n': length(g{k}[i])}}), "
        f"lambda x: x.n >= {r.min_chars}) AS s{k}" for k, r in enumerate(rules))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"

    def text(parts: list[str]) -> str:
        joined = " || ".join(parts)
        return (f"array_to_string(list_transform(list_sort({joined}), lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' "
                f"|| x.e), ',')")

    every = [f"s{k}" for k in range(len(rules))]
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, {lists} FROM d), "
            f"s AS (SELECT doc_id, {spans} FROM l) SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, "
            f"CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex, "
            f"sha256({text(every[:3])}) AS base_sha256, {text(every)} AS spans FROM s")


@_query("op2_secret_scan", _rule_sql(secret_scan.RULES))
def secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document through the trigram index."""
    rules = secret_scan.RULES
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"), rules)
    base = F.filter("spans", lambda s: s["order"] < len(secret_scan.BASE_RULES))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base, rules).cast("binary"), 256)
                        .alias("base_sha256"), secret_scan.span_text(F.col("spans"), rules).alias("spans"))


@_query("op3_simhash_near_dedup")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_trie.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op4_token_rollup")
def token_rollup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after three batches
    over all documents: load (inserts under a byte-level BPE and under bytes),
    trim (revised counts where white space surrounds the text) and purge
    (deletes of documents without any other text); trim is sent twice."""
    docs = _table(spark, sf_dir, "documents")
    counts = stored(token_rollup.counted(docs, BYTE_BPE), "token-counts")

    def changes(op: str, rows: DataFrame, tokens: str, n_bytes: str) -> DataFrame:
        own = ["doc_id", "source", "lang"]
        return rows.select(F.lit(op).alias("op"), *own, F.explode(F.array(
            F.struct(F.lit("byte_bpe_50k/1").alias("tokenizer"), F.col(tokens).alias("tokens")),
            F.struct(F.lit("utf8/1").alias("tokenizer"), F.col(n_bytes).alias("tokens")))).alias("c")).select(
            "op", *own, "c.tokenizer", "c.tokens")

    store = token_rollup.RollupStore(spark, scratch_folder(spark, "rollup"), counts.schema["doc_id"].dataType)
    store.commit("load", changes(token_rollup.INSERT, counts, "n_tokens", "n_bytes"))
    trimmed = changes(token_rollup.REVISE, counts.where("n_bytes_trimmed < n_bytes"), "n_trimmed", "n_bytes_trimmed")
    store.commit("trim", trimmed)
    store.commit("trim", trimmed)
    store.commit("purge", changes(token_rollup.DELETE, counts.where("n_bytes_trimmed = 0"), "n_trimmed", "n_bytes_trimmed"))
    return store.totals()


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
        ((CAST(('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31)
        AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@_query("op5_warc_zip", WARC_SQL)
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP packages and read back."""
    pages = _table(spark, sf_dir, "pages")
    manifest = warc_zip.archive_pages(spark, pages, min_bytes=0)
    return warc_zip.read_packages(manifest, pages.schema["page_id"].dataType).drop("payload", "url")


@_query("op6_weighted_fingerprints")
def weighted_fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with likenesses."""
    return weighted_minhash.edited_and_next(_table(spark, sf_dir, "documents"))


@_query("op7_hmm_score")
def hmm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under the hidden Markov model."""
    return hmm_lm.score_documents(_table(spark, sf_dir, "documents"))


DEDUP_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@_query("op8_exact_dedup", DEDUP_SQL)
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and digest of every document."""
    return exact_dedup.with_digests(_table(spark, sf_dir, "documents"))


@_query("op9_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@_query("op10_piece_codec")
def piece_codec_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces with their source spans, and decoded."""
    return piece_codec.piece_digests(_table(spark, sf_dir, "documents"), PIECES)


@_query("op11_token_alignment")
def token_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of both vocabularies aligned, with corpus-wide pair counts."""
    return token_alignment.align_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


#: The runs' checksums by the table form of crc32 over their UTF-8 bytes; near words share what is left when one
#: letter at the same place is deleted, or one is what is left of the other.
VARIANTS_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT CAST(doc_id AS VARCHAR) || ':' AS id, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT run, c, flatten(list_transform(string_split(id || run, ''), lambda x: CASE WHEN unicode(x) < 128
        THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), 128 + (unicode(x) & 63)] END)) AS b
    FROM counted),
hashed AS (SELECT run, c, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[xor(h & 255, x) + 1]), 4294967295), 4294967295) AS h
    FROM bytes, crc_table),
edited AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) ||
        substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cuts c JOIN words w ON c.cut = w.word),
pairs AS (SELECT a, b, bn FROM shorter UNION SELECT b, a, an FROM shorter UNION
    SELECT x.word, y.word, y.n FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, min({'less': -bn, 'near': b}) AS best FROM pairs GROUP BY a),
rows AS (SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
        CASE WHEN -best.less >= 10 * n THEN best.near END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
    FROM words LEFT JOIN best ON word = a),
walk AS (SELECT word, word AS root, form AS ahead FROM rows
    UNION ALL SELECT walk.word, walk.ahead, rows.form FROM walk JOIN rows ON walk.ahead = rows.word)
SELECT r.word, r.form, w.root, r.n, r.n_near, CAST(r.form_n AS BIGINT) AS form_n
FROM rows r JOIN walk w ON w.word = r.word WHERE w.ahead IS NULL
"""


@_query("op12_spelling_variants", VARIANTS_SQL)
def spelling_variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their near words, forms and roots."""
    return spelling_variants.group_variants(_table(spark, sf_dir, "documents"))


@_query("op13_html_extraction")
def html_extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's consensus path."""
    return html_consensus.extract_pages(_table(spark, sf_dir, "pages"))
