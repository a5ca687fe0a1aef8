"""Alignment of two tokenizers' tokens over a corpus by inverted pair bitmaps.

Within a task, texts are cut into blocks of documents; each block holds, for
every pair of ids that some document links, compressed bitmaps of the documents
(by their number in the block): plane k has the documents whose number of links
of that pair has bit k set. The planes' union popcounts to the pair's documents,
plane k's popcount times 2^k sums to its links. Blocks are disjoint ranges of
documents, so OR-merging a pair's bitmaps over blocks sets them side by side and
its counts are sums of popcounts. The counts then go back to the blocks, where
the postings hand each document its scores.

Texts are cut before single spaces between visible characters, where neither
tokenizer has a token that crosses (the byte-level one splits there before it
merges; the piece vocabulary is checked to hold no space sign after another
character). Equal chunks are tokenized and linked once in a worker's memory;
tests compare with both libraries on whole texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.byte_bpe import PLAIN, ByteBpe, vocabulary_text
from pairlab.llm.storage import stored

SPACE = "▁"
#: Documents in a block at most: 4096 bits, 512 bytes for a full bitmap.
BLOCK_DOCS = 4096
#: Chunks in a block after which it ends.
BLOCK_CHUNKS = 500_000
#: Fewer documents than this are listed as 16-bit numbers, more are a bitmap.
LISTED = BLOCK_DOCS // 16
#: Chunks that a Python worker remembers, by number and by characters.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 12_000_000
#: Documents tokenized together; a block ends after a whole number of them.
TOGETHER = 128
#: Before a space that stands between two visible characters.
CUT = re.compile(r"(?<=\S)(?= \S)")


class PlainBpe(ByteBpe):
    """Byte-level BPE that reads special tokens' strings as plain text."""

    def __init__(self, vocabulary: str):
        super().__init__(vocabulary)
        self.special = []
        self.whole.encode_special_tokens = True

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), np.uint32).astype(np.int64)


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of every piece: its UTF-8, the space sign a space, <0xHH> a byte."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(model.get_piece_size())]


class Aligner:
    """Chunks of texts, each tokenized both ways and linked once."""

    def __init__(self, vocabulary: str, model: bytes):
        self.bpe = PlainBpe(vocabulary)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [self.bpe.fast.decode_single_token_bytes(i) if i < self.bpe.fast.n_vocab else b""
                        for i in range(self.bpe.whole.get_vocab_size())]
        self.b_bytes = piece_bytes(self.pieces)
        self.a_sizes, self.b_sizes = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.digits = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        inner = any(SPACE in self.pieces.id_to_piece(i).lstrip(SPACE) for i in range(len(self.b_bytes)))
        self.cut = None if inner else CUT
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.text: list[bytes] = []  # a1,a2|b1;a3|b2
        self.facts = np.zeros((1 << 16, 5), np.int64)  # n_a, n_b, n_groups, n_links, 1 if not aligned
        self.pairs: list[np.ndarray] = []  # a << 32 | b of every link

    def chunks(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the chunks of a space and each text; those not met before
        are tokenized together."""
        parts = [[] if not t else self.cut.split(" " + t) if self.cut else [" " + t] for t in texts]
        new = list(dict.fromkeys(p for own in parts for p in own if p not in self.number))
        ids = self.pieces.encode([p[1:] for p in new], num_threads=1) if new else []
        fast = self.bpe.fast.encode_ordinary
        first, facts = len(self.pairs), []
        for p, b in zip(new, ids):
            self.number[p] = len(self.pairs)
            self.chars += len(p)
            facts.append(self._align(p, fast(p) if PLAIN.fullmatch(p) else self.bpe.ids(p).tolist(), b))
        while first + len(new) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        if new:
            self.facts[first:first + len(new)] = facts
        return [[self.number[p] for p in own] for own in parts]

    def _align(self, chunk: str, a: list[int], b: list[int]) -> tuple[int, int, int, int, int]:
        raw = chunk.encode("utf-8")
        if (b"".join([self.a_bytes[i] for i in a]) != raw) or (b"".join([self.b_bytes[i] for i in b]) != raw):
            self.text.append(b"")
            self.pairs.append(np.zeros(0, np.int64))
            return 0, 0, 0, 0, 1
        sizes_a, sizes_b, digits = self.a_sizes, self.b_sizes, self.digits
        links, groups, i, j, last = [], [], 0, 0, len(a) - 1
        x, y = a[0], b[0]
        a_end, b_end, a_text, b_text = sizes_a[x], sizes_b[y], digits[x], digits[y]
        while True:
            links.append(x << 32 | y)
            if a_end == b_end:
                groups.append(f"{a_text}|{b_text}")
                if i == last:
                    break
                i, j = i + 1, j + 1
                x, y = a[i], b[j]
                a_end, b_end, a_text, b_text = a_end + sizes_a[x], b_end + sizes_b[y], digits[x], digits[y]
            elif a_end < b_end:
                i += 1
                x = a[i]
                a_end += sizes_a[x]
                a_text += "," + digits[x]
            else:
                j += 1
                y = b[j]
                b_end += sizes_b[y]
                b_text += "," + digits[y]
        self.text.append(";".join(groups).encode())
        self.pairs.append(np.array(links, np.int64))
        return len(a), len(b), len(groups), len(links), 0


_LOADED: dict[int, Aligner] = {}


def _loaded(vocabulary: str, model: bytes) -> Aligner:
    key = hash((vocabulary, model))
    if key not in _LOADED:
        _LOADED[key] = Aligner(vocabulary, model)
    return _LOADED[key]


def containers(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of one compressed bitmap for each run of ``docs`` (16-bit
    numbers, ascending within a run): a list of the numbers, or BLOCK_DOCS bits
    from LISTED numbers on; the length tells which."""
    sizes = np.diff(np.append(starts, len(docs)))
    full = sizes >= LISTED
    offsets = np.concatenate([[0], np.cumsum(np.where(full, BLOCK_DOCS // 8, 2 * sizes))]).astype(np.int32)
    out = np.zeros(offsets[-1], np.uint8)
    listed = np.repeat(~full, sizes)
    halves = docs[listed].astype("<u2").view(np.uint8)
    place = np.repeat(offsets[:-1][~full] - 2 * (np.cumsum(sizes[~full]) - sizes[~full]), 2 * sizes[~full])
    out[place + np.arange(len(halves))] = halves
    for k in np.flatnonzero(full):
        bits = np.zeros(BLOCK_DOCS, np.uint8)
        bits[docs[starts[k]:starts[k] + sizes[k]]] = 1
        out[offsets[k]:offsets[k + 1]] = np.packbits(bits)
    return out, offsets


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)),
                                                                 pa.py_buffer(values)])


#: Documents (a null) and pairs (doc_id null) of one pass over the texts.
def _schema(id_field: T.StructField) -> T.StructType:
    long, number = T.LongType(), T.IntegerType()
    fields = [("block", long), ("local", number), ("doc_id", id_field.dataType), ("n_a", long), ("n_b", long),
              ("n_groups", long), ("n_links", long), ("groups_sha256", T.StringType()), ("a", number), ("b", number),
              ("n_docs", number), ("planes", T.ArrayType(T.BinaryType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def posting_rows(aligner: Aligner, chunk_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, documents, planes) of a block whose documents' chunks are given,
    by pair; nothing for documents without chunks."""
    lengths = np.array([len(c) for c in chunk_ids], np.int64)
    local = np.repeat(np.arange(len(chunk_ids)), lengths)
    joined = np.concatenate(chunk_ids) if len(chunk_ids) else np.zeros(0, np.int64)
    both, times = np.unique(joined << 12 | local, return_counts=True)
    chunk, doc = both >> 12, both & (BLOCK_DOCS - 1)
    used, number = np.unique(chunk, return_inverse=True)
    pairs = [aligner.pairs[k] for k in used]
    sizes = np.array([len(p) for p in pairs], np.int64)
    flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    names, index = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    many = sizes[number]
    at = np.repeat(starts[number] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    key = index[at] << 12 | np.repeat(doc, many)
    weight = np.repeat(times, many)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    links = np.add.reduceat(weight, first) if len(key) else weight
    key = key[first]
    pair, doc = key >> 12, key & (BLOCK_DOCS - 1)
    n_docs = np.bincount(pair, minlength=len(names))
    # a container for each (pair, plane) up to the pair's highest plane
    top = np.zeros(len(names), np.int64)
    np.maximum.at(top, pair, np.frexp(links)[1])
    base = np.cumsum(top) - top
    slots, members = [], []
    for k in range(int(top.max(initial=0))):
        has = (links >> k) & 1 == 1
        slots.append(base[pair[has]] + k)
        members.append(doc[has])
    slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
    member = np.concatenate(members) if members else np.zeros(0, np.int64)
    order = np.lexsort((member, slot))
    slot, member = slot[order], member[order]
    values, offsets = containers(member, np.searchsorted(slot, np.arange(int(top.sum()))))
    planes = pa.ListArray.from_arrays(pa.array(np.append(base, top.sum()).astype(np.int32)), _binary(values, offsets))
    return names, n_docs, planes


def encode_blocks(docs: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """Rows (doc_id, text) as document rows and pair rows (see ``_schema``)."""
    spark = docs.sparkSession
    with open(pieces, "rb") as f:
        shared = spark.sparkContext.broadcast((vocabulary_text(vocabulary), f.read()))
    schema = _schema(docs.schema["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _loaded(*shared.value)
        own = TaskContext.get().partitionId() << 32
        names = schema.names

        def nulls(n: int, kind: pa.DataType) -> pa.Array:
            return pa.nulls(n, kind)

        def rows(block: int, ids: list, chunk_ids: list[np.ndarray], facts: list[tuple]) -> Iterator[pa.RecordBatch]:
            n = len(facts)
            numbers = list(zip(*[f[:4] for f in facts]))
            yield pa.RecordBatch.from_arrays([
                pa.array([own + block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.concat_arrays(ids),
                *[pa.array(c, pa.int64()) for c in numbers], pa.array([f[4] for f in facts], pa.string()),
                *[nulls(n, pa.int32())] * 3, nulls(n, pa.list_(pa.binary()))], names=names)
            pair, n_docs, planes = posting_rows(aligner, chunk_ids)
            for at in range(0, len(pair), 20_000):
                p, m = pair[at:at + 20_000], len(pair[at:at + 20_000])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, own + block)), nulls(m, pa.int32()), nulls(m, ids[0].type),
                    *[nulls(m, pa.int64())] * 4, nulls(m, pa.string()), pa.array((p >> 32).astype(np.int32)),
                    pa.array((p & 0xFFFFFFFF).astype(np.int32)), pa.array(n_docs[at:at + m].astype(np.int32)),
                    planes.slice(at, m)], names=names)

        block, size, ids, chunk_ids, facts = 0, 0, [], [], []
        for b in (b.slice(at, TOGETHER) for whole in batches for at in range(0, whole.num_rows, TOGETHER)
                  for b in [whole]):
            for found in aligner.chunks([x.as_py() or "" for x in b.column(1)]):
                numbers = np.array(found, np.int64)
                sums = aligner.facts[numbers].sum(0).tolist()
                if found and not sums[4]:
                    facts.append((*sums[:4], hashlib.sha256(b";".join([aligner.text[c] for c in found])).hexdigest()))
                else:
                    numbers = numbers[:0]
                    facts.append((0, 0, 0, 0, ""))
                chunk_ids.append(numbers)
                size += len(numbers)
            ids.append(b.column(0))
            if len(facts) + TOGETHER > BLOCK_DOCS or size > BLOCK_CHUNKS:
                yield from rows(block, ids, chunk_ids, facts)
                block, size, ids, chunk_ids, facts = block + 1, 0, [], [], []
                if len(aligner.number) > CACHE_CHUNKS or aligner.chars > CACHE_CHARS:
                    aligner.forget()
        if facts:
            yield from rows(block, ids, chunk_ids, facts)

    return docs.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each pair is linked, and
    whether no other pair of a is linked in more."""
    counts = rows.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n_docs").cast("long").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # one row an id of the vocabulary
    return counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def posting_scores(postings: DataFrame) -> DataFrame:
    """(block, local, n_best, count_sum) from rows (block, planes, count, best),
    the rows of a block in one partition: a block has at most BLOCK_DOCS documents."""
    schema = "block long, local int, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            block, count, best = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            planes = b.column(1)
            first = planes.offsets.to_numpy()
            plane_rows = planes.flatten()
            owner = np.repeat(np.arange(b.num_rows), np.diff(first))
            plane = np.arange(len(owner)) - np.repeat(first[:-1] - first[0], np.diff(first))
            ends = np.frombuffer(plane_rows.buffers()[1], np.int32)[plane_rows.offset:plane_rows.offset + len(plane_rows) + 1]
            values = np.frombuffer(plane_rows.buffers()[2] or b"", np.uint8)
            sizes = np.diff(ends)
            full = sizes == BLOCK_DOCS // 8
            places, numbers = [], []  # one for each (container, document)
            listed = np.flatnonzero(~full & (sizes > 0))
            if len(listed):
                many = sizes[listed]
                at = np.repeat(ends[:-1][listed] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                numbers.append(values[at].view("<u2").astype(np.int64))
                places.append(np.repeat(listed, many // 2))
            for k in np.flatnonzero(full):
                bits = np.flatnonzero(np.unpackbits(values[ends[k]:ends[k + 1]]))
                numbers.append(bits)
                places.append(np.full(len(bits), k))
            if not places:
                continue
            place, doc = np.concatenate(places), np.concatenate(numbers)
            row = owner[place]
            times = np.left_shift(1, plane[place])
            names, inverse = np.unique(block, return_inverse=True)
            sums = np.zeros((2, len(names) * BLOCK_DOCS), np.int64)
            cell = inverse[row] * BLOCK_DOCS + doc
            np.add.at(sums[0], cell, times * best[row])
            np.add.at(sums[1], cell, times * count[row])
            for k, name in enumerate(names.tolist()):
                part = sums[:, k * BLOCK_DOCS:(k + 1) * BLOCK_DOCS]
                if name in totals:
                    totals[name] += part
                else:
                    totals[name] = part.copy()
        for name, sums in totals.items():
            used = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), name)), pa.array(used.astype(np.int32)),
                                              pa.array(sums[0, used]), pa.array(sums[1, used])],
                                             names=["block", "local", "n_best", "count_sum"])

    return postings.select("block", "planes", "count", "best").mapInArrow(run, schema)


def align_documents(docs: DataFrame, vocabulary: str, pieces: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum long, groups_sha256 string.

    Texts that are null or empty, or whose tokens of either side do not give
    back a space and the text, have zeros and ''. Repeated rows and null ids are
    documents of their own; an empty table gives no rows; other columns are not
    read. The tokens are written to shared storage once, so a lost executor
    costs a re-read and a document's number never changes."""
    rows = stored(encode_blocks(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")),
                                vocabulary, pieces), "alignment")
    each = rows.where("a IS NULL").select("block", "local", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    postings = rows.where("a IS NOT NULL").select("block", "a", "b", "planes").join(pair_counts(rows), ["a", "b"])
    scores = posting_scores(postings.select("block", "planes", "count", "best").repartition("block"))
    none = F.lit(0).cast("long")
    return each.join(scores, ["block", "local"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
