"""Packing token sequences into windows of a fixed capacity.

Best-fit decreasing, one independent packing for each scan partition: no
shuffle, no row waits for another partition. Within a task only the last,
partial window of each document is kept (three numbers a document, plus its
ids if they are asked for); full windows leave at once. A scan partition holds
thousands of documents, so the windows left open at its end are a small share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairlab.llm.byte_bpe import loaded, vocabulary_text

CAPACITY = 1024
#: The id that closes every document.
END_ID = 0
#: Windows are numbered within a partition; partitions are this far apart.
PARTITION_STRIDE = 1 << 36


class OpenWindows:
    """Open windows in a segment tree over remaining capacity 0..capacity.
    A node counts the windows below it; the tightest window that still takes
    ``need`` is the first non-empty leaf at or after ``need``."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, leaf: int, by: int) -> None:
        node = leaf + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, remaining: int) -> None:
        self.windows[remaining].append(window)
        self._change(remaining, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(window, remaining) with the least remaining >= need, taken out."""
        node = need + self.size
        if not self.count[node]:
            # climb until a right sibling has windows, then go down leftmost
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        remaining = node - self.size
        self._change(remaining, -1)
        return self.windows[remaining].pop(), remaining


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece (1 <= length <= capacity), and the
    number of windows. Longest first, ties in the order given."""
    window, offset = [0] * len(lengths), [0] * len(lengths)
    tree, used = OpenWindows(capacity), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[k]
        found = tree.take_tightest(need)
        if found is None:
            found, used = (used, capacity), used + 1
        window[k], remaining = found
        offset[k] = capacity - remaining
        if remaining > need:
            tree.put(window[k], remaining - need)
    return window, offset, used


def _schema(id_type: T.DataType, with_ids: bool) -> T.StructType:
    fields = [T.StructField("doc_id", id_type)]
    fields += [T.StructField(c, T.LongType()) for c in
               ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return T.StructType(fields)


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of every document (null text counts as empty; every document
    ends with ``end_id``), packed into windows of ``capacity`` tokens.

    One row for each piece: doc_id, start (ids of the document before it),
    length, ids_crc32, doc_tokens, sequence_id, offset (its place in the
    sequence; the pieces of a sequence lie gapless from 0), and with
    ``with_ids`` the ids. An overlong document is first cut into full windows;
    what remains is packed best-fit decreasing. Repeated rows and equal or
    null ids are packed as the separate rows they are; an empty table gives no
    rows; further columns of ``docs`` are not read."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = _schema(rows.schema["doc_id"].dataType, with_ids)
    end = np.uint32(end_id).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value)
        first = TaskContext.get().partitionId() * PARTITION_STRIDE
        full, step = 0, 4 * capacity
        rest: list[tuple] = []  # (doc_id, start, length, crc32, doc_tokens, ids)
        id_arrow = None

        def batch(columns: list, ids: list[bytes]) -> pa.RecordBatch:
            arrays = [pa.array(columns[0], id_arrow), *(pa.array(c, pa.int64()) for c in columns[1:])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for b in batches:
            id_arrow = b.schema.field(0).type
            out, out_ids = [], []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                raw = bpe.encode(text.as_py() or "") + end
                doc_id, n = doc_id.as_py(), len(raw) // 4
                cut = n - n % capacity
                for start in range(0, cut, capacity):
                    ids = raw[4 * start:4 * start + step]
                    out.append((doc_id, start, capacity, zlib.crc32(ids), n, first + full, 0))
                    out_ids += [ids] * with_ids
                    full += 1
                if n > cut:
                    ids = raw[4 * cut:]
                    rest.append((doc_id, cut, n - cut, zlib.crc32(ids), n, ids if with_ids else None))
            if out:
                yield batch(list(zip(*out, strict=True)), out_ids)
        window, offset, _ = best_fit_decreasing([x[2] for x in rest], capacity)
        for at in range(0, len(rest), 20_000):
            part = rest[at:at + 20_000]
            *columns, ids = zip(*part, strict=True)
            yield batch([*columns, [first + full + w for w in window[at:at + len(part)]],
                         offset[at:at + len(part)]], ids)

    return rows.mapInArrow(pack, schema)
