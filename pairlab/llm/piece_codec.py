"""SentencePiece encoding and decoding that keeps source offsets.

A text is normalised by longest-prefix matches in the model's compiled
character map (a double-array trie over UTF-8 bytes, followed by the
replacement strings); every normalised byte records the source byte it comes
from. Pairs of symbols are then merged by piece score. Every piece projects to
the source bytes between the origins of its first byte and of the byte after
its last. The rules are those published for the model format; the library of
that name is only used by the tests."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
REPLACEMENT = "�".encode()
#: Chunks whose ids a Python worker remembers, and their longest length.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 40
#: Chunks by letters, if no piece has a Latin letter before anything else, and by
#: lines, if none has a line feed; else by space signs alone.
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
BY_LETTERS = re.compile(rf"\n|{SPACE}*{LETTER}+|{SPACE}*[^A-Za-zÀ-ÖØ-öø-ɏ{SPACE}\n]+{LETTER}*|{SPACE}+")
BY_SPACES = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(buffer: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buffer):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, buffer[at:at + size]
        at += size


class CharacterMap:
    """The compiled character map. A trie unit packs an offset to the children
    (bits 10 up, times 256 if bit 9 is set), a leaf flag (bit 8) and a label
    (low byte, with bit 31 never set for a labelled unit); a leaf child holds
    the replacement's place in its low 31 bits."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4:4 + size])
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at ``at`` and their replacement, or None."""
        if not self.units:
            return None
        found, node = None, self._child(0)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, place = found
        return size, self.strings[place:self.strings.index(b"\0", place)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def _child(self, node: int) -> int:
        return node ^ self._offset(self.units[node])


@dataclass
class Normalised:
    """Normalised text and, for each of its bytes and one past the end, the
    source byte offset it comes from."""

    text: str
    origin: object  # indexable


@dataclass
class Codec:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    charmap: CharacterMap
    dummy_prefix: bool = True
    squeeze: bool = True  # drop leading, trailing and repeated spaces
    escape: bool = True
    unknown: int = 0
    merges: dict[str, int] = field(default_factory=dict)
    ranks: dict[str, float] = field(default_factory=dict)
    bytes_of: dict[int, int] = field(default_factory=dict)
    byte_id: dict[int, int] = field(default_factory=dict)
    splits: re.Pattern | None = None
    cache: dict[str, tuple[str, bytes]] = field(default_factory=dict)
    surface: list[str | None] = field(default_factory=list)

    @classmethod
    def parse(cls, model: bytes) -> Codec:
        pieces, scores, types, spec, trainer = [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != BPE:
            raise ValueError("only models of type BPE are encoded")
        if trainer.get(24, 0) or USER_DEFINED in types or UNUSED in types:
            raise ValueError("suffix spaces, user-defined and unused pieces are not supported")
        codec = cls(pieces, scores, types, CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)),
                    bool(spec.get(5, 1)), types.index(UNKNOWN))
        for i, (piece, kind) in enumerate(zip(pieces, types, strict=True)):
            if kind == NORMAL:
                codec.merges[piece] = i
            elif kind == BYTE:
                codec.byte_id[int(piece[3:5], 16)] = i
                codec.bytes_of[i] = int(piece[3:5], 16)
        codec.ranks = {piece: scores[i] for piece, i in codec.merges.items()}
        codec.surface = [None if kind == BYTE else "" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else
                         piece.replace(SPACE, " ") for piece, kind in zip(pieces, types, strict=True)]
        # no merge crosses the place before a space sign, if it only opens pieces
        if not any(SPACE in p.lstrip(SPACE) for p in codec.merges):
            crossing = re.compile(rf"\n|{LETTER}(?!{LETTER})(?=.)", re.DOTALL)
            codec.splits = BY_SPACES if any(crossing.search(p) for p in codec.merges) else BY_LETTERS
        return codec

    # -- normalisation

    def normalise(self, text: str) -> Normalised:
        if not self.charmap.units and not self.squeeze:
            return self._plain(text)
        data = text.encode()
        out, origin = bytearray(), []
        space = SPACE.encode() if self.escape else b" "

        def put(piece: bytes, source: int) -> None:
            for byte in piece:
                new = space if byte == 32 else bytes((byte,))
                out.extend(new)
                origin.extend([source] * len(new))

        steps, at = [], 0
        while at < len(data):
            match = self.charmap.longest(data, at)
            if match is None:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                match = size, data[at:at + size]
            steps.append((match[1], at))
            at += match[0]
        end = len(data)
        if self.squeeze:
            while steps and steps[0][0] == b" ":
                steps.pop(0)
        if steps or data:
            begin = steps[0][1] if steps else end
            if self.dummy_prefix and steps:
                put(b" ", begin)
        after_space = self.squeeze
        for piece, source in steps:
            if self.squeeze and after_space:
                piece = piece.lstrip(b" ")
            put(piece, source)
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space):]
                end = origin[-len(space)]
                del origin[-len(space):]
        return Normalised(out.decode(), [*origin, end])

    def _plain(self, text: str) -> Normalised:
        """The empty map: only spaces change their sign."""
        if not text:
            return Normalised("", [0])
        out = (" " if self.dummy_prefix else "") + text
        return Normalised(out.replace(" ", SPACE) if self.escape else out, self._plain_origin(text))

    def _plain_origin(self, text: str) -> np.ndarray:
        """Origins under the empty map, from the lengths of the source characters."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ends = np.cumsum(sizes)
        own = np.where(points == 32, 3, sizes) if self.escape else sizes
        prefix = (3 if self.escape else 1) if self.dummy_prefix else 0
        return np.concatenate([np.zeros(prefix, np.int64), np.repeat(ends - sizes, own), ends[-1:]])

    # -- merging

    def _chunks(self, text: str) -> list[str]:
        """Parts that no merge crosses: a run of space signs and what follows."""
        if self.splits is None:
            return [text] if text else []
        return self.splits.findall(text)

    def _merge(self, chunk: str) -> list[str]:
        """Symbols of a chunk: the pair whose joint piece scores highest (the
        leftmost of equals) is merged until no pair is a piece."""
        if chunk in self.merges and len(chunk) == 1:
            return [chunk]
        symbols, ranks, none = list(chunk), self.ranks, float("-inf")
        if len(symbols) > 64:
            return self._merge_long(symbols)
        scores = [ranks.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = ranks.get(symbols[k - 1] + symbols[k], none)
            if k < len(scores):
                scores[k] = ranks.get(symbols[k] + symbols[k + 1], none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and links, for chunks of any length."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, k, a + b) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))
                if (s := ranks.get(a + b)) is not None]
        heapify(heap)
        while heap:
            _, k, joint = heappop(heap)
            right = after[k]
            if symbols[k] is None or right >= n or symbols[k] + symbols[right] != joint:
                continue
            symbols[k], symbols[right] = joint, None
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    pair = symbols[left] + symbols[after[left]]
                    if (s := ranks.get(pair)) is not None:
                        heappush(heap, (-s, left, pair))
        return [s for s in symbols if s is not None]

    def _symbol_ids(self, symbol: str) -> list[int]:
        own = self.merges.get(symbol)
        if own is not None:
            return [own]
        return [self.byte_id.get(b, self.unknown) for b in symbol.encode()] if self.byte_id else [self.unknown]

    def _new_chunk(self, chunk: str) -> tuple[str, bytes]:
        """Ids of a chunk, comma-joined, and for each id where its symbol begins
        and ends in the chunk's bytes (pairs of 32-bit numbers)."""
        ids, spans, at = [], array("i"), 0
        for symbol in self._merge(chunk):
            own, end = self._symbol_ids(symbol), at + len(symbol.encode())
            ids += own
            spans.extend((at, end) * len(own))
            at = end
        found = ",".join(map(str, ids)), spans.tobytes()
        if len(chunk) <= CACHE_CHARS and len(self.cache) < CACHE_ENTRIES:
            self.cache[chunk] = found
        return found

    def located(self, text: str) -> tuple[str, np.ndarray]:
        """All ids, comma-joined, and the source bytes (begin, end) of each. The
        bytes of a character without a piece of its own all span that character."""
        normal = self.normalise(text)
        chunks = self._chunks(normal.text)
        if not chunks:
            return "", np.zeros((0, 2), np.int32)
        parts = list(map(self.cache.get, chunks))
        if None in parts:
            new = self._new_chunk
            parts = [new(chunk) if part is None else part for chunk, part in zip(chunks, parts, strict=True)]
        places = np.frombuffer(b"".join([spans for _, spans in parts]), np.int32).reshape(-1, 2)
        counts = np.fromiter((len(spans) for _, spans in parts), np.int64, len(parts)) // 8
        sizes = places[np.cumsum(counts) - 1, 1].astype(np.int64)  # a chunk ends with its last symbol
        places = places + np.repeat(np.cumsum(sizes) - sizes, counts)[:, None]
        return ",".join([ids for ids, _ in parts]), np.asarray(normal.origin)[places].astype(np.int32)

    def encode(self, text: str) -> list[int]:
        ids, _ = self.located(text)
        return [int(i) for i in ids.split(",")] if ids else []

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece in source bytes."""
        ids, spans = self.located(text)
        return [(int(i), *span) for i, span in zip(ids.split(","), spans.tolist(), strict=True)] if ids else []

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, space signs as spaces, without the space that
        encoding puts first; runs of byte pieces as UTF-8, with U+FFFD for
        each byte that is not part of a character."""
        if not ids:
            return ""
        parts = list(map(self.surface.__getitem__, ids))
        if None in parts:  # byte pieces: each run of them is one byte string
            joined, k = [], 0
            while k < len(parts):
                if parts[k] is not None:
                    joined.append(parts[k])
                    k += 1
                    continue
                run = bytearray()
                while k < len(parts) and parts[k] is None:
                    run.append(self.bytes_of[ids[k]])
                    k += 1
                joined.append(bytes(run).decode("utf-8", "byte_replace"))
            parts = joined
        text = "".join(parts)
        opening = next((i for i in ids if self.types[i] != CONTROL), None)
        if opening is not None and self.types[opening] == NORMAL and text.startswith(" "):
            if self.squeeze:
                return text.lstrip(" ")
            return text[1:] if self.dummy_prefix else text
        return text


def _byte_replace(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


import codecs  # noqa: E402

codecs.register_error("byte_replace", _byte_replace)


def model_bytes(path: str) -> bytes:
    """The model file (0.5 MB, a fixed size), read by the driver and broadcast."""
    with open(path, "rb") as f:
        return f.read()


_LOADED: dict[int, Codec] = {}


def loaded(model: bytes) -> Codec:
    """One codec for each model in a Python worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Codec.parse(model)
    return _LOADED[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces) for every row: pieces is an array of (id, begin, end),
    source bytes. Null texts count as empty and have no pieces; repeated rows
    and null ids give a row each; an empty table none; other columns are not
    read. One pass, no shuffle; a row's pieces are held at a time."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    piece = T.StructType([T.StructField(c, T.IntegerType()) for c in ("id", "begin", "end")])
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType),
                           T.StructField("pieces", T.ArrayType(piece))])
    arrow = pa.list_(pa.struct([(c, pa.int32()) for c in ("id", "begin", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [[dict(zip(("id", "begin", "end"), p, strict=True)) for p in codec.encode_spans(x.as_py() or "")]
                         for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, arrow)], names=["doc_id", "pieces"])

    return rows.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) for every
    row, from the pieces that encode_documents gives. spans_sha256 is that of
    each piece's begin and end as little-endian 32-bit numbers."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model.value)
        for b in batches:
            counts, ids_sha, decoded_sha, spans_sha = [], [], [], []
            for x in b.column(1):
                ids, spans = codec.located(x.as_py() or "")
                numbers = list(map(int, ids.split(","))) if ids else []
                counts.append(len(numbers))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(numbers).encode()).hexdigest())
                spans_sha.append(hashlib.sha256(spans.astype("<i4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha),
                                              pa.array(decoded_sha), pa.array(spans_sha)], names=schema.names)

    return rows.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``piece_digests``."""
    return piece_digests(docs, model_path, id_col, text_col).drop("spans_sha256")
