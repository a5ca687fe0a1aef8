"""Byte-level BPE ids from a tokenizers vocabulary file.

The ids are those of the ``tokenizers`` library. Texts in common letters and
signs go through the rank form of the same vocabulary, which gives the same
ids about five times as fast (tests compare both); what holds other
characters, whose Unicode classes could differ between the two libraries, and
texts that name a special token go to ``tokenizers`` itself."""

from __future__ import annotations

import json
from array import array
from itertools import groupby

import regex
import tiktoken
from tokenizers import Tokenizer

#: Splits a text before merging (published pattern of this vocabulary family).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin letters and the signs that go with them.
PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*+")
#: White space before a space: no place to cut a text.
SPACE_AGAIN = regex.compile(r"\s ")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        letters = _byte_letters()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()
                 if piece not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_str(vocabulary)

    def _slow(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _fast(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._slow(text)
        if PLAIN.fullmatch(text):
            return self._fast(text)
        if SPACE_AGAIN.search(text):
            return self._slow(text)
        # no token crosses a single space that follows a visible character
        head, *rest = text.split(" ")
        runs = groupby([head, *(" " + x for x in rest)], lambda x: PLAIN.fullmatch(x) is not None)
        return b"".join((self._fast if plain else self._slow)("".join(run)) for plain, run in runs)


_LOADED: dict[int, ByteBpe] = {}


def loaded(vocabulary: str) -> ByteBpe:
    """One encoder for each vocabulary in a Python worker."""
    key = hash(vocabulary)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(vocabulary)
    return _LOADED[key]


def vocabulary_text(path: str) -> str:
    """The vocabulary file (1.5 MB, a fixed size) as text, read by the driver
    once and broadcast, so that executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()
