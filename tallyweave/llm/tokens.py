"""Token ids of a byte-level BPE by the tokenizers library, with a bounded memory of parts seen before."""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: The pre-tokenizer's pattern of this kind of vocabulary (a fixed value of its public definition).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts kept in memory at most (in two halves, old and young), and the longest part that is kept.
MEMORY, LONGEST = 700_000, 40
#: A space beside other white space: the text can't be cut at its spaces.
_BLANKS = re.compile(r" \s|\s ")


class Memory:
    """A bounded map of two halves: what is used stays in the young one, which becomes the old one when it is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> bytes:
        if len(key) <= LONGEST:
            if 2 * len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value


class Encoder:
    """ids(text): what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives, as little-endian bytes.

    Every part that the pre-tokenizer would give is encoded by the library's own
    model, once while it stays in memory. A text is cut at single spaces first,
    where the pre-tokenizer always starts a new part. Texts that hold a special
    token's string, and vocabularies of another kind, go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.plain = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), spec.get("normalizer"), model.get("type")) == ("ByteLevel", False, True, None, "BPE")
        self.parts = regex.compile(SPLIT).findall
        # The bytes' printable stand-ins in this kind of vocabulary: visible Latin-1 stays, others follow from 256.
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = (b for b in range(256) if b not in set(seen))
        self.stand_in = {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}
        self.spaced = Memory()  # of what stands between two spaces, with the first one
        self.bare = Memory()  # of the pre-tokenizer's other parts
        self.stops = {c: self._encode(c) for c in ",.;:!?"} if self.plain else {}

    def _encode(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            text = part
        elif part[1:].isascii() and part[1:].isalpha() and part[0] == " ":
            text = "\u0120" + part[1:]
        else:
            text = part.encode().decode("latin-1").translate(self.stand_in)
        got = array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(text)])
        if sys.byteorder == "big":
            got.byteswap()
        return got.tobytes()

    def _part(self, part: str) -> bytes:
        """ids of one part of the pre-tokenizer."""
        if len(part) > 1 and part[0] == " " and part[1:].isalpha():
            return self._chunk(part[1:])
        got = self.bare.get(part)
        return self.bare.put(part, self._encode(part)) if got is None else got

    def _chunk(self, chunk: str) -> bytes:
        """ids of a space and what follows up to the next one."""
        got = self.spaced.get(chunk)
        if got is None:
            stop = self.stops.get(chunk[-1])
            if chunk.isalpha():
                got = self._encode(" " + chunk)
            elif stop and chunk[:-1].isalpha():
                got = self._chunk(chunk[:-1]) + stop
            else:
                got = b"".join(map(self._part, self.parts(" " + chunk)))
            self.spaced.put(chunk, got)
        return got

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if _BLANKS.search(text):
            return b"".join(map(self._part, self.parts(text)))
        first, *rest = text.split(" ")
        out = [*map(self._part, self.parts(first))]
        if rest and not rest[-1]:  # a space ends the text
            rest.pop()
            return b"".join([*out, *map(self._chunk, rest), self._part(" ")])
        got = list(map(self.spaced.young.get, rest))
        if None in got:
            got = [self._chunk(c) if x is None else x for x, c in zip(got, rest)]
        return b"".join(out + got)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
