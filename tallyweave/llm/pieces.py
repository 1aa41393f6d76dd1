"""SentencePiece ids by a streaming Viterbi search, and back.

The search keeps, for the last positions, as many as the longest piece has
characters, how the best path to each of them ends. Whenever all of these paths
share a boundary, no later text can change what stands before it, and those ids
are given out; so memory doesn't grow with the text.

What the best path is, is the model's: for a unigram model that of the largest
sum of scores, for a BPE model the one that its merges give. Merges have no sum
to maximise, but their path to each position is the only one whose neighbouring
pieces are the merges' result for these two pieces alone, so one backpointer a
position is enough there too. Texts go through the model's own normaliser first;
characters outside the vocabulary are given by byte pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, texts, tidy

BLANK = "▁"
#: Stretches between sure boundaries that are kept in memory at most, in two halves, and their longest; pairs of pieces that are.
MEMORY, LONGEST, PAIRS = 600_000, 40, 1 << 19
# Fields of a model file (the trainer's part, the kind of model in it), the number of BPE models, and what an unknown character weighs less than the least piece.
_TRAINER, _KIND, _BPE, UNKNOWN_PENALTY = 2, 3, 2, 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields; those of a fixed size are passed over."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        elif kind == 2:
            size = number()
            at += size
            yield field, data[at - size : at]
        else:
            at += 8 if kind == 1 else 4


def is_bpe(model: bytes) -> bool:
    """Whether a serialised model is a BPE model."""
    trainers = [x for field, x in _fields(model) if field == _TRAINER]
    return any(field == _KIND and x == _BPE for t in trainers for field, x in _fields(t))


class Merges:
    """Which two pieces may stand side by side: those that the merges of a BPE model make of the two together.

    A merge joins the neighbours whose union is the piece of the best score, the
    leftmost of equal ones.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.parts: dict[str, tuple[str, str]] = {}  # the last merge of a piece
        self.sound: dict[str, bool] = {}  # whether the piece is what its own characters merge to
        often: dict[float, int] = {}
        for s in scores.values():
            often[s] = often.get(s, 0) + 1
        #: Pieces whose merges aren't in the order of their scores, or share one: those are told by merging.
        self.odd: set[str] = set()
        for name in scores:
            out, last = self._merged(name)
            self.sound[name] = out == [name]
            if last is not None and self.sound[name]:
                self.parts[name] = last
                if often[scores[name]] > 1 or any(len(x) > 1 and scores[x] <= scores[name] for x in last):
                    self.odd.add(name)
        for name in sorted(scores, key=len):
            if any(x in self.odd for x in self.parts.get(name, ())):
                self.odd.add(name)

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that the characters of text merge to, and the parts of the last merge."""
        out, scores, last = list(text), self.scores, None
        while len(out) > 1:
            best, at = -inf, -1
            for i in range(len(out) - 1):
                s = scores.get(out[i] + out[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            last = (out[at], out[at + 1])
            out[at : at + 2] = ["".join(last)]
        return out, last

    def side_by_side(self, a: str, b: str) -> bool:
        if a in self.odd or b in self.odd:
            return self._merged(a + b)[0] == [a, b]
        # Backwards in time: the merges of a's right edge and b's left edge are undone, the later first. Between two of
        # them the edges were neighbours; if their union is a piece that comes before what was undone, they were joined.
        scores, parts, bound, equal = self.scores, self.parts, -inf, True
        while True:
            joined = scores.get(a + b)
            if joined is not None and (joined > bound or (equal and joined == bound)):
                return False
            of_a, of_b = parts.get(a), parts.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and scores[a] < scores[b]):
                bound, equal, a = scores[a], False, of_a[1]
            else:
                bound, equal, b = scores[b], True, of_b[0]


#: How the best path to a position ends: its weight, where its last piece starts, that piece's ids, its number (-1: none) .
_Step = tuple[float, int, tuple[int, ...], int]


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {names[i]: model.get_score(i) for i in normal}
        self.merges = Merges(scores) if is_bpe(model.serialized_model_proto()) else None
        self.ids = {names[i]: i for i in normal}
        self.longest = max(map(len, self.ids), default=1)
        self.tree: dict = {}  # by character; "" gives the ids, weight and number of the piece that ends there
        for name, i in self.ids.items():
            if self.merges is None or self.merges.sound[name]:
                node = self.tree
                for c in name:
                    node = node.setdefault(c, {})
                node[""] = ((i,), scores[name], i)
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown, self.unknown_weight = model.unk_id(), min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.inverse = [b""] * n
        for i in normal:
            self.inverse[i] = names[i].replace(BLANK, " ").encode()
        for value, i in self.bytes.items():
            self.inverse[i] = bytes([value])
        self.inverse[self.unknown] = self.inverse[self.unknown] or " ⁇ ".encode()
        self.prefixed = model.normalize("x").startswith(BLANK)
        #: No piece holds a blank after another character, so all paths meet before each run of blanks.
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """ids of a normalised text that comes in chunks, each as soon as it is sure."""
        longest, more, rest, taken, ended = self.longest, iter(chunks), "", 0, False
        search = self._by_weight if self.merges is None else self._by_merges
        # Positions count from the last sure boundary.
        window, at, check = "", 0, 2 * longest
        best: list[_Step | None] = [(0.0, 0, (), -1)]
        while True:
            while not ended and len(window) - at < 2 * longest:
                if taken == len(rest):
                    rest, taken = next(more, None), 0
                    if rest is None:
                        ended = True
                        break
                cut = rest[taken : taken + 2 * longest]
                taken += len(cut)
                window += cut
                best += [None] * len(cut)
            # Up to here every piece that begins at a position is in the window.
            stop = min(check, len(window) if ended else len(window) - longest + 1)
            search(window, at, stop, best)
            at = stop
            if at == len(window):
                break
            if at >= check:
                window, best, at, sure = self._commit(window, best, at)
                yield from sure
                check = at + longest
        yield from self._path(best, len(window))

    def _by_weight(self, window: str, begin: int, stop: int, best: list[_Step | None]) -> None:
        """Try every piece that begins from begin to stop: the heavier path to its end stays."""
        n = len(window)
        for start in range(begin, stop):
            if best[start] is None:
                continue
            so_far, node = best[start][0], self.tree
            for end in range(start, n):
                node = node.get(window[end])
                if node is None:
                    break
                hit = node.get("")
                if hit is not None and (best[end + 1] is None or so_far + hit[1] > best[end + 1][0]):
                    best[end + 1] = (so_far + hit[1], start, hit[0], hit[2])
            if window[start] not in self.ids:
                weight = so_far + self.unknown_weight
                if best[start + 1] is None or weight > best[start + 1][0]:
                    best[start + 1] = (weight, start, self._outside(window[start]), -1)

    def _by_merges(self, window: str, begin: int, stop: int, best: list[_Step | None]) -> None:
        """Try every piece that begins from begin to stop: at each end only one fits the piece before it."""
        tree, names, pairs, n = self.tree, self.names, self.pairs, len(window)
        for start in range(begin, stop):
            here = best[start]
            if here is None:
                continue
            last, node = here[3], tree
            base = last << 32
            for end in range(start, n):
                node = node.get(window[end])
                if node is None:
                    break
                if best[end + 1] is None and "" in node:
                    own = node[""][2]
                    if last >= 0:
                        fits = pairs.get(base | own)
                        if fits is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            fits = pairs[base | own] = self.merges.side_by_side(names[last], names[own])
                        if not fits:
                            continue
                    best[end + 1] = (0.0, start, node[""][0], own)
            if best[start + 1] is None and window[start] not in self.ids:
                best[start + 1] = (0.0, start, self._outside(window[start]), -1)

    def _outside(self, c: str) -> tuple[int, ...]:
        """ids of a character that isn't in the vocabulary."""
        return tuple(self.bytes[b] for b in c.encode("utf-8", "replace")) if self.bytes else (self.unknown,)

    @staticmethod
    def _path(best: list[_Step | None], end: int) -> list[int]:
        parts = []
        while end:
            parts.append(best[end][2])
            end = best[end][1]
        return [i for ids in reversed(parts) for i in ids]

    def _commit(self, window: str, best: list[_Step | None], at: int) -> tuple[str, list[_Step | None], int, list[int]]:
        """Give out what the best paths to all positions that later ones can come from begin with."""
        ends = []
        for end in range(at, min(len(best), at + self.longest)):
            if best[end] is None:
                continue
            bounds = {end}
            while end:
                end = best[end][1]
                bounds.add(end)
            ends.append(bounds)
        meet = max(set.intersection(*ends))
        if not meet:
            # No boundary is sure yet: go on with a longer window, and try again after as many characters.
            return window, best, at, []
        sure, (base, _, _, last) = self._path(best, meet), best[meet]
        after = [x and (x[0] - base, x[1] - meet, x[2], x[3]) for x in best[meet + 1 :]]
        return window[meet:], [(0.0, 0, (), last), *after], at - meet, sure

    def _between(self, stretch: str) -> bytes:
        """ids of a stretch between two boundaries that are sure in any text."""
        got = self.old.get(stretch)
        if got is None:
            got = array("H" if len(self.inverse) <= 1 << 16 else "I", self.stream((stretch,))).tobytes()
        if len(stretch) <= LONGEST:
            if 2 * len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[stretch] = got
        return got

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("u2" if len(self.inverse) <= 1 << 16 else "u4")

    def encode(self, text: str) -> np.ndarray:
        """The model's ids of a text."""
        text = self.model.normalize(text)
        if not self.by_word or not self.bytes:
            ids = np.fromiter(self.stream((text,)), self.dtype)
            # Unknown characters in a row are one id.
            return ids if self.bytes or not len(ids) else ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]
        if BLANK * 2 in text or text[:1] != BLANK or text[-1:] == BLANK:
            stretches = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", text)
        else:
            stretches = [BLANK + w for w in text[1:].split(BLANK)]
        got = list(map(self.young.get, stretches))
        if None in got:
            got = [self._between(w) if x is None else x for x, w in zip(got, stretches)]
        return np.frombuffer(b"".join(got), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.inverse.__getitem__, ids.tolist()))
        return (raw[1:] if self.prefixed and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32, decoded_sha256 and round_trip of each whole text.

    The ids are those that the sentencepiece library gives for the model.
    round_trip is false only for texts that the model's normaliser changes, or
    that hold the blank sign itself. Null and empty texts have no ids; rows with
    equal or null doc_id are each encoded; very long texts go through the same
    window as short ones; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for b in batches:
            items = b.column(1).to_pylist()
            ids = [own.encode(x) for x in items]
            back = [own.decode(x) for x in ids]
            yield batch(
                {
                    "doc_id": (b.column(0), pa.int64()),
                    "n_chars": ([len(x) for x in items], pa.int64()),
                    "n_ids": ([len(x) for x in ids], pa.int64()),
                    "ids_crc32": ([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "decoded_sha256": ([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    "round_trip": ([x == y for x, y in zip(items, back)], pa.bool_()),
                }
            )

    return texts(docs).mapInArrow(tidy(run), "doc_id long, n_chars long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
