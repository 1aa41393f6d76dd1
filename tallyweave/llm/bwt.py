"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A text is read as strings over an alphabet of blocks: the strings of its
residues, each going through the text in steps of one block, so that every byte
position starts one suffix. A shard's suffixes are sorted once and kept as its
transform: the block before each suffix, in the suffixes' order, over the
shard's own alphabet. Merging sorts no suffix again. An interleave says from
which shard each place of the merged order comes; each round deals it out by
the blocks before, in a counting sort, and so orders all suffixes by one block
more. Where neighbours part in a round, their common prefix has as many blocks
as there were rounds before it; intervals of longer common prefixes repeat.
"""

from __future__ import annotations

import numpy as np

from .common import ranges

#: Bytes of a block.
BLOCK = 50
#: Bytes of a shard: as many suffixes at most, so that its symbols have 16 bits.
SHARD_BYTES = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(1971).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.uint64((1 << 16) - 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any stretch of some bytes, from sums of powers modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_powers[0]) < n:
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                p = np.full(n + (n >> 2), base, np.uint64)
                p[0] = 1
                _powers[i] = np.multiply.accumulate(p)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[data] * _powers[0][: n - 1], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """The hash of each stretch of size bytes."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * _powers[1][:n])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * _powers[1][begin] + (end - begin).astype(np.uint64))


def _dealt(symbols: np.ndarray, most: int) -> np.ndarray:
    """The stable order of symbols up to most: counting sorts by 16 bits at a time."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if most >> 16:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _blocks(data: np.ndarray) -> np.ndarray:
    """The block at each byte, not copied."""
    return np.ndarray((max(0, len(data) - BLOCK + 1),), f"V{BLOCK}", data.tobytes(), strides=(1,))


class HashClash(Exception):
    """Two different blocks have one key."""


def _same_blocks(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """HashClash unless the blocks at a and b are the same, byte by byte."""
    other = np.flatnonzero(a != b)
    if len(other):
        blocks = _blocks(data)
        if np.any(blocks[a[other]] != blocks[b[other]]):
            raise HashClash


def _own_keys(data: np.ndarray) -> np.ndarray:
    """A key for the block at each byte that no other block has, in the upper 48 bits, which are all that _ordered may look at."""
    place: dict[bytes, int] = {}
    raw, n = data.tobytes(), max(0, len(data) - BLOCK + 1)
    return np.fromiter((place.setdefault(raw[i : i + BLOCK], len(place)) for i in range(n)), np.uint64, n) << np.uint64(16)


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys ascending, and where each of them was. Up to 2^16 keys count by their upper 48 bits alone."""
    if len(keys) > 1 << 16:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    packed = np.sort((keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64))
    return packed & ~_PLACE, (packed & _PLACE).astype(np.int32)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a value is another one than before."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


class Transform:
    """A shard's transform.

    alphabet: the keys of its blocks, ascending, the first of which is symbol 1,
    and shown: where each of them stands in the data. suffixes: byte positions in
    the data, in order, after the strings' ends (-1), of which there are ends;
    before: the symbol before each of these, 0 at a string's start.
    """

    def __init__(self, data: np.ndarray, keys: np.ndarray, sizes: np.ndarray, first: int):
        """Of the texts of these sizes that stand in data from first on; keys: of the block at each byte of data. HashClash if a key has two blocks."""
        n = int(sizes.sum())
        cut = ranges(sizes)
        offset = (np.arange(n) - np.repeat(cut[:-1], sizes)).astype(np.int32)
        left = np.repeat(sizes, sizes).astype(np.int32) - offset
        at = np.flatnonzero(left >= BLOCK).astype(np.int32)
        ordered, order = _ordered(keys[first + at])
        new = _starts(ordered)
        symbols = np.zeros(n, np.int32)
        symbols[at[order]] = np.cumsum(new)
        self.alphabet, self.shown = ordered[new], first + at[order[new]].astype(np.int64)
        _same_blocks(data, first + at, self.shown[symbols[at] - 1])
        # From the last block on, each dealing puts one block more before what is in order already.
        order = at
        for depth in reversed(range(int(sizes.max(initial=0)) // BLOCK)):
            ahead = np.where(left[order] >= (depth + 1) * BLOCK, symbols[np.minimum(order + depth * BLOCK, n - 1)], 0) if depth else symbols[order]
            order = order[_dealt(ahead, len(self.alphabet))]
        last = at[left[at] < 2 * BLOCK]
        self.ends = len(last)
        self.suffixes = np.concatenate([np.full(len(last), -1), first + order.astype(np.int64)])
        self.before = np.concatenate([symbols[last], np.where(offset[order] < BLOCK, 0, symbols[order - BLOCK])])


def merge(data: np.ndarray, shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards' suffixes in the order of their first depth blocks, and how many of these each shares with the one before it.

    HashClash if a key has two blocks in two shards.
    """
    alphabet = np.concatenate([s.alphabet for s in shards])
    shown = np.concatenate([s.shown for s in shards])
    order = np.argsort(alphabet, kind="stable")  # runs that are in order already are merged
    new = _starts(alphabet[order])
    symbols = np.empty(len(alphabet), np.int32)
    symbols[order] = np.cumsum(new)
    _same_blocks(data, shown, shown[order[new]][symbols - 1])
    most, cut = int(new.sum()), ranges(np.array([len(s.alphabet) for s in shards]))
    before = np.concatenate([np.concatenate([[0], symbols[lo:hi]]).astype(np.int32)[s.before] for s, lo, hi in zip(shards, cut[:-1], cut[1:])])
    number = np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.uint16)
    interleave = np.repeat(number, [len(s.before) for s in shards])
    ends = np.repeat(number, [s.ends for s in shards])
    shared = np.full(len(interleave), depth, np.int32)
    shared[:1] = 0
    interval = np.zeros(len(interleave), np.int32)
    for round_ in range(depth):
        symbol = before[_in_shards(interleave)]
        order = _dealt(symbol, most)
        symbol, interval, interleave = symbol[order], interval[order], interleave[order]
        interleave[: len(ends)] = ends  # a string's end is like no other, and these keep their shards' order
        new = _starts(symbol) | _starts(interval)
        new[: len(ends)] = True
        shared[new & (shared == depth)] = round_
        interval = np.cumsum(new, dtype=np.int32)
    return np.concatenate([s.suffixes for s in shards])[_in_shards(interleave)], shared


def _in_shards(interleave: np.ndarray) -> np.ndarray:
    """For each place, where its entry stands when shard follows shard."""
    out = np.empty(len(interleave), np.int32)
    out[np.argsort(interleave, kind="stable")] = np.arange(len(interleave), dtype=np.int32)
    return out


def repeated(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text, which of its stretches of size bytes (by start) stand more than once in the texts."""
    if size % BLOCK:
        raise ValueError(f"size must be a multiple of {BLOCK}")
    sizes = np.array([len(t) for t in texts], np.int64)
    at = ranges(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = np.maximum(sizes - size + 1, 0)
    if len(data) < size:
        return [np.zeros(n, bool) for n in windows]
    try:
        suffixes, shared = _merged(data, Rolling(data).every(BLOCK), sizes, size // BLOCK)
    except HashClash:
        suffixes, shared = _merged(data, _own_keys(data), sizes, size // BLOCK)
    # Neighbours that share all of a window's blocks, and so no string's end.
    same = shared >= size // BLOCK
    twice = same | np.append(same[1:], False)
    mask = np.zeros(len(data) + 1, bool)
    mask[suffixes[twice]] = True
    return [mask[a : a + n] for a, n in zip(at[:-1], windows)]


def _merged(data: np.ndarray, keys: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    at, shards, begin = ranges(sizes), [], 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + SHARD_BYTES, side="right")) - 1)
        shards.append(Transform(data, keys, sizes[begin:end], int(at[begin])))
        begin = end
    return merge(data, shards, depth)
