"""Best-fit packing with a swap-based local search.

What is packed is a histogram: how many pieces there are of each length. Its
size doesn't grow with the corpus, and neither do the bins, which stand in
groups: a pattern of lengths with the number of bins that hold it. Best fit
arranges the lengths from the longest down; then a local search exchanges one
piece for one, two for one, or moves pieces between underfull bins, each step
adding to the sum of squared fills, until bins empty. A piece finds its place
by its rank among the pieces of its length, which comes from prefix sums of
what each partition holds.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, checkpoint, texts, tidy
from .tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Bins as {pattern: number}, a pattern being a descending tuple of lengths."""
    groups: dict[int, Counter] = {}  # by what is still free
    free: list[int] = []  # those with groups, in order

    def put(pattern: tuple[int, ...], left: int, n: int) -> None:
        if left not in groups:
            groups[left] = Counter()
            insort(free, left)
        groups[left][pattern] += n

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(free, length)
            if at == len(free):
                fit = min(capacity // length, todo)
                bins = todo // fit
                put((length,) * fit, capacity - fit * length, bins)
                todo -= bins * fit
                continue
            left = free[at]
            pattern, n = groups[left].popitem()
            fit = min(left // length, todo)
            bins = min(n, todo // fit)
            if n > bins:
                groups[left][pattern] = n - bins
            if not groups[left]:
                del groups[left], free[at]
            put(pattern + (length,) * fit, left - fit * length, bins)
            todo -= bins * fit
    out = Counter()
    for g in groups.values():
        out.update(g)
    return out


def local_search(bins: Counter, capacity: int) -> Counter:
    """Empty the least filled bins into other underfull ones by swaps and moves, until no bin has a step.

    A donor gives a piece to an underfull bin (move), or gives its longer piece
    for a shorter one (one for one) or for two shorter ones (two for one) of a
    bin that has room for the difference and is no less filled; so every step
    raises the sum of squared fills, and steps end. Equal bins take the same step
    together. A donor without a step is tried again with patterns that are new since.
    """
    bins = +bins
    under = sorted((sum(p), p) for p in bins if sum(p) < capacity)
    fresh: list[tuple[int, ...]] = []  # patterns that came up, or had more than one bin again, in order
    seen: dict[tuple[int, ...], int] = {}  # donors that had no step, and how many of fresh they were tried with

    def change(pattern: tuple[int, ...], n: int) -> None:
        had = bins[pattern]
        bins[pattern] = had + n
        key = (sum(pattern), pattern)
        if key[0] < capacity:
            if not had:
                insort(under, key)
            if n > 0 and had < 2:
                fresh.append(pattern)
            if not had + n:
                del under[bisect_left(under, key)]
        if not had + n:
            del bins[pattern]

    while True:
        for _, donor in under:
            takers = fresh[seen[donor] :] if donor in seen else [p for _, p in under]
            step = _step(donor, [p for p in takers if bins[p] > (p == donor)], capacity) if takers else None
            if step is not None:
                break
            seen[donor] = len(fresh)
        else:
            return bins
        taker, new_donor, new_taker = step
        n = bins[donor] // 2 if taker == donor else min(bins[donor], bins[taker])
        change(donor, -n)
        change(taker, -n)
        if new_donor:
            change(new_donor, n)
        change(new_taker, n)


def _step(donor: tuple[int, ...], takers: list[tuple[int, ...]], capacity: int):
    """The step of the largest gain from donor to a taker: (taker, donor after, taker after)."""
    fill, best = sum(donor), None
    for taker in takers:
        have = sum(taker)
        room = capacity - have
        if have < fill:
            continue
        short = sorted(set(taker))
        for x in sorted(set(donor), reverse=True):
            gains = [(x, ())] if x <= room else []
            at = bisect_left(short, max(1, x - room))
            if at < len(short) and short[at] < x:
                gains.append((x - short[at], (short[at],)))
            if len(taker) > 1:
                for i, y in enumerate(short):
                    j = bisect_left(short, max(1, x - room - y))
                    if j < len(short) and y + short[j] < x and (short[j] != y or taker.count(y) > 1):
                        gains.append((x - y - short[j], (y, short[j])))
                        break
            for gain, back in gains:
                score = (gain * (have - fill + gain), gain)
                if best is None or score > best[0]:
                    best = (score, taker, x, back)
    if best is None:
        return None
    _, taker, x, back = best
    after, other = list(donor), list(taker)
    after.remove(x)
    other.append(x)
    for y in back:
        other.remove(y)
        after.append(y)
    return taker, tuple(sorted(after, reverse=True)), tuple(sorted(other, reverse=True))


def places(bins: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first ranks of runs of pieces, and the sequence and offset of each run's first piece.

    Pieces of a run go to consecutive sequences at the same offset.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for pattern, n in sorted(bins.items(), key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((taken[length], first, offset))
            taken[length] += n
            offset += length
        first += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document with their ranks among those of their length in their partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(enc.ids(text) + end, enc.dtype).astype("<u4")
                at = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                    rows.append((key, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), part, seen[hi - lo]))
                    seen[hi - lo] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield batch({name.split(" ")[0]: (x, kind) for name, x, kind in zip(_PIECES.split(", "), zip(*rows), kinds)})

    return texts(docs).mapInArrow(tidy(cut), _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of at most capacity tokens as it can.

    Null and empty texts are pieces of the end id alone; rows with equal or null
    doc_id are packed each; an empty table gives an empty result. Only the
    histogram of lengths, at most capacity rows, comes to the driver.
    """
    found = checkpoint(pieces(docs, tokenizer, capacity, end_id))
    held = checkpoint(found.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    counts.pop(capacity, None)  # these are sequences already
    bins = local_search(best_fit(counts, capacity), capacity)
    first_full = sum(bins.values())
    table = places(bins)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = found.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("part_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = first_full + rank, np.zeros(len(rank), np.int64)
            for k in np.unique(length[length < capacity]):
                own = np.flatnonzero(length == k)
                ranks, firsts, offsets = table[int(k)]
                run = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence[own] = firsts[run] + rank[own] - ranks[run]
                offset[own] = offsets[run]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
