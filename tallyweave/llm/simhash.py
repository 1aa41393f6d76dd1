"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to its bit counts in segments of two bits. The
Manhattan distance of these vectors is a lower bound of the Hamming distance.
Of two fingerprints at 3 or fewer differing bits, one half of 32 bits differs
in at most one, so there the vectors are equal or one step apart: a range-join
on the grid of each half's vectors, where a fingerprint stands in its own cell
and looks into those one step up. What meets in a cell is verified exactly.

A cell of very many fingerprints is split by the bits that it says nothing of:
of their two parts one differs in at most one bit again, and so on until a cell
has few. So the work grows with the fingerprints, not with a cell's square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import mix
from .common import COLUMNS, LOWER_AZ, batch, by_bytes, checkpoint, document_columns, encoded, joined_to_counts, texts, tidy
from .components import components

WORDS, SEED, BITS = 3, 42, 3
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 19
#: Fingerprints of a cell that are compared at once; larger cells are split by parts of the other half, the last of so many bits.
CELL, LEAST_PART = 512, 4
_EVEN = np.uint64(0x5555555555555555)
_LOW = np.uint64(0xFFFFFFFF)


def fingerprint(words: list[bytes], size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the words, as unsigned integers."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [digest(joined, seed)] if words else []
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[size:])]
    return np.array(hashes, np.uint64)


def simhashes(items: list[bytes], size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text; zero for one without words."""
    out = np.zeros(len(items), np.uint64)
    held: list[tuple[int, np.ndarray]] = []
    weight = 0

    def settle() -> None:
        if held:
            counts = np.array([len(h) for _, h in held], np.int64)
            bits = _bits(np.concatenate([h for _, h in held]))
            ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0, dtype=np.uint32)
            out[[i for i, _ in held]] = _majority(ones, counts)
            held.clear()

    for i, x in enumerate(items):
        hashes = fingerprint(x.translate(LOWER_AZ).split(), size, seed)
        if len(hashes) > SHINGLES:  # a very long text, in parts
            ones = sum(_bits(hashes[k : k + SHINGLES]).sum(axis=0, dtype=np.uint32) for k in range(0, len(hashes), SHINGLES))
            out[i] = _majority(ones[None], np.array([len(hashes)]))[0]
        elif len(hashes):
            held.append((i, hashes))
            weight += len(hashes)
            if weight > SHINGLES:
                settle()
                weight = 0
    settle()
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes."""
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = encoded(b.column(1))
            for lo, hi in by_bytes(items):
                yield batch({"doc_id": (b.column(0).slice(lo, hi - lo), pa.int64()), "fp": (simhashes(items[lo:hi], size, seed).view(np.int64), pa.int64())})

    return texts(docs).mapInArrow(tidy(run), "doc_id long, fp long")


def embedding(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in the two bits of its segment."""
    return (fp & _EVEN) + ((fp >> np.uint64(1)) & _EVEN)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        counts = embedding(fp)
        for half in (0, 1):
            own = (counts >> np.uint64(32 * half)) & _LOW
            side = np.uint64(half << 32)
            yield batch({"cell": ((own | side).view(np.int64), pa.int64()), "fp": (fp.view(np.int64), pa.int64()), "home": (np.ones(len(fp), bool), pa.bool_())})
            for i in range(16):
                up = np.flatnonzero((own >> np.uint64(2 * i)) & np.uint64(3) < 2)
                yield batch({"cell": (((own[up] + np.uint64(1 << 2 * i)) | side).view(np.int64), pa.int64()), "fp": (fp[up].view(np.int64), pa.int64()), "home": (np.zeros(len(up), bool), pa.bool_())})


def linked(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that join what is linked among these fingerprints: from each to the first of its group."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    left, out = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if left[i]:
            left[i] = False
            front = near[i] & left
            while front.any():
                left &= ~front
                out += [(i, j) for j in np.flatnonzero(front)]
                front = near[front].any(axis=0) & left
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each (cell, block); rows come in that order, and a group may go over batches."""
    kept: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))

    def whole(cell: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(cell)]])
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= BITS]
        u, v = [fp[two]], [fp[two + 1]]
        for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            pairs = linked(own := np.unique(fp[a:b]).view(np.uint64))
            if pairs:
                i, j = np.array(pairs).T
                u.append(own[i].view(np.int64))
                v.append(own[j].view(np.int64))
        return batch({"u": (np.concatenate(u), pa.int64()), "v": (np.concatenate(v), pa.int64())})

    for b in batches:
        kept = tuple(np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(kept))
        if len(kept[0]):
            last = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]))
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield whole(*(x[:end] for x in kept))
                kept = tuple(x[end:] for x in kept)
    if len(kept[0]):
        yield whole(*kept)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, at, bits): each fingerprint of a cell into the cells of the parts of the bits from at on, and one step up; the other part is left."""
    for b in batches:
        cell, fp = (b.column(i).to_numpy().view(np.uint64) for i in range(2))
        at, bits = (b.column(i).to_numpy() for i in (2, 3))
        for size in np.unique(bits):
            own = np.flatnonzero(bits == size)
            half = int(size) // 2
            counts = embedding(fp[own])
            for part in (0, 1):
                begin = (at[own] + half * part).astype(np.uint64)
                left = (at[own] + half * (1 - part)).astype(np.int32)
                vector = (counts >> begin) & np.uint64((1 << half) - 1)
                steps = [(None, own, vector)]
                for i in range(half // 2):
                    up = np.flatnonzero((vector >> np.uint64(2 * i)) & np.uint64(3) < 2)
                    steps.append((up, own[up], vector[up] + np.uint64(1 << 2 * i)))
                for up, rows, v in steps:
                    keys = mix(mix(cell[rows]) + (v << np.uint64(1)) + np.uint64(part))
                    n = len(rows)
                    yield batch(
                        {
                            "cell": (keys.view(np.int64), pa.int64()),
                            "fp": (fp[rows].view(np.int64), pa.int64()),
                            "home": (np.full(n, up is None), pa.bool_()),
                            "at": (left if up is None else left[up], pa.int32()),
                            "bits": (np.full(n, half, np.int32), pa.int32()),
                        }
                    )


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) that connect all at BITS or fewer differing bits."""
    cells = fps.mapInArrow(tidy(_cells), "cell long, fp long, home boolean")
    at = F.when(F.shiftrightunsigned("cell", 32).bitwiseAND(F.lit(1)) == 1, 0).otherwise(32)
    cells, few = checkpoint(cells.select("*", at.cast("int").alias("at"), F.lit(32).alias("bits"))), None
    while True:
        live = checkpoint(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("home")).where("n > 1 and home").select("cell", "n"))
        met = joined_to_counts(cells.select("cell", "fp", "at", "bits"), live, ["cell"])
        splits = (F.col("n") > CELL) & (F.col("bits") >= 2 * LEAST_PART)
        # What can't be split any more differs in few bits at most; its pairs of blocks are compared.
        blocks = F.ceil(F.col("n") / CELL)
        own = F.pmod(F.xxhash64("fp"), blocks)
        pairs = met.where(~splits).select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        block = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
        rows = pairs.select("cell", block.alias("block"), "fp")
        few = rows if few is None else few.unionByName(rows)
        hot = met.where(splits)
        if not live.where(F.col("n") > CELL).limit(1).count() or not hot.limit(1).count():
            break
        cells = checkpoint(hot.select("cell", "fp", "at", "bits").mapInArrow(tidy(_split), "cell long, fp long, home boolean, at int, bits int"))
    return few.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(tidy(_verify), "u long, v long")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, label, component_id): label names the component among fingerprints."""
    found = checkpoint(fingerprints(docs))
    least = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(least.select("fp")))
    in_links = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    first = in_links.groupBy("label").agg(F.min("least").alias("component_id"))
    named = in_links.join(first, "label").select("fp", "label", "component_id")
    each = checkpoint(least.join(named, "fp", "left").select("fp", "n", F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    return joined_to_counts(found, each, ["fp"]).select("doc_id", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach).

    Null and empty texts have fingerprint zero, linked like any other. Rows with
    equal doc_id are each fingerprinted; null doc_ids are no component's id
    unless all of its are null. An empty table gives an empty result.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, of the smallest doc_id in each component; of rows with the same doc_id and component, one.

    Null and empty texts are near-duplicates of each other, so one of them stays;
    a null doc_id stays only where a component has no other; an empty table gives
    an empty result.
    """
    docs = document_columns(docs)
    groups = checkpoint(grouped(docs))
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = first.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not again:
        return docs.join(first.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    # doc_id doesn't name a row here, so the fingerprint does, with it.
    chosen = first.groupBy("label").agg(F.min("doc_id").alias("id"), F.min("fp").alias("chosen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(simhashes(encoded(b.column(1))).view(np.int64))], names=[*COLUMNS, "fp"])

    rows = docs.mapInArrow(tidy(run), "doc_id long, text string, lang string, source string, n_chars long, fp long")
    met = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("chosen")))
    return met.dropDuplicates(["label"]).select(*COLUMNS)
