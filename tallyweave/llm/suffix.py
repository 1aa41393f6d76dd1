"""Removal of long byte strings that stand more than once, by merged Burrows-Wheeler transforms.

Texts are written once, compressed, a file for each input partition in the
shared folder; everything that moves afterwards is small rows. Every window of
``size`` bytes names one anchor, the least rolling hash of its ``GRAM``-byte
strings, so equal windows name equal anchors. Anchors that stand once have no
repeated window; that is all that hashes decide. The windows of another anchor
lie in stretches, its contexts, and those of an anchor meet in one task, which
builds transforms of shards of contexts and merges these (``bwt``): where
neighbours of the merged order share a window's length, both windows repeat.

Equal contexts of one partition are found where their text is read, byte by
byte, and only one goes on. An anchor with very many contexts is narrowed in
rounds: of equal contexts one stays, and a context falls into two by where in
its windows the anchor stands, each half with the longer string that all its
windows hold around the anchor in place of it. So no key keeps more than
``HOT`` contexts, and a string that stands in very many places moves once for
each partition.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import Rolling, repeated
from .common import COLUMNS_SCHEMA, batch, by_bytes, checkpoint, document_columns, encoded, filesystem, joined_to_counts, ranges, texts, tidy, work_dir

SIZE = 200
#: Bytes of the strings whose hashes name anchors.
GRAM = 64
#: Contexts of a key that meet in one merge; keys with more are narrowed first.
HOT = 1024
#: Bytes of text whose anchors are looked for at once.
ANCHOR_BYTES = 1 << 19
#: Context bytes that a task merges at once, sixteen shards or more.
MERGE_BYTES = 1 << 20
#: Context bytes of a partition that are told apart where the texts are read, before it begins anew.
SEEN_BYTES = 8 << 20
_ROW = 40  # bits of a row's number within its partition
#: A context (bytes) of a key, or a stretch that goes (bytes null): where it is, its length, the anchor's place in it, and the places (from, to) of the anchor in its windows.
_CONTEXT = "key long, row long, start int, size int, at int, `from` int, `to` int, bytes binary"
_STRETCH = "row long, start int, end int"
_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(items: list[bytes], size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: item, hash of the anchor's string, and its context's start and length."""
    sizes = np.array([len(x) for x in items], np.int64)
    at, data = ranges(sizes), np.frombuffer(b"".join(items), np.uint8)
    if len(data) < size:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = Rolling(data).every(gram)
    width = size - gram + 1
    n = len(hashes)
    packed = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[:n] = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    item = np.repeat(np.arange(len(items)), sizes)[:m]
    start = np.flatnonzero(at[item + 1] - np.arange(m) >= size)  # windows within one text
    own = least[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (item[start[1:]] != item[start[:-1]])])) if len(start) else np.zeros(0, np.int64)
    lo = start[first]
    hi = start[np.append(first[1:], len(start)) - 1] if len(first) else lo
    owner = item[lo]
    return owner, hashes[own[first]].view(np.int64), lo - at[owner], hi + size - lo


def anchors_in_parts(items: list[bytes], size: int = SIZE, most: int = ANCHOR_BYTES) -> tuple[np.ndarray, ...]:
    """anchors, a text over most bytes in parts: the windows that begin in each. A context may end at a part's end, and go on in a second one."""
    if len(items) != 1 or len(items[0]) <= 2 * most:
        return anchors(items, size)
    found = []
    for at in range(0, len(items[0]) - size + 1, most):
        owner, anchor, start, length = anchors([items[0][at : at + most + size - 1]], size)
        found.append((owner, anchor, start + at, length))
    return tuple(np.concatenate(x) for x in zip(*found))


def _write(source: DataFrame, folder: str) -> list[tuple[int, int]]:
    """Write (doc_id, text, further string columns) with the texts' anchors; return the partitions and their rows."""
    more = source.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, writer = TaskContext.get().partitionId(), 0, None
        fs, path = filesystem(f"{folder}/texts-{part:06d}.parquet")
        own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
        for b in batches:
            items = encoded(b.column(1))
            for lo, hi in by_bytes(items, ANCHOR_BYTES):
                found = anchors_in_parts(items[lo:hi])
                cut = np.searchsorted(found[0], np.arange(hi - lo + 1))
                blobs = [[x[i:j].astype(kind).tobytes() for i, j in zip(cut[:-1], cut[1:])] for x, kind in zip(found[1:], ("<i8", "<i4", "<i4"))]
                out = batch(
                    {"doc_id": (b.column(0).slice(lo, hi - lo), pa.int64()), "text": ([zlib.compress(x, 1) for x in items[lo:hi]], pa.large_binary())}
                    | {name: (b.column(2 + i).slice(lo, hi - lo), None) for i, name in enumerate(more)}
                    | {name: (x, pa.large_binary()) for name, x in zip(("anchor", "start", "size"), blobs)}
                )
                if writer is None:
                    writer = pq.ParquetWriter(own, out.schema, filesystem=fs, compression="none", use_dictionary=False, write_statistics=False)
                writer.write_batch(out)
                rows += out.num_rows
        if writer is not None:
            writer.close()
            fs.move(own, path)
            yield batch({"part": ([part], pa.int32()), "n": ([rows], pa.int64())})

    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    return [(r["part"], r["n"]) for r in source.mapInArrow(tidy(run), "part int, n long").collect()]


def _batches(folder: str, part: int, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a partition's file with the number of the first of each batch."""
    fs, path = filesystem(f"{folder}/texts-{part:06d}.parquet")
    with fs.open_input_file(path) as f:
        row = 0
        for b in pq.ParquetFile(f).iter_batches(256, columns=columns):
            yield row, b
            row += b.num_rows


def _anchor_rows(parts: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                for row, x in _batches(folder, part, ["anchor", "start", "size"]):
                    blobs = [x.column(i).to_pylist() for i in range(3)]
                    counts = np.array([len(y) // 8 for y in blobs[0]])
                    rows = (part << _ROW) + row + np.repeat(np.arange(x.num_rows), counts)
                    flat = [np.frombuffer(b"".join(y), kind) for y, kind in zip(blobs, ("<i8", "<i4", "<i4"))]
                    yield batch({"anchor": (flat[0], pa.int64()), "row": (rows, pa.int64()), "start": (flat[1], pa.int32()), "size": (flat[2], pa.int32())})

    return parts.mapInArrow(tidy(run), "anchor long, row long, start int, size int")


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (row, ...) where their partition's file will be read, in order."""
    return rows.repartitionById(parts, F.shiftright("row", _ROW).cast("int")).sortWithinPartitions("row")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each partition's rows (row first), which come in order."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[tuple[int, list[np.ndarray]]]:
        table = pa.Table.from_batches(held)
        columns = [c.to_numpy() for c in table.columns]
        part = columns[0] >> _ROW
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield int(part[lo]), [c[lo:hi] for c in columns]

    for b in batches:
        if b.num_rows:
            if held and (b.column(0)[0].as_py() >> _ROW) != (held[0].column(0)[0].as_py() >> _ROW):
                yield from whole()
                held = []
            held.append(b)
    if held:
        yield from whole()


class _Contexts:
    """Rows of _CONTEXT that are put together."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, key: int, row: int, start: int, at: int, low: int, high: int, text: bytes) -> None:
        self.rows.append((key, row, start, len(text), at, low, high, text))

    def goes(self, row: int, start: int, size: int) -> None:
        # No key of its own is needed, so such rows are dealt out evenly.
        self.rows.append(((row * 0x9E3779B1 + start * 0x85EBCA6B) & 0x7FFFFFFFFFFFFFFF, row, start, size, 0, 0, 0, None))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary())
        columns = list(zip(*self.rows)) or [[]] * 8
        self.rows = []
        return batch({name: (x, kind) for name, x, kind in zip(("key", "row", "start", "size", "at", "from", "to", "bytes"), columns, kinds)})


class _Seen:
    """Tells equal contexts of a task from new ones: all of the equal ones go, and only the first is handed on."""

    def __init__(self, out: _Contexts):
        self.out, self.held, self.weight = out, {}, 0

    def new(self, key: int, row: int, start: int, text: bytes) -> bool:
        if (key, text) not in self.held:
            if self.weight > SEEN_BYTES:  # equal ones on either side of this meet later on
                self.held, self.weight = {}, 0
            self.held[key, text] = row, start
            self.weight += len(text)
            return True
        self.out.goes(row, start, len(text))
        if (first := self.held[key, text]) is not None:
            self.out.goes(*first, len(text))
            self.held[key, text] = None
        return False


def _anchor_places(texts_: list[bytes], keys: list[int], gram: int) -> list[int]:
    """Where in each text the string of its anchor stands first."""
    cut = ranges(np.array([len(x) for x in texts_]))
    hashes = Rolling(np.frombuffer(b"".join(texts_), np.uint8)).every(gram).view(np.int64)
    hit = np.flatnonzero(hashes == np.repeat(np.array(keys, np.int64), np.diff(cut))[: len(hashes)])
    return (hit[np.searchsorted(hit, cut[:-1])] - cut[:-1]).tolist()


def _context_rows(met: DataFrame, folder: str, parts: int, size: int, hot: bool) -> DataFrame:
    """_CONTEXT of rows (row, anchor, start, size): of equal contexts of a partition one, while all of them go. hot: with the anchors' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Contexts()
        for part, (rows, anchor, start, length) in _grouped(batches):
            numbers = rows & ((1 << _ROW) - 1)
            seen = _Seen(out)
            for row, x in _batches(folder, part, ["text"]):
                lo, hi = np.searchsorted(numbers, [row, row + x.num_rows])
                if lo == hi:
                    continue
                last, text, fresh = -1, b"", []
                own = zip(numbers[lo:hi].tolist(), rows[lo:hi].tolist(), anchor[lo:hi].tolist(), start[lo:hi].tolist(), length[lo:hi].tolist())
                for number, row_id, key, begin, n in own:
                    if number != last:
                        last, text = number, zlib.decompress(x.column(0)[number - row].as_py())
                    piece = text[begin : begin + n]
                    if seen.new(key, row_id, begin, piece):
                        fresh.append((key, row_id, begin, piece))
                places = _anchor_places([f[3] for f in fresh], [f[0] for f in fresh], GRAM) if hot and fresh else [0] * len(fresh)
                for (key, row_id, begin, piece), at in zip(fresh, places):
                    out.add(key, row_id, begin, at, 0, size - GRAM + 1, piece)
                yield out.batch()

    return _by_part(met.select("row", "anchor", "start", "size"), parts).mapInArrow(tidy(run), _CONTEXT)


def _narrowed(contexts: DataFrame, size: int) -> DataFrame:
    """Contexts once each (all of equal ones go), in two halves by the place of the anchor in their windows, equal halves of a task once too.

    The key of a half is what all of its windows hold around the anchor. Halves of a single place are one window, and need no other key.
    """

    def halves(out: _Contexts, seen: _Seen, row: int, start: int, at: int, low: int, high: int, text: bytes) -> None:
        middle = (low + high) // 2
        for a, b in ((low, middle), (middle, high)):
            # A window that starts at s has the anchor at place at - s.
            first, end = max(0, at - b + 1), min(len(text) - size, at - a) + 1
            if a < b and first < end:
                key = xxhash.xxh64_intdigest(text[at - a : at - b + 1 + size], a << 16 | b)
                key, half = key - (1 << 64) * (key >> 63), text[first : end - 1 + size]
                if seen.new(key, row, start + first, half):
                    out.add(key, row, start + first, at - first, a, b, half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, alone = _Contexts(), None, True
        seen = _Seen(out)
        for b in batches:
            for key, row, start, at, low, high, text in zip(*(b.column(i).to_pylist() for i in range(7))):
                if held is not None and (held[0], held[-1]) == (key, text):
                    out.goes(row, start, len(text))
                    if alone:
                        out.goes(held[1], held[2], len(text))
                    alone = False
                    continue
                if held is not None and held[5] - held[4] > 1:
                    halves(out, seen, *held[1:])
                held, alone = (key, row, start, at, low, high, text), True
            yield out.batch()
        if held is not None and held[5] - held[4] > 1:
            halves(out, seen, *held[1:])
            yield out.batch()

    dealt = contexts.select("key", "row", "start", "at", "from", "to", "bytes").repartition(F.col("key"), F.xxhash64("bytes")).sortWithinPartitions("key", "bytes")
    return dealt.mapInArrow(tidy(run), _CONTEXT)


def _cooled(contexts: DataFrame, size: int) -> DataFrame:
    """_CONTEXT with at most HOT contexts of a key; those whose key no other has are dropped.

    A round halves the places that a key stands for, and then a key has only equal windows, of which one stays: there are few rounds.
    """
    live, out = checkpoint(contexts), None
    while True:
        counts = checkpoint(live.where("bytes is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        met = joined_to_counts(live.where("bytes is not null"), counts, ["key"])
        cold = live.where("bytes is null").unionByName(met.where(F.col("n") <= HOT).drop("n"))
        out = cold if out is None else out.unionByName(cold)
        if not counts.where(F.col("n") > HOT).limit(1).count():
            return out
        live = checkpoint(_narrowed(met.where(F.col("n") > HOT), size))


def _stretches(contexts: DataFrame, size: int) -> DataFrame:
    """_STRETCH of what goes: rows without bytes, and the windows of contexts that stand again in a context of their key.

    Rows (key, row, start, size, bytes) come with those of a key together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        weight, last = 0, None

        def merged() -> Iterator[tuple[int, int, int]]:
            held.sort(key=lambda x: x[:2])  # a shard's contexts are from the same partitions
            for (row, start, _), mask in zip(held, repeated([x[2] for x in held], size)):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8))).tolist()
                for a, b in zip(edges[::2], edges[1::2]):
                    yield row, start + a, start + b + size - 1
            held.clear()

        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 3
            return batch({"row": (columns[0], pa.int64()), "start": (columns[1], pa.int32()), "end": (columns[2], pa.int32())})

        for b in batches:
            found = []
            for key, row, start, n, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                if text is None:
                    found.append((row, start, start + n))
                    continue
                if weight > MERGE_BYTES and key != last:
                    found += merged()
                    weight = 0
                held.append((row, start, text))
                weight, last = weight + len(text), key
            yield out(found)
        yield out(list(merged()))

    dealt = contexts.select("key", "row", "start", "size", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(run), _STRETCH)


def _finish(removed: DataFrame, folder: str, parts: int, schema: str, make) -> DataFrame:
    """Every written text without the bytes of its removed stretches (row, start, end).

    make(row of the file, its text, a mask of the bytes that go or None) gives the values of schema.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (rows, start, end) in _grouped(batches):
            rows = rows & ((1 << _ROW) - 1)
            for first, x in _batches(folder, part, ["doc_id", "text", *(n for n in names if n in ("lang", "source"))]):
                out = []
                bounds = np.searchsorted(rows, first + np.arange(x.num_rows + 1))
                for i, row in enumerate(x.to_pylist()):
                    text = zlib.decompress(row["text"])
                    real = np.flatnonzero(start[bounds[i] : bounds[i + 1]] >= 0) + bounds[i]
                    gone = None
                    if len(real):
                        cover = np.zeros(len(text) + 1, np.int32)
                        np.add.at(cover, start[real], 1)
                        np.subtract.at(cover, end[real], 1)
                        gone = np.cumsum(cover[:-1]) > 0
                    out.append(make(row, text, gone))
                yield batch({n: (c, k) for n, c, k in zip(names, zip(*out), types)})

    return _by_part(removed, parts).mapInArrow(tidy(run), schema)


def _kept(text: bytes, gone: np.ndarray | None) -> bytes:
    return text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()


def _measures(row: dict, text: bytes, gone: np.ndarray | None) -> tuple:
    kept = _kept(text, gone)
    spans = 0 if gone is None else int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
    return row["doc_id"], len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def _document(row: dict, text: bytes, gone: np.ndarray | None) -> tuple:
    kept = _kept(text, gone).decode("utf-8", "ignore")
    return row["doc_id"], kept, row["lang"], row["source"], len(kept)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document.

    A byte goes if some string of size bytes over it starts anywhere else too,
    in any document or its own; all copies go. Null texts are empty; rows with
    equal doc_id are texts of their own, so equal long rows remove each other;
    texts shorter than size stay; an empty table gives an empty result.
    """
    return _removed(texts(docs), size, _KEPT, _measures)


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents, with their columns, without what remove_repeats removes; where that cuts through a character, what is left of it goes too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return _removed(document_columns(docs).select("doc_id", text.alias("text"), "lang", "source"), size, COLUMNS_SCHEMA, _document)


def _removed(source: DataFrame, size: int, schema: str, make) -> DataFrame:
    spark = source.sparkSession
    folder = work_dir(spark, "repeats")
    listed = _write(source, folder)
    parts = max((p for p, _ in listed), default=0) + 1
    files = spark.createDataFrame([(p,) for p, _ in listed], "part int").repartitionById(parts, F.col("part"))
    rows = _anchor_rows(files, folder)
    again = checkpoint(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    met = joined_to_counts(rows, again, ["anchor"])
    if again.where(F.col("n") > HOT).limit(1).count():
        met = checkpoint(met)
        hot = _cooled(_context_rows(met.where(F.col("n") > HOT), folder, parts, size, True), size)
        contexts = _context_rows(met.where(F.col("n") <= HOT), folder, parts, size, False).unionByName(hot)
    else:
        contexts = _context_rows(met, folder, parts, size, False)
    none = spark.createDataFrame([(p << _ROW, -1, -1) for p, _ in listed], _STRETCH)  # so that each file is read
    return _finish(_stretches(contexts, size).unionByName(none), folder, parts, schema, make)
