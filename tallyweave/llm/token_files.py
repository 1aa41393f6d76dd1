"""Token-id files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A run's folder holds, for each shard k in ascending doc_id order,
``tokens-k.bin`` (the ids, little-endian, two bytes each where the vocabulary
allows and four otherwise) and ``tokens-k.idx`` (``MAGIC``, the id size and the
number of documents as two int64, their doc_ids as int64, then their offsets in
ids as int64, one more than documents). ``shards.json`` names the shards with
their bases: the ids and documents before each, prefix sums of what the shards
hold.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, filesystem, shuffle_parts, texts, tidy, work_dir
from .tokens import encoder

MAGIC = b"TALLYTOK"
#: Stands for a null doc_id in the files; such documents come first.
NO_ID = -(1 << 63)
#: Partitions of the input that go into a shard, about; documents and ids of a shard that are read at a time.
INPUTS_EACH, READ_DOCS, READ_IDS = 4, 4096, 8 << 20
_OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write(folder: str, name: str, parts: list[bytes]) -> None:
    """A file that appears whole or not at all, so that a task run twice does no harm."""
    fs, path = filesystem(f"{folder}/{name}")
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(own) as f:
        for x in parts:
            f.write(x)
    fs.move(own, path)


class _Held:
    """A file's bytes, mapped where the folder is local, else read by ranges."""

    def __init__(self, folder: str, name: str):
        fs, path = filesystem(f"{folder}/{name}")
        self.map = self.file = None
        if isinstance(fs, pafs.LocalFileSystem):
            self.map = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        else:
            self.file = fs.open_input_file(path)

    def array(self, dtype: str, at: int, n: int) -> np.ndarray:
        """n values of a type from a byte on."""
        size = n * np.dtype(dtype).itemsize
        return np.frombuffer(self.map[at : at + size] if self.file is None else self.file.read_at(size, at), dtype)


def shard_cuts(docs: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids that cut the documents into ranges, each up to and with one of them, and into how many shards each range goes.

    Ranges have about as many rows, parts of them in all. A doc_id that many rows
    have, or null (NO_ID), is a range of its own that goes into several.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    got = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    often = Counter(got or [])
    cuts: dict[int, int] = {}
    for value in sorted(often):
        if often[value] > 1 and value > NO_ID:
            cuts.setdefault(value - 1, 1)
        cuts[value] = often[value]
    # The range after the last cut is one shard.
    return np.array(list(cuts), np.int64), np.array([*cuts.values(), 1], np.int64)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> list[dict]:
    """Encode every whole text, append end_id, write the shards to folder and return them with their bases.

    parts: how many shards there are, about; by default one for every
    INPUTS_EACH partitions of the input, which grow with it. Null texts hold the
    end id alone; null doc_ids come first; rows with equal doc_id keep a fixed
    order among them (by a hash of their ids, then by these) and may go over
    several shards; very long texts are encoded whole; an empty table writes no
    shard. Shards move only ids, not texts.
    """
    source = texts(docs)
    parts = parts or max(shuffle_parts(docs.sparkSession), source.rdd.getNumPartitions() // INPUTS_EACH)
    cuts, fan = shard_cuts(docs, parts)
    bases = np.concatenate([[0], np.cumsum(fan)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            ids = [enc.ids(x) + end for x in b.column(1).to_pylist()]
            key = np.array([NO_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
            at = np.searchsorted(cuts, key, side="left")
            h = np.array([zlib.crc32(x) for x in ids], np.int64)
            part = bases[at] + (h * fan[at] >> 32)
            yield batch({"doc_id": (key, pa.int64()), "h": (h, pa.int64()), "ids": (ids, pa.binary()), "part": (part.astype(np.int32), pa.int32())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, keys, sizes, part = encoder(tokenizer).dtype, [], [], None
        name = f"own-{os.getpid()}-{os.urandom(6).hex()}"
        fs, path = filesystem(f"{folder}/{name}")
        with fs.open_output_stream(path) as f:
            for b in batches:
                for key, ids, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    f.write(ids)
                    keys.append(key)
                    sizes.append(len(ids) // dtype.itemsize)
        if part is None:
            fs.delete_file(path)
            return
        _write(folder, f"tokens-{part:06d}.idx", [MAGIC, np.array([dtype.itemsize, len(keys)], "<i8").tobytes(), np.array(keys, "<i8").tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes()])
        fs.move(path, filesystem(f"{folder}/tokens-{part:06d}.bin")[1])
        yield batch({"part": ([part], pa.int32()), "n_docs": ([len(keys)], pa.int64()), "n_tokens": ([sum(sizes)], pa.int64())})

    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    ids = source.mapInArrow(tidy(encode), "doc_id long, h long, ids binary, part int")
    dealt = ids.repartitionById(int(bases[-1]), F.col("part")).sortWithinPartitions("doc_id", "h", "ids")
    shards, tokens, before = [], 0, 0
    for row in sorted(dealt.mapInArrow(tidy(write), "part int, n_docs long, n_tokens long").collect()):
        shards.append({"part": row.part, "n_docs": row.n_docs, "n_tokens": row.n_tokens, "first_token": tokens, "first_doc": before})
        tokens, before = tokens + row.n_tokens, before + row.n_docs
    _write(folder, "shards.json", [json.dumps({"end_id": end_id, "shards": shards}).encode()])
    return shards


def read_shard(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and ids of a whole shard; mapped and not copied where the folder is local, else in memory."""
    index, size, n = _index(folder, part)
    data = _Held(folder, f"tokens-{part:06d}.bin")
    offsets = index.array("<i8", 24 + 8 * n, n + 1)
    return index.array("<i8", 24, n), offsets, data.array(f"<u{size}", 0, int(offsets[-1]))


def _index(folder: str, part: int) -> tuple[_Held, int, int]:
    """A shard's index, the bytes of its ids and how many documents it has."""
    index = _Held(folder, f"tokens-{part:06d}.idx")
    if index.array("u1", 0, 8).tobytes() != MAGIC:
        raise ValueError(f"shard {part} of {folder} is not a token file")
    return index, *index.array("<i8", 8, 2).tolist()


def read_documents(folder: str, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, offsets (one more) and ids of a shard's documents, so many at a time; mapped and not copied where the folder is local."""
    index, size, n = _index(folder, part)
    data, at = _Held(folder, f"tokens-{part:06d}.bin"), 0
    while at < n:
        most = min(n, at + READ_DOCS)
        offsets = index.array("<i8", 24 + 8 * (n + at), most - at + 1)
        # As many as READ_IDS allows, one at least.
        take = max(1, int(np.searchsorted(offsets, offsets[0] + READ_IDS, side="right")) - 1)
        offsets = offsets[: min(take, most - at) + 1]
        yield index.array("<i8", 24 + 8 * at, len(offsets) - 1), offsets, data.array(f"<u{size}", size * int(offsets[0]), int(offsets[-1] - offsets[0]))
        at += len(offsets) - 1


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    fs, path = filesystem(f"{folder}/shards.json")
    with fs.open_input_file(path) as f:
        shards = json.loads(f.read())["shards"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for keys, offsets, ids in read_documents(folder, part):
                    at = offsets - offsets[0]
                    crc = [zlib.crc32(ids[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(at[:-1], at[1:])]
                    yield batch({"doc_id": ([None if k == NO_ID else int(k) for k in keys], pa.int64()), "start": (base + offsets[:-1], pa.int64()), "n_tokens": (np.diff(offsets), pa.int64()), "ids_crc32": (crc, pa.int64())})

    listed = spark.createDataFrame([(s["part"], s["first_token"]) for s in shards], "part int, base long")
    return listed.repartitionById(max(1, len(shards)), F.col("part")).mapInArrow(tidy(read), _OUT)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the files into folder (a new one of the shared folder if none is named) and read them back."""
    folder = folder or work_dir(docs.sparkSession, "token-files")
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(docs.sparkSession, folder)
