"""What the operators of this folder share: inputs, the shared folder, batching."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import checkpoint, new_dir, shared_dir  # noqa: F401

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows that one Arrow batch may hold, so that a batch of long texts stays small.
BATCH_ROWS = 512
#: Text bytes that an operator works on at a time within a batch.
CHUNK_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text (null: empty) by position, so that clashing extra columns don't matter."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: The columns of documents; stages of a pipeline take and return them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
COLUMNS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_columns(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    kinds = dict(x.split(" ") for x in COLUMNS_SCHEMA.split(", "))
    return docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Folders that operators made, by the session's application; what they hold is read as long as their results are.
_MADE: dict[str, list[str]] = {}


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the shared folder, removed by ``release`` or when the driver ends."""
    folder = new_dir(spark, what)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the folders that operators made since so many were there, but those to keep. Results that aren't written yet can't be read any more."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    _remove([x for x in made[since:] if x not in keep])
    made[since:] = [x for x in made[since:] if x in keep]


def made(spark: SparkSession) -> int:
    """How many folders operators have made that are still there."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def _remove(folders: list[str]) -> None:
    for folder in folders:
        with contextlib.suppress(OSError):
            fs, path = filesystem(folder)
            fs.delete_dir(path)


@atexit.register
def _remove_all() -> None:
    for folders in _MADE.values():
        _remove(folders)
    _MADE.clear()


#: Keys that count as frequent at most, as a key must have more than the rows' share of this number; and the fewest rows of one.
FREQUENT_KEYS, FREQUENT_LEAST = 10_000, 1000


def joined_to_counts(rows: DataFrame, counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows with the columns of counts, a row for each of their keys and how many rows have it (n); rows without one are dropped.

    Frequent keys, of which there can't be more than FREQUENT_KEYS as each holds
    that share of the rows, are looked up where the rows are (a broadcast of
    that bounded size), and such rows are then dealt out evenly; the others meet
    their counts in a merge join. So no key's rows gather in one task.
    """
    most = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    others = [c for c in counts.columns if c not in keys]
    frequent = counts.where(F.col(n) > max(FREQUENT_LEAST, most // FREQUENT_KEYS)).select(*keys, *[F.col(c).alias(f"__f_{c}") for c in others])
    marked = rows.join(F.broadcast(frequent), keys, "left")
    deal = F.when(F.col(f"__f_{n}").isNotNull(), 1 + F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(1 << 20))).otherwise(0)
    # Always 0, but not a literal, which the optimizer would take out of the join's keys.
    plain = counts.withColumn("__deal", F.pmod(F.xxhash64(*keys), F.lit(1).cast("long"))).hint("merge")
    met = marked.withColumn("__deal", deal.cast("long")).hint("merge").join(plain, [*keys, "__deal"], "left")
    return met.select(*rows.columns, *[F.coalesce(f"__f_{c}", c).alias(c) for c in others]).where(F.col(n).isNotNull())


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}".replace("file://file:", "file:"))


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The values of a text column as UTF-8, null as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [x or b"" for x in column.to_pylist()]


def by_bytes(items: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of at most so many bytes; a longer item stands alone."""
    begin = size = 0
    for i, x in enumerate(items):
        if i > begin and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(items):
        yield begin, len(items)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then what it freed goes back to the system: workers live on, beside others with the same memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def batch(columns: dict[str, tuple[Iterable, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in columns.values()], names=list(columns))


def crc32_of(column: Column) -> Column:
    """Unsigned crc32 of a value's text."""
    return F.crc32(column.cast("string").cast("binary"))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths start, and the end."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
