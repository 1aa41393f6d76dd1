"""Ordered ingest of a stream into snapshots.

A batch is checked, cut against what is committed, and published by one
manifest, named by the stream's batch id, so that a batch that runs twice is
committed once. Heights are committed without gaps: rows above a gap wait in a
table of their own and go in when the gap closes. That is a frontier, not an
event-time watermark: nothing is late by time, only by place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.chain import FEW, frontier, heaviest, weighed, with_heights
from ..plans.shared import sweep
from ..plans.snapshot import Snapshots

ROWS, WAITING, BAD, HEADERS = "rows", "waiting", "quarantine", "headers"
STREAM = "ingest"


def ingest_batch(rows: DataFrame, batch: int, into: Snapshots, valid: Column, key: str = "height") -> None:
    """Commit a batch of rows (height, ...).

    Bad rows go to the quarantine table, and from then on rows with the key of
    one of those are dropped, valid or not. Known heights are dropped; of several
    rows of a height the least one stays, so that a batch that runs twice
    commits the same.
    """
    now = into.manifest()
    if batch <= now["streams"].get(STREAM, -1):
        return
    spark, at = into.spark, now["facts"].get("frontier", 0)
    ok = F.coalesce(valid, F.lit(False))
    bad = rows.where(~ok)
    good = rows.where(ok & (F.col("height") >= at))
    if WAITING in now["tables"]:
        good = good.unionByName(into.read(WAITING).where(F.col("height") >= at))
    listed = bad.select(key) if BAD not in now["tables"] else bad.select(key).unionByName(into.read(BAD).select(key))
    good = good.join(listed.distinct(), key, "left_anti").select(*rows.columns)
    fresh = good.groupBy("height").agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*").persist()
    ends = fresh.select(F.col("height").alias("first"), (F.col("height") + 1).alias("end"))
    start = spark.createDataFrame([(-1, at)], "first long, end long")
    reach = frontier(ends.unionByName(start)).first()["frontier"]
    reach = at if reach is None else reach
    into.commit(
        {ROWS: fresh.where(F.col("height") < reach), WAITING: fresh.where(F.col("height") >= reach), BAD: bad},
        batch=(STREAM, batch),
        facts={"frontier": reach},
        overwrite=(WAITING,),
        expect=now["version"],
    )
    fresh.unpersist()


def follow_batch(headers: DataFrame, batch: int, into: Snapshots) -> None:
    """Commit a batch of headers (hash, prev_hash, bits) in any order, which may leave the committed chain below its tip.

    Heights come from the pointers. A branch that extends the tip, or has more
    work than what it would replace, is committed in one version that takes back
    the headers and rows above the split, what waits there and the frontier; any
    other branch changes nothing. The first batch begins the chain at the header
    whose pointer is zero. Headers that attach nowhere are dropped.
    """
    now = into.manifest()
    if batch <= now["streams"].get(HEADERS, -1):
        return
    spark = into.spark
    origin = spark.createDataFrame([("00" * 32, -1)], "hash string, height long")
    ours = into.read(HEADERS) if HEADERS in now["tables"] else None
    known = origin if ours is None else ours.select("hash", "height").unionByName(origin)
    placed = with_heights(headers, known).where("height is not null")
    if ours is not None:
        placed = placed.join(_there(ours, placed.select("hash")), "hash", "left_anti")
    placed = placed.select("height", "hash", "prev_hash", "bits").persist()
    taken, above = placed, None
    if ours is not None and placed.limit(1).count():
        offered = heaviest(placed)
        split, take, good = weighed(ours, offered)
        taken, above = (good.select(*placed.columns), split) if take else (placed.limit(0), None)
    facts = {} if above is None else {"frontier": min(now["facts"].get("frontier", 0), above + 1)}
    into.commit({HEADERS: taken}, batch=(HEADERS, batch), facts=facts, replace_above=above, expect=now["version"])
    placed.unpersist()
    del placed, taken
    sweep(spark)


def _there(ours: DataFrame, hashes: DataFrame) -> DataFrame:
    """Which hashes are there already. Of a small batch, they go to where ours lie, which then move nowhere."""
    few = hashes.limit(FEW + 1).count() <= FEW
    return ours.select("hash").join(F.broadcast(hashes) if few else hashes, "hash", "left_semi")


def ingest(spark: SparkSession, source: str, schema: StructType, into: Snapshots, checkpoint: str, valid: Column | None, files_each: int = 4, fmt: str = "parquet", shape: Callable[[DataFrame], DataFrame] | None = None, key: str = "height"):
    """Read all files of source that are new, in batches of so many, and commit them; return the finished query.

    valid: which rows are good; None for headers, which are followed by their work.
    """
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_each).load(source)
    stream = shape(stream) if shape else stream
    put = (lambda rows, i: follow_batch(rows, i, into)) if valid is None else (lambda rows, i: ingest_batch(rows, i, into, valid, key))
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def quarantined(into: Snapshots) -> DataFrame:
    """The rows that were bad when they came."""
    return into.read(BAD)


def committed(into: Snapshots) -> DataFrame:
    """The rows below the frontier."""
    return into.read(ROWS).where(F.col("height") < into.manifest()["facts"].get("frontier", 0))


def rewind(into: Snapshots, split: int) -> int:
    """Take back all above split: rows, what waits, and the frontier."""
    return into.truncate(split, facts={"frontier": split + 1})


def tumbling(rows: DataFrame, ts: str, seconds: int, value: Column) -> DataFrame:
    """(start, n, total) of windows of so many seconds. Works on streams, with a watermark set on ts, and on tables."""
    return rows.groupBy(F.window(ts, f"{seconds} seconds")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def throttled(rows: DataFrame, ts: str, seconds: int, key: str, order: str) -> DataFrame:
    """The first and last row's order of each key in each window."""
    return rows.groupBy(key, F.window(ts, f"{seconds} seconds")).agg(F.min(order).alias("first"), F.max(order).alias("last")).select(key, F.col("window.start").alias("start"), "first", "last")


def debounced(rows: DataFrame, ts: str, seconds: int, key: str, order: str) -> DataFrame:
    """The last row's order of each burst of a key: rows less than so many seconds apart."""
    return rows.groupBy(key, F.session_window(ts, f"{seconds} seconds")).agg(F.max(order).alias("last")).select(key, "last")


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the largest order of each key: later ones replace earlier ones."""
    return rows.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))
