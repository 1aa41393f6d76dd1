"""The first block of the main network, which no peer needs to send."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wire import HEADER_BYTES, decode_header, decode_txs

# Fixed value: the block's 285 bytes (header, count, coinbase transaction).
BLOCK = (
    "0100000000000000000000000000000000000000000000000000000000000000000000003ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a29ab5f49ffff001d1dac2b7c"
    "01"
    "01000000010000000000000000000000000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054696d65732030332f4a616e2f32303039204368616e63656c6c6f72"
    "206f6e206272696e6b206f66207365636f6e64206261696c6f757420666f722062616e6b73ffffffff0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61"
    "deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5fac00000000"
)
HASH = "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"


def _raw(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("height"), F.unhex(F.lit(BLOCK)).alias("raw"))


def header(spark: SparkSession) -> DataFrame:
    """(height, version, prev_hash, ...) of height 0."""
    return _raw(spark).select("height", decode_header(F.substring("raw", 1, HEADER_BYTES)).alias("h")).select("height", "h.*")


def transactions(spark: SparkSession) -> DataFrame:
    """The block's one transaction, as decode_txs gives it."""
    body = _raw(spark).select("height", F.expr(f"substring(raw, {HEADER_BYTES + 1})").alias("raw"))
    return decode_txs(body, "raw", "height", counted=True)


def seeded(headers: DataFrame) -> DataFrame:
    """headers (height and some of a header's columns) with height 0 if it is missing."""
    first = header(headers.sparkSession).join(headers.where("height = 0").select("height"), "height", "left_anti")
    return headers.unionByName(first.select(*headers.columns))
