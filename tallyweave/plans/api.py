"""The read queries over a ledger: pages, lookups, the tip, blocks and transactions.

A page reads its own rows and not the table: a tip or a hash is first looked up
among the headers, for its height alone, and then all tables are filtered by
heights as numbers, which reaches their scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import from_display_hash, reversed_hex

MOST_BLOCKS, MOST_TXS = 210, 50


def page_bounds(start: float | None, take: float | None) -> tuple[int, int]:
    """First place and size of a page of transactions: not finite is the default, negative starts are 0, parts are cut."""

    def whole(x: float | None, default: int) -> int:
        return int(x) if x is not None and math.isfinite(x) else default

    return max(0, whole(start, 0)), max(0, min(whole(take, MOST_TXS), MOST_TXS))


def block_range_from(start: int, take: int) -> tuple[int, int]:
    """[first, end) of a page that goes up."""
    if start < 0:
        raise ValueError("heights are not negative")
    return start, start + max(0, min(take, MOST_BLOCKS))


def block_range_to(to: int, take: int) -> tuple[int, int]:
    """[first, end) of a page that ends at a height."""
    if to < 0:
        raise ValueError("heights are not negative")
    take = max(0, min(take, MOST_BLOCKS))
    return max(0, to - take + 1), to + 1


class Ledger:
    """headers (height, hash, ...; hash in wire order as hex), blocks (height, tx_count, wire_size), txs (height, tx_index, txid, ...).

    bodies: blocks and txs of the heights from one to before another, where the
    tables have a way to them that is better than a filter on height.
    """

    def __init__(self, headers: DataFrame, blocks: DataFrame, txs: DataFrame, bodies: Callable[[int, int], tuple[DataFrame, DataFrame]] | None = None):
        self.headers, self.blocks, self.txs = headers, blocks, txs
        self._bodies = bodies or (lambda first, end: (blocks.where(_between(first, end)), txs.where(_between(first, end))))

    def _blocks(self, first: int, end: int) -> DataFrame:
        """Headers from first to before end with info, null where the body isn't there yet."""
        blocks, txs = self._bodies(first, end)
        cb = F.get(F.col("inputs"), F.lit(0))["script"] if "inputs" in txs.columns else F.lit(None).cast("string")
        coinbases = txs.where("tx_index = 0").select("height", cb.alias("coinbase"), F.lit(True).alias("__cb"))
        joined = self.headers.where(_between(first, end)).join(blocks, "height", "left").join(coinbases, "height", "left")
        info = F.struct("wire_size", "tx_count", F.col("coinbase").alias("coinbase_script"))
        return joined.select(*self.headers.columns, F.when(F.col("tx_count").isNotNull() & F.col("__cb"), info).alias("info"))

    def blocks_from(self, start: int, take: int = MOST_BLOCKS) -> DataFrame:
        return self._blocks(*block_range_from(start, take)).orderBy("height")

    def blocks_to(self, to: int, take: int = MOST_BLOCKS) -> DataFrame:
        return self._blocks(*block_range_to(to, take)).orderBy("height")

    def tip(self) -> DataFrame:
        top = self.headers.agg(F.max("height")).first()[0]
        return self._blocks(*(0, 0) if top is None else (top, top + 1))

    def _height(self, block: int | str) -> int | None:
        """The height of a block named by it or by its hash as displayed; None for an unknown hash."""
        if isinstance(block, str) and len(block) == 64:
            wire = bytes.fromhex(block)[::-1].hex()
            return self.headers.where(F.col("hash") == wire).agg(F.max("height")).first()[0]
        height = int(block)
        if height < 0:
            raise ValueError("heights are not negative")
        return height

    def block(self, block: int | str) -> DataFrame:
        """The block of a height, or of a hash as displayed."""
        height = self._height(block)
        return self._blocks(*(0, 0) if height is None else (height, height + 1))

    def block_txs(self, block: int | str, start: float | None = 0, take: float | None = MOST_TXS) -> DataFrame:
        """txid, wtxid (as displayed), counts and size of a page of a block's transactions."""
        (first, n), height = page_bounds(start, take), self._height(block)
        _, txs = self._bodies(*(0, 0) if height is None else (height, height + 1))
        rows = txs.where((F.col("tx_index") >= first) & (F.col("tx_index") < first + n)).orderBy("tx_index")
        return rows.select("tx_index", reversed_hex(F.col("txid")).alias("txid"), reversed_hex(F.col("wtxid")).alias("wtxid"), F.size("inputs").alias("inputs"), F.size("outputs").alias("outputs"), "wire_size")

    def tx(self, txid: str) -> DataFrame:
        """The transaction of an id as displayed; of several, the newest."""
        wire = bytes.fromhex(txid)[::-1].hex()
        return self.txs.where(F.col("txid") == wire).orderBy(F.desc("height"), F.desc("tx_index")).limit(1)


def _between(first: int, end: int) -> Column:
    return (F.col("height") >= first) & (F.col("height") < end)


def parse_block_key(key: Column) -> Column:
    """STRUCT<height, hash>: 64 characters are a hash as displayed, else a height."""
    is_hash = F.length(key) == 64
    return F.struct(F.when(~is_hash, F.try_to_number(key, F.lit("9999999999")).cast("long")).alias("height"), F.when(is_hash, F.lower(F.hex(from_display_hash(key)))).alias("hash"))


def window_bounds(position: int, visible: int, total: int, page: int = 32, overscan: int = 4) -> tuple[int, int]:
    """First row and number of rows of a list that is kept ready around a position: they change once a page."""
    take = min(total, visible + page + 2 * overscan)
    return max(0, min(total - take, position // page * page - overscan)), take
