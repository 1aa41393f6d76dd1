"""Consensus checks as tables of violations: an empty result means that the rule holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import height_push_hex, merkle_fold, to_hex
from .prefix import with_rank

#: Levels of a Merkle tree that are folded in one row.
LEVELS = 10

# From this height a coinbase must begin with its height, and the two blocks before it whose
# coinbase transactions may repeat earlier ones (height, hash as displayed).
COINBASE_HEIGHT_FROM = 227_931
MAY_REPEAT = (
    (91_842, "00000000000a4d0a398161ffc163c503763b1f4360639393e0e4c8e300e0caec"),
    (91_880, "00000000000743f190a18c5577a3c2d2a1f610ae9601ac046a38084ccb7cd721"),
)


def bad_coinbase_heights(coinbases: DataFrame) -> DataFrame:
    """Rows (height, script as hex) whose script doesn't begin with the push of the height, where it must."""
    return coinbases.where((F.col("height") >= COINBASE_HEIGHT_FROM) & ~F.coalesce(F.col("script").startswith(height_push_hex(F.col("height"))), F.lit(False)))


def repeated_txids(txs: DataFrame, headers: DataFrame) -> DataFrame:
    """(txid, txs) of ids borne by several transactions, those of the two excepted blocks left out."""
    spark = txs.sparkSession
    excepted = spark.createDataFrame(list(MAY_REPEAT), "height long, hash string")
    free = headers.join(F.broadcast(excepted), ["height", "hash"], "left_semi").select("height")
    return txs.join(free, "height", "left_anti").groupBy("txid").agg(F.count("*").alias("txs")).where("txs > 1")


def merkle_roots(txs: DataFrame, block: str = "height") -> DataFrame:
    """(block, root as hex in wire order, mutated, txs) over (block, tx_index, txid BINARY).

    Parts of the tree of 2^LEVELS leaves are folded, each in a row, then parts of
    what they give: so a block of any size takes a few rounds, and no row has
    more than that many hashes.
    """
    fan = 1 << LEVELS
    nodes = with_rank(txs.select(block, "tx_index", F.col("txid").alias("__node")), "__i", block, "tx_index").select(block, "__i", "__node", F.lit(False).alias("__bad"))
    sizes = nodes.groupBy(F.col(block).alias("__of")).agg(F.count("*").alias("txs"))
    most = sizes.agg(F.max("txs")).first()[0] or 0
    nodes = nodes.join(sizes, F.col(block).eqNullSafe(F.col("__of"))).drop("__of").withColumn("__n", F.col("txs"))
    while True:
        held = nodes.groupBy(block, "txs", "__n", F.floor(F.col("__i") / fan).alias("__at")).agg(F.array_sort(F.collect_list(F.struct("__i", "__node"))).alias("l"), F.max("__bad").alias("__bad"))
        alone = F.col("__n") <= fan
        levels = F.when(alone, F.ceil(F.log2(F.col("__n"))).cast("int")).otherwise(F.lit(LEVELS))
        top = merkle_fold(F.transform("l", lambda x: x["__node"]), levels, alone)
        nodes = held.withColumn("t", top).select(block, "txs", F.col("__at").alias("__i"), F.ceil(F.col("__n") / fan).alias("__n"), F.col("t.node").alias("__node"), (F.col("__bad") | F.col("t.bad")).alias("__bad"))
        most = -(-most // fan)
        if most <= 1:
            return nodes.select(block, to_hex(F.col("__node")).alias("root"), F.col("__bad").alias("mutated"), "txs")


def bad_merkle_roots(txs: DataFrame, headers: DataFrame) -> DataFrame:
    """Blocks whose header (height, merkle_root as hex) has another root, or whose tree has equal siblings."""
    return headers.join(merkle_roots(txs), "height").where("merkle_root <> root or mutated").select("height", "merkle_root", "root", "mutated")
