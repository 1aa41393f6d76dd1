"""Surrogates, dictionaries, spenders and unspent outputs.

Outputs have (tx, vout, script, value), in the order of their chain; inputs
have (tx, prev_tx, prev_vout). All joins are equi-joins on those keys, left to
the optimizer's choice of strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import with_index, with_neighbours

#: Outputs of a script that are looked through at once.
SCRIPT_RANGE = 1 << 22


def with_output_index(outputs: DataFrame, bucket: Column, order: list, vout_order: list | None = None) -> DataFrame:
    """Outputs with output_index, the place of each in the whole chain; vout_order: also vout, the place in its transaction."""
    return with_index(outputs, "output_index", bucket, order, {"vout": (["tx"], vout_order)} if vout_order else None)


def first_output_index(txs: DataFrame, outputs: Column, bucket: Column, order: list) -> DataFrame:
    """Transactions with first_output_index: the outputs of all before."""
    from .prefix import with_running_sum

    return with_running_sum(txs, "first_output_index", outputs, bucket, order, inclusive=False)


def with_same_script_links(outputs: DataFrame, width: int = SCRIPT_RANGE) -> DataFrame:
    """Outputs with the index of the one before and after with the same script."""
    bucket = F.floor(F.col("output_index") / width)
    return with_neighbours(outputs, "script", "output_index", bucket, {"prev_same_script": "output_index"}, {"next_same_script": "output_index"})


def spent_by_next(outputs: DataFrame, width: int = SCRIPT_RANGE) -> DataFrame:
    """Inputs (tx, prev_tx, prev_vout) of a ledger where the next output of a script spends the one before."""
    bucket = F.floor(F.col("output_index") / width)
    found = with_neighbours(outputs.select("tx", "vout", "script", "output_index"), "script", "output_index", bucket, {}, {"spender": "tx"})
    return found.where("spender is not null").select(F.col("tx").alias("prev_tx"), F.col("vout").alias("prev_vout"), F.col("spender").alias("tx"))


def script_dictionary(outputs: DataFrame, bucket_size: int = 1 << 20) -> DataFrame:
    """(script, script_id, first_output_index, last_output_index, outputs): ids by first appearance."""
    seen = outputs.groupBy("script").agg(F.min("output_index").alias("first_output_index"), F.max("output_index").alias("last_output_index"), F.count("*").alias("outputs"))
    return with_index(seen, "script_id", F.floor(F.col("first_output_index") / bucket_size), ["first_output_index"])


def new_scripts(outputs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Scripts that the dictionary lacks, once each."""
    return outputs.select("script").distinct().join(dictionary.select("script"), "script", "left_anti")


def resolve_prevouts(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with output_index, script and value of what they spend; null where it isn't there."""
    keys = outputs.select(F.col("tx").alias("prev_tx"), F.col("vout").alias("prev_vout"), "output_index", "script", "value")
    return inputs.join(keys, ["prev_tx", "prev_vout"], "left")


def missing_prevouts(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    keys = outputs.select(F.col("tx").alias("prev_tx"), F.col("vout").alias("prev_vout"))
    return inputs.join(keys, ["prev_tx", "prev_vout"], "left_anti")


def spenders(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs with spender, the transaction that spends each, or null."""
    spends = inputs.select(F.col("prev_tx").alias("tx"), F.col("prev_vout").alias("vout"), F.col("tx").alias("spender"))
    return outputs.join(spends, ["tx", "vout"], "left")


def unspent(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    spends = inputs.select(F.col("prev_tx").alias("tx"), F.col("prev_vout").alias("vout"))
    return outputs.join(spends, ["tx", "vout"], "left_anti")


def spends_by_height(inputs: DataFrame, width: int) -> DataFrame:
    """(first, spends) of each range of so many heights: its inputs but those of coinbases, which spend nothing. inputs: (height, prev_tx), prev_tx null for a coinbase."""
    first = (F.floor(F.col("height") / width) * width).cast("long")
    return inputs.groupBy(first.alias("first")).agg(F.count("prev_tx").alias("spends"))


ZERO_ID = "00" * 32


def with_txids(inputs: DataFrame, txs: DataFrame) -> DataFrame:
    """Inputs (prev_tx, ...) with prev_txid, the id of the transaction that bears the surrogate; the zero id for a coinbase, whose prev_tx is null.

    txs: (tx, txid). A surrogate that no transaction bears gives null.
    """
    ids = txs.select(F.col("tx").alias("prev_tx"), F.col("txid").alias("prev_txid"))
    return inputs.join(ids, "prev_tx", "left").withColumn("prev_txid", F.when(F.col("prev_tx").isNull(), ZERO_ID).otherwise(F.col("prev_txid")))


def with_scripts(outputs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Outputs (script_id, ...) with the script that the dictionary (script_id, script) has for the surrogate; null if none."""
    return outputs.join(dictionary.select("script_id", "script"), "script_id", "left")


def wire_transactions(txs: DataFrame, inputs: DataFrame, outputs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Stored transactions with what their surrogates stand for: (tx, txid, inputs, outputs, witness).

    txs: (tx, txid); inputs: (tx, vin, prev_tx, prev_vout, witness), prev_tx null
    for a coinbase; outputs: (tx, vout, script_id, value). witness holds a stack
    for each input, and is empty if none of them has an item.
    """
    known = with_txids(inputs, txs)
    spent = F.struct("vin", "prev_txid", F.coalesce("prev_vout", F.lit(0xFFFFFFFF)).cast("long").alias("prev_vout"), "witness")
    ins = known.groupBy("tx").agg(F.array_sort(F.collect_list(spent)).alias("ins"))
    outs = with_scripts(outputs, dictionary).groupBy("tx").agg(F.array_sort(F.collect_list(F.struct("vout", "value", "script"))).alias("outs"))
    stacks = F.transform("ins", lambda x: F.coalesce(x["witness"], F.array().cast("array<string>")))
    return (
        txs.select("tx", "txid").join(ins, "tx").join(outs, "tx", "left")
        .select(
            "tx",
            "txid",
            F.transform("ins", lambda x: F.struct(x["prev_txid"].alias("prev_txid"), x["prev_vout"].alias("prev_vout"))).alias("inputs"),
            F.transform("outs", lambda x: F.struct(x["value"].alias("value"), x["script"].alias("script"))).alias("outputs"),
            F.when(F.exists(stacks, lambda s: F.size(s) > 0), stacks).otherwise(F.array().cast("array<array<string>>")).alias("witness"),
        )
    )


def region_bounds(regions: DataFrame, total: int | None = None) -> DataFrame:
    """(block, first, end): regions (block, first) end where the next block's begins, the last one at total."""
    bucket = F.floor(F.col("block") / (1 << 16))
    one = regions.select("block", "first", F.lit(0).alias("__all"))
    return with_neighbours(one, "__all", "block", bucket, {}, {"end": "first"}).select("block", "first", F.coalesce("end", F.lit(total)).alias("end"))


def double_spends(inputs: DataFrame) -> DataFrame:
    """(prev_tx, prev_vout, spends) of outputs that are spent more than once."""
    return inputs.groupBy("prev_tx", "prev_vout").agg(F.count("*").alias("spends")).where("spends > 1")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order: later ones replace earlier ones. Ties keep one of the largest."""
    best = F.max_by(F.struct(*rows.columns), order).alias("r")
    return rows.groupBy(F.col(key).alias("__key")).agg(best).select("r.*")


def assert_none(rows: DataFrame, what: str) -> None:
    """Raise ValueError if there are rows; the message shows a few."""
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")
