"""Chains, indexes, checks, snapshots and streams on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import chain as C
from tallyweave.operators import index as I
from tallyweave.operators import validate as V
from tallyweave.plans.api import Ledger, block_range_to, page_bounds
from tallyweave.plans.snapshot import Snapshots
from tallyweave.streaming import ingest as T

EASY, HARD = 0x207FFFFF, 0x1D00FFFF


def headers(spark, names, bits=EASY, prev="root", first=0):
    rows, before = [], prev
    for i, name in enumerate(names):
        rows.append((first + i, name, before, bits))
        before = name
    return spark.createDataFrame(rows, "height long, hash string, prev_hash string, bits long")


def hashes(df):
    return [r.hash for r in df.orderBy("height").collect()]


def test_links_and_prefix(spark):
    h = headers(spark, "abcdef").withColumn("prev_hash", F.when(F.col("height") == 3, "x").otherwise(F.col("prev_hash")))
    assert [r.linked for r in C.with_link(h).orderBy("height").collect()] == [True, True, True, False, True, True]
    assert hashes(C.valid_prefix(h)) == ["a", "b", "c"]
    assert hashes(C.without_listed(headers(spark, "abc"), spark.createDataFrame([("b",)], "hash string"))) == ["a"]


@pytest.mark.parametrize(
    "names,bits,prev,expected",
    [
        (["X", "Y"], EASY, "b", "abXY"),  # longer than c
        (["X"], EASY, "b", "abc"),  # equal work keeps ours
        (["X"], HARD, "b", "abX"),  # shorter, but heavier
        (["X"], EASY, "c", "abcX"),  # an extension
        (["X", "Y"], EASY, "nowhere", "abc"),
    ],
)
def test_branches(spark, names, bits, prev, expected):
    ours = headers(spark, "abc")
    assert hashes(C.choose_branch(ours, headers(spark, names, bits, prev))) == list(expected)


def test_branch_is_cut_at_a_bad_header(spark):
    branch = headers(spark, "XYZ", prev="b").withColumn("prev_hash", F.when(F.col("hash") == "Z", "?").otherwise(F.col("prev_hash")))
    assert hashes(C.choose_branch(headers(spark, "abc"), branch)) == list("abXY")


def test_locator():
    assert C.locator_heights(0) == [0] and C.locator_heights(3) == [3, 2, 1, 0]
    got = C.locator_heights(100)
    assert got[:10] == list(range(100, 90, -1)) and got[10:] == [89, 85, 77, 61, 29, 0]


def test_frontier(spark):
    ranges = spark.createDataFrame([(0, 32), (64, 96), (32, 64), (128, 160)], "first long, end long")
    assert C.frontier(ranges).first().frontier == 96


def test_pack_by_budget(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([3, 3, 3, 11, 1, 9, 1])], "g string, o long, s long")
    assert [r.chunk for r in C.pack_by_budget(rows, "g", "o", "s", 10).orderBy("o").collect()] == [0, 0, 0, 1, 2, 2, 3]


def outputs(spark):
    return spark.createDataFrame([(1, 0, "s", 5, 0), (1, 1, "t", 6, 1), (2, 0, "s", 7, 2)], "tx long, vout long, script string, value long, output_index long")


def test_index(spark):
    ins = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (3, 9, 9)], "tx long, prev_tx long, prev_vout long")
    assert {(r.prev_tx, r.spends) for r in I.double_spends(ins).collect()} == {(1, 2)}
    assert [r.prev_tx for r in I.missing_prevouts(ins, outputs(spark)).collect()] == [9]
    assert {r.output_index for r in I.unspent(outputs(spark), ins).collect()} == {1, 2}
    d = {r.script: (r.script_id, r.first_output_index, r.last_output_index) for r in I.script_dictionary(outputs(spark)).collect()}
    assert d == {"s": (0, 0, 2), "t": (1, 1, 1)}
    assert {r.script for r in I.new_scripts(outputs(spark), spark.createDataFrame([("s",)], "script string")).collect()} == {"t"}
    assert I.resolve_prevouts(ins, outputs(spark)).where("output_index is null").count() == 1
    with pytest.raises(ValueError, match="double spend"):
        I.assert_none(I.double_spends(ins), "double spend")
    I.assert_none(I.double_spends(ins.limit(0)), "double spend")


def test_index_is_dense_over_buckets(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = I.with_output_index(rows, F.floor(F.col("k") / 64), ["k"])
    assert got.where("output_index <> k").count() == 0 and got.count() == 1000


def test_checks(spark):
    ok = spark.createDataFrame([(227931, "035b7a03aa"), (5, "")], "height long, script string")
    assert V.bad_coinbase_heights(ok).count() == 0
    assert V.bad_coinbase_heights(ok.withColumn("script", F.lit("00"))).count() == 1
    txs = spark.createDataFrame([(91842, "x"), (91722, "x"), (1, "y"), (2, "y")], "height long, txid string")
    hs = spark.createDataFrame(list(V.MAY_REPEAT), "height long, hash string")
    assert [r.txid for r in V.repeated_txids(txs, hs).collect()] == ["y"]
    leaves = spark.createDataFrame([(1, i, bytearray([i]) * 32) for i in range(3)] + [(2, i, bytearray([7]) * 32) for i in range(2)], "height long, tx_index int, txid binary")
    roots = {r.height: r for r in V.merkle_roots(leaves).collect()}
    assert not roots[1].mutated and roots[2].mutated
    told = spark.createDataFrame([(1, roots[1].root), (2, roots[2].root)], "height long, merkle_root string")
    assert [r.height for r in V.bad_merkle_roots(leaves, told).collect()] == [2]


def test_api(spark):
    assert block_range_to(5, 10) == (0, 6) and page_bounds(-3, float("nan")) == (0, 50) and page_bounds(2.9, 900) == (2, 50)
    tx = spark.createDataFrame([(0, i, f"{i:02x}" * 32, "00" * 32, [("51",)], [1, 2], 100) for i in range(3)], "height long, tx_index int, txid string, wtxid string, inputs array<struct<script:string>>, outputs array<int>, wire_size long")
    led = Ledger(spark.createDataFrame([(0, "aa" * 31 + "bb"), (1, "cc" * 32)], "height long, hash string"), spark.createDataFrame([(0, 3, 300)], "height long, tx_count long, wire_size long"), tx)
    assert led.tip().first().info is None and led.block(0).first().info.coinbase_script == "51"
    assert led.block("bb" + "aa" * 31).first().height == 0 and led.block(9).count() == 0
    assert [r.tx_index for r in led.block_txs(0, 1, 5).collect()] == [1, 2]
    assert led.tx("02" * 32).first().tx_index == 2 and led.blocks_from(0, 1).count() == 1
    with pytest.raises(ValueError):
        led.block(-1)


def rows(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("height"), F.lit("v").alias("x"))


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.commit({"a": rows(spark, 0, 5), "b": rows(spark, 0, 1)}, batch=1) == 1
    assert s.commit({"a": rows(spark, 0, 5)}, batch=1) == 1  # again: nothing
    rows(spark, 50, 60).write.parquet(f"{s.root}/data/a/crashed")
    assert s.commit({"a": rows(spark, 5, 9)}, batch=2) == 2
    assert s.read("a").count() == 9 and s.read("a", 1).count() == 5 and s.read("b").count() == 1
    s.truncate(6)
    s.commit({"a": rows(spark, 7, 8)})
    assert sorted(r.height for r in s.read("a").collect()) == list(range(8))
    assert s.vacuum() == 1 and s.versions() == [4] and s.read("a").count() == 8
    with pytest.raises(KeyError):
        s.read("c")


def test_ingest_out_of_order(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    ok = F.col("x") == "v"
    T.ingest_batch(rows(spark, 4, 8), 0, s, ok)
    assert T.committed(s).count() == 0
    T.ingest_batch(rows(spark, 0, 3).unionByName(rows(spark, 2, 3)), 1, s, ok)
    assert T.committed(s).count() == 3
    T.ingest_batch(rows(spark, 3, 4).unionByName(rows(spark, 9, 10).withColumn("x", F.lit("bad"))), 2, s, ok)
    T.ingest_batch(rows(spark, 3, 4), 2, s, ok)  # again: nothing
    assert sorted(r.height for r in T.committed(s).collect()) == list(range(8)) and s.read(T.BAD).count() == 1
    T.rewind(s, 5)
    T.ingest_batch(rows(spark, 6, 7), 3, s, ok)
    assert sorted(r.height for r in T.committed(s).collect()) == list(range(7))


def test_stream(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    for lo in (6, 0, 3):
        rows(spark, lo, lo + 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    T.ingest(spark, str(tmp_path / "in"), rows(spark, 0, 1).schema, s, str(tmp_path / "c"), F.col("x") == "v", files_each=1)
    assert T.committed(s).count() == 9
    rows(spark, 9, 12).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    T.ingest(spark, str(tmp_path / "in"), rows(spark, 0, 1).schema, s, str(tmp_path / "c"), F.col("x") == "v")
    assert T.committed(s).count() == 12
