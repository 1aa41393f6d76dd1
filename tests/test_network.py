"""Hosts, fragments, messages and the frame source."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import network as N
from tallyweave.plans.api import window_bounds
from tallyweave.sources import frames, messages
from tallyweave.sources.wire import framed


@pytest.mark.parametrize(
    "host,valid",
    [("1.2.3.4", True), ("1.2.3.256", False), ("1.2.3", False), ("::1", True), ("::", True), ("2001:db8::1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7", False), ("1::2::3", False), ("g::1", False), ("12345::", False), ("abc.onion", False), ("example.com", False), ("", False)],
)
def test_hosts(spark, host, valid):
    assert spark.range(1).select(N.valid_host(F.lit(host))).first()[0] is valid


@pytest.mark.parametrize("host", ["1.2.3.4", "::1", "2001:db8::1", "fe80:0:0:1::5", "1:2:3:4:5:6:7:8"])
def test_addresses(spark, host):
    digits = N.address_hex(F.lit(host))
    got = spark.range(1).select(digits.alias("d"), N.address_text(digits).alias("t")).first()
    packed = ipaddress.ip_address(f"::ffff:{host}" if "." in host else host)
    assert bytes.fromhex(got.d) == packed.packed
    assert ipaddress.ip_address(got.t if "." in got.t else got.t) == ipaddress.ip_address(host)


@pytest.mark.parametrize("text,kind", [("", "home"), ("#/block/12", "block.height"), ("#/block/-1", "home"), ("#/block/1.5", "home"), ("#/block/" + "ab" * 32, "block.hash"), ("#/tx/" + "ab" * 32, "tx"), ("#/tx/12", "home"), ("#/nothing/1", "home")])
def test_fragments(spark, text, kind):
    assert spark.range(1).select(N.fragment(F.lit(text)).alias("f")).first().f.kind == kind


def test_messages(spark):
    hashes = [f"{i:064x}" for i in range(300)]
    rows = spark.createDataFrame([(hashes,), ([],)], "h array<string>")
    raw = [f"{i:0160x}" for i in range(260)]
    got = rows.select("h", messages.inventory(messages.getdata_message(F.col("h"))).alias("i"), messages.getheaders_message(F.lit(70016), F.col("h"), F.lit("00" * 32)).alias("g")).collect()
    for r in got:
        assert [x.hash for x in r.i] == r.h and all(x.kind == messages.WITNESS_BLOCK for x in r.i)
        assert len(r.g) == 2 * (4 + (3 if len(r.h) > 252 else 1) + 32 * len(r.h) + 32)
    back = spark.createDataFrame([(raw,)], "r array<string>").select(messages.headers(messages.headers_message(F.col("r"))).alias("b"), messages.headers(F.lit("02" + "00" * 81)).alias("short")).first()
    assert back.b == raw and back.short is None
    v = bytes(4 + 8 + 8 + 8) + bytes(10) + b"\xff\xff\x01\x02\x03\x04" + (8333).to_bytes(2, "big") + bytes(26) + (7).to_bytes(8, "little")
    got = spark.createDataFrame([(v.hex(),)], "v string").select(messages.version_message(F.col("v")).alias("m")).first().m
    assert (got.to_host, got.to_port, got.nonce) == ("1.2.3.4", 8333, 7)


def test_frame_source(spark, tmp_path):
    frames.register(spark)
    magic = bytes.fromhex(frames.MAGIC)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0001").write_bytes(framed(magic, "tx", b"a") + b"\0" * 7 + framed(magic, "ping", b"bb"))
    (tmp_path / "in" / "0002").write_bytes(framed(magic, "tx", b"c")[:-1])
    path = str(tmp_path / "in")
    assert [(r.file, r.position, r.command, bytes(r.payload)) for r in spark.read.format("ledger_frames").load(path).collect()] == [("0001", 0, "tx", b"a"), ("0001", 1, "ping", b"bb")]

    def run():
        out = spark.readStream.format("ledger_frames").load(path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        out.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2
    (tmp_path / "in" / "0003").write_bytes(framed(magic, "tx", b"d"))
    assert run() == 3


def test_window_bounds():
    assert window_bounds(0, 12, 1000) == (0, 52) and window_bounds(70, 12, 1000) == (60, 52) and window_bounds(990, 12, 1000) == (948, 52) and window_bounds(0, 12, 20) == (0, 20)


def test_genesis(spark):
    from tallyweave.functions.binary import reversed_hex
    from tallyweave.sources import genesis

    assert len(genesis.BLOCK) == 2 * 285
    first = genesis.header(spark).select("*", reversed_hex(F.col("hash")).alias("shown")).first()
    assert first.shown == genesis.HASH and first.prev_hash == "00" * 32
    assert genesis.transactions(spark).first().txid == first.merkle_root
    one = spark.createDataFrame([(1, first.hash)], "height long, prev_hash string")
    assert genesis.seeded(one).count() == 2 and genesis.seeded(genesis.seeded(one)).count() == 2
