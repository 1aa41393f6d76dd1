"""Golden vectors and round trips of the native functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import binary as B
from tallyweave.functions import formats as FM
from tallyweave.functions import locks as L
from tallyweave.functions import scripts as S
from tallyweave.functions import work as W
from tallyweave.sources import wire

HEADER = "010000006fe28c0ab6f1b372c1a6a246ae63f74f931e8365e15a089c68d6190000000000982051fd1e4ba744bbbe680e1fee14677ba1a3c3540bf7b1cdb606e857233e0e61bc6649ffff001d01e36299"
COINBASE = "01000000010000000000000000000000000000000000000000000000000000000000000000ffffffff0704ffff001d0104ffffffff0100f2052a0100000043410496b538e853519c726a2c91e61ec11600ae1390813a627c66fb8be7947be63c52da7589379515d4e0a604f8141781e62294721166bf621e73a82cbf2342c858eeac00000000"
SEGWIT = "010000000001018ac60eb9575db5b2d987e29f301b5b819ea83a5c6579d282d189cc04b8e151ef0100000000ffffffff017ff7f105000000001976a91479091972186c449eb1ded22b78e40d009bdf008988ac0247304402203609e17b84f6a7d30c80bfa610b5b4542f32a8a0d5447a12fb1366d7f01cc44a0220573a954c4518331561406f90300e8f3358f51928d43c212a8caed02de67eebee0121025476c2e83188368da1ff3e292e7acafcdb3566bb0ad253f62fdec7cdb5de5dbb00000000"
LEGACY = "0100000001c997a5e56e104102fa209c6a852dd90660a20b2d9c352423edce25857fcd3704000000004847304402204e45e16932b8af514961a1d3a1a25fdf3f4f7732e9d624c6c61548ab5fb8cd410220181522ec8eca07de4860a4acdd12909d831cc56cbbac4622082221a8768d1d0901ffffffff0200ca9a3b00000000434104ae1a62fe09c5f51b13905f07f06b99a2f7159b2225f374cd378d71302fa28414e7aab37397f554a7df5f142c21c1b7303b8a0626f1baded5c72a704f7e6cd84cac00286bee0000000043410411db93e1dcdb8a016b49840f8c53bc1eb68a382e97b1482ecad7b148a6909a5cb2e0eaddfb84ccf9744464f82e160bfa9b8b64f9d4c03f999b8643f656b412a3ac00000000"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def sha256d(b):
    return hashlib.sha256(hashlib.sha256(b).digest()).digest()


def test_header(spark):
    raw = F.unhex(F.lit(HEADER))
    h = wire.decode_header(raw)
    got = one(spark, h, B.display_hash(B.sha256d(raw)), wire.encode_header(*[h[x] for x in ("version", "prev_hash", "merkle_root", "time", "bits", "nonce")]) == raw, wire.decode_header(F.unhex(F.lit(HEADER[2:]))))
    assert (got.c0.version, got.c0.bits, got.c0.nonce, got.c0.time) == (1, 0x1D00FFFF, 2573394689, 1231469665)
    assert got.c1 == "00000000839a8e6886ab5951d76f411475428afc90947ee320161bbf18eb6048" and got.c2 and got.c3 is None
    assert W.target(0x1D00FFFF) == W.EASIEST


@pytest.mark.parametrize("raw,shown", [(COINBASE, "0e3e2357e806b6cdb1f70b54c3a3a17b6714ee1f0e68bebb44a74b1efd512098"), (LEGACY, "f4184fc596403b9d638783cf57adfe4c75c605f6356fbc91338530e9831e9e16"), (SEGWIT, None)])
def test_transactions(spark, raw, shown):
    rows = spark.createDataFrame([(1, bytearray.fromhex(raw))], "k int, raw binary")
    tx = wire.decode_txs(rows, "raw", "k")
    got = tx.select("*", B.reversed_hex(F.col("txid")).alias("shown"), F.hex(wire.encode_tx(*[F.col(c) for c in ("version", "inputs", "outputs", "witness", "lock_time")])).alias("again")).first()
    assert got.error is None and got.again.lower() == raw and got.wire_size == len(raw) // 2
    if shown:
        assert got.shown == shown and got.txid == got.wtxid
    else:
        assert got.txid == "d29a8fefe564a7d70e7789401ec961b559eac74fe147e02e16274fee0af283eb"
        assert got.wtxid == "2f6494560c2886adc6ea5b9a0a2703ec0d115c9ffd49738bab2556821178d686"


def test_blocks_and_bad_bytes(spark):
    body = "03" + COINBASE + SEGWIT + LEGACY
    rows = spark.createDataFrame([("block", bytearray.fromhex(body)), ("short", bytearray.fromhex(body[:-2])), ("long", bytearray.fromhex(body + "00")), ("none", None)], "k string, raw binary")
    got = wire.decode_txs(rows, "raw", "k", counted=True).collect()
    assert [r.tx_index for r in got if r.k == "block"] == [0, 1, 2]
    assert all(r.error and r.txid is None for r in got if r.k != "block") and len(got) == 6


def test_frames():
    magic = bytes.fromhex("f9beb4d9")

    def frame(command, payload, check=None):
        return magic + command.ljust(12, b"\0") + len(payload).to_bytes(4, "little") + (check or sha256d(payload)[:4]) + payload

    stream = b"noise" + frame(b"headers", b"abc") + frame(b"tx", b"bad", b"\0\0\0\0") + frame(b"ping", b"") + frame(b"block", b"12345")[:-1]
    assert list(wire.frames(stream, magic)) == [("headers", b"abc"), ("ping", b"")]


@pytest.mark.parametrize("n,digits", [(0, ""), (1, "01"), (127, "7f"), (128, "8000"), (255, "ff00"), (256, "0001"), (-1, "81"), (-127, "ff"), (-128, "8080"), (227931, "5b7a03"), (500000, "20a107"), (65535, None), (16777216, None), (-300000, None), (1983702, None)])
def test_script_numbers(spark, n, digits):
    got = one(spark, B.script_num_hex(F.lit(n)), B.from_script_num(B.script_num_hex(F.lit(n))))
    assert got.c1 == n and (digits is None or got.c0 == digits)


@pytest.mark.parametrize("n", [0, 252, 253, 65535, 65536, 4_000_000])
def test_compact_sizes(spark, n):
    assert one(spark, B.from_compact_size(B.compact_size_hex(F.lit(n)))).c0 == n


@pytest.mark.parametrize("digits", ["fdfc00", "feffff0000", "ffffffffff00000000", "ff0100000001000000"])
def test_compact_sizes_that_are_refused(spark, digits):
    assert one(spark, B.from_compact_size(F.lit(digits))).c0 is None


def test_big_endian(spark):
    got = one(spark, B.big_endian_hex(F.lit(0x123456), 3), B.big_endian_hex(F.lit(1), 7), B.from_big_endian(F.lit("0000000102")))
    assert tuple(got) == ("123456", "00000000000001", 258)
    with pytest.raises(Exception, match="out of the range"):
        one(spark, B.big_endian_hex(F.lit(1 << 24), 3))


def test_merkle(spark):
    leaves = [bytes([i]) * 32 for i in range(7)]

    def root(level):
        while len(level) > 1:
            level = level + level[-1:] if len(level) % 2 else level
            level = [sha256d(level[i] + level[i + 1]) for i in range(0, len(level), 2)]
        return level[0]

    for n in range(8):
        column = F.array(*[F.unhex(F.lit(x.hex())) for x in leaves[:n]]).cast("array<binary>")
        got = one(spark, B.merkle_root(column), B.merkle_mutated(column))
        assert bytes(got.c0) == (root(leaves[:n]) if n else bytes(32)) and got.c1 is False
    twins = F.array(*[F.unhex(F.lit(x.hex())) for x in (leaves[0], leaves[1], leaves[2], leaves[2])])
    assert one(spark, B.merkle_mutated(twins)).c0 is True


def test_work_and_targets(spark):
    bits = [0x1D00FFFF, 0x1B0404CB, 0x02008000, 0]
    rows = spark.createDataFrame([(b,) for b in bits], "bits long")
    for r in rows.select("bits", W.target_hex(F.col("bits")).alias("t")).collect():
        assert int(r.t, 16) == W.target(r.bits)
    table = {r.bits: r for r in W.work_table(rows).collect()}
    assert table[0x1D00FFFF].work == 4295032833 and float(table[0x1B0404CB].difficulty) == 16307.420938 and table[0].work == 0
    got = one(spark, W.subsidy(F.lit(0)), W.subsidy(F.lit(210_000)), W.subsidy(F.lit(64 * 210_000)))
    assert tuple(got) == (5_000_000_000, 2_500_000_000, 0)


def test_locks(spark):
    values = [0, 1, 499_999_999, 500_000_000, 0xFFFFFFFF, 1 << 31, (1 << 22) | 7, 144, (0x3F << 16) | (0xFF << 23) | 5]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for r in rows.select("v", L.lock_time_value(L.lock_time(F.col("v"))).alias("a"), L.sequence_value(L.sequence(F.col("v"))).alias("b")).collect():
        assert r.a == r.v and r.b == r.v
    assert one(spark, L.format_lock_time(F.lit(1231006505))).c0 == "time 2009-01-03T18:15:05.000Z"
    assert one(spark, L.format_sequence(F.lit(0x80000001))).c0 == "disabled (raw: 0x80000001)"


def test_addresses():
    assert S.base58check_of(0, bytes.fromhex("62e907b15cbf27d5425399ebf6f0fb50ebb88f18")) == "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
    assert S.segwit_address_of("bc", 0, bytes.fromhex("751e76e8199196d454941c45d1b3a323f1433bd6")) == "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    assert S.segwit_address_of("bc", 1, bytes.fromhex("79be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798")) == "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"


def test_disassembly():
    assert S.disassembled(bytes.fromhex("76a914" + "ab" * 20 + "88ac")) == f"OP_DUP OP_HASH160 <{'ab' * 20}> OP_EQUALVERIFY OP_CHECKSIG"
    assert S.disassembled(bytes.fromhex("4c03aabbcc50")) == "OP_PUSHDATA1 <3b:aabbcc> OP_UNKNOWN(0x50)"


def test_inscriptions(spark):
    cases = {"6300036f72640101aa": True, "00" * 5 + "636f7264": False, "00" * 5 + "636f726400": True, "6f726463" + "00" * 5: False, "63": False}
    for item, expected in cases.items():
        assert one(spark, S.looks_like_inscription(F.array(F.array(F.lit(item))))).c0 is expected


def test_formats(spark):
    got = one(spark, FM.bytes_binary(F.lit(1536.0)), FM.bytes_decimal(F.lit(999)), FM.difficulty(F.lit(16307.42)), FM.duration(F.lit(90_061_000)), FM.duration(F.lit(-1)), FM.coins(F.lit(5_000_000_000)), FM.relative_time(F.lit(-90)), FM.bytes_binary(F.lit(float("nan"))))
    assert tuple(got) == ("1.5 KiB", "999 B", "16.31K", "1d1h1m1s", "0s", "BTC 50.00", "1 minute ago", "—")
    assert one(spark, FM.script_text(F.unhex(F.lit("41ff42")))).c0 == "A�B"
