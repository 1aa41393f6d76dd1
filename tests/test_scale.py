"""Operators that cut their work into ranges, against plain versions, with ranges small enough to be many."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import chain as C
from tallyweave.operators import index as I
from tallyweave.operators import validate as V
from tallyweave.operators.prefix import with_rank
from tallyweave.plans.snapshot import Conflict, Snapshots
from tallyweave.sources import records, wire
from tallyweave.streaming import ingest as T

EASY, HARD = 0x207FFFFF, 0x1D00FFFF


def test_packing_over_ranges(spark):
    rng, rows = random.Random(1), []
    for group, n in (("a", 300), ("b", 1), (None, 90), ("c", 40)):
        order = sorted(rng.sample(range(2000), n))
        rows += [(group, o, rng.choice([0, 1, 5, 9, 30, 200, None])) for o in order]
    want, state = {}, {}
    for group, o, size in rows:
        chunk, fill = state.get(group, (-1, 0))
        new = chunk < 0 or fill + (size or 0) > 100
        state[group] = (chunk + new, (size or 0) if new else fill + (size or 0))
        want[group, o] = state[group][0]
    given = spark.createDataFrame(rows, "g string, o long, s long").repartition(3)
    for width in (7, 64, 1 << 16):
        assert {(r.g, r.o): r.chunk for r in C.pack_by_budget(given, "g", "o", "s", 100, width).collect()} == want


def test_a_script_in_very_many_outputs(spark):
    rng = random.Random(2)
    scripts = [rng.choice(["hot", "hot", "hot", "x", "y", f"s{i}"]) for i in range(400)]
    rows = spark.createDataFrame([(i // 3, i % 3, s, i) for i, s in enumerate(scripts)], "tx long, vout long, script string, output_index long").repartition(5)
    want = {}
    for s in set(scripts):
        own = [i for i, x in enumerate(scripts) if x == s]
        want |= {i: (a, b) for i, a, b in zip(own, [None, *own[:-1]], [*own[1:], None])}
    for width in (1, 10, 1 << 22):
        assert {r.output_index: (r.prev_same_script, r.next_same_script) for r in I.with_same_script_links(rows, width).collect()} == want
        spent = {(r.prev_tx * 3 + r.prev_vout, r.tx) for r in I.spent_by_next(rows, width).collect()}
        assert spent == {(i, b // 3) for i, (_, b) in want.items() if b is not None}


def test_ranks_of_a_large_group(spark):
    rows = spark.createDataFrame([("g" if i % 4 else None, i * i) for i in range(200)], "g string, o long")
    got = {r.o: r.r for r in with_rank(rows, "r", "g", "o", 1000).collect()}
    for group in ("g", None):
        own = [i * i for i in range(200) if ("g" if i % 4 else None) == group]
        assert [got[o] for o in own] == list(range(len(own)))


def test_turns_over_gaps(spark):
    rows = spark.createDataFrame([(i * i,) for i in range(50)], "o long")
    assert [r.slot for r in C.round_robin(rows, 6, "o", 100).orderBy("o").collect()] == [i % 6 for i in range(50)]


def test_trees_of_many_parts(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(V, "LEVELS", 2)
    sha = lambda x: hashlib.sha256(hashlib.sha256(x).digest()).digest()
    rows, want = [], {}
    for block, n in enumerate((1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 64, 65)):
        level = [sha(f"{block}.{i // 2 if block == 7 and i // 2 == 5 else i / 2}".encode()) for i in range(n)]
        rows += [(block, 3 * i, bytearray(x)) for i, x in enumerate(level)]
        bad = False
        while len(level) > 1:
            bad |= any(a == b for a, b in zip(level[::2], level[1::2]))
            level = [sha(a + b) for a, b in zip(level[::2], level[1::2] + level[-1:])]
        want[block] = (level[0].hex(), bad, n)
    txs = spark.createDataFrame(rows, "height long, tx_index int, txid binary")
    assert {r.height: (r.root, r.mutated, r.txs) for r in V.merkle_roots(txs).collect()} == want
    assert V.merkle_roots(txs.limit(0)).count() == 0


def links(names, prev, bits=EASY):
    return [(n, p, bits) for n, p in zip(names, [prev, *names[:-1]])]


HEADER = "hash string, prev_hash string, bits long"


def test_heights_from_pointers(spark):
    names = [f"h{i}" for i in range(100)]
    rows = links(names, "root") + links(["x", "y"], "h40") + links(["lost"], "nowhere") + [("c1", "c2", EASY), ("c2", "c1", EASY)]
    random.Random(3).shuffle(rows)
    got = {r.hash: r.height for r in C.with_heights(spark.createDataFrame(rows + rows[:3], HEADER).distinct(), spark.createDataFrame([("root", 9)], "hash string, height long")).collect()}
    assert got == {n: 10 + i for i, n in enumerate(names)} | {"x": 51, "y": 52, "lost": None, "c1": None, "c2": None}


def test_headers_that_leave_the_chain(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path / "s"))
    zero = "00" * 32

    def follow(batch, rows):
        T.follow_batch(spark.createDataFrame(rows, HEADER), batch, into)
        return "".join(r.hash for r in into.read(T.HEADERS).orderBy("height").collect())

    assert follow(0, links("cba"[::-1], zero)) == "abc"
    assert follow(0, links("zz", "c")) == "abc"  # a batch that comes twice
    assert follow(1, links("d", "c") + links("q", "nowhere")) == "abcd"
    assert follow(2, links("XY", "b")) == "abcd"  # equal work
    assert follow(3, links("STU", "b") + links("V", "S")) == "abSTU"  # the longest of two branches
    assert follow(4, links("H", "a", HARD)) == "aH"
    assert follow(5, links("HS", "a")) == "aHS"  # what is known already, and one more
    assert [r.height for r in into.read(T.HEADERS).orderBy("height").collect()] == [0, 1, 2]


def test_bodies_go_back_with_the_headers(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path / "s"))
    T.follow_batch(spark.createDataFrame(links("abcd", "00" * 32), HEADER), 0, into)
    bodies = spark.range(4).select(F.col("id").alias("height"), F.lit("old").alias("x"))
    T.ingest_batch(bodies, 0, into, F.lit(True))
    T.follow_batch(spark.createDataFrame(links("XYZ", "b"), HEADER), 1, into)
    assert T.committed(into).count() == 2 and into.manifest()["facts"]["frontier"] == 2
    T.ingest_batch(bodies.withColumn("x", F.lit("new")), 1, into, F.lit(True))
    assert {(r.height, r.x) for r in T.committed(into).collect()} == {(0, "old"), (1, "old"), (2, "new"), (3, "new")}


def test_two_writers(spark, tmp_path):
    """Neither loses the other's commit, and one that was to follow a certain version fails."""
    one, two = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(i,)], "height long")
    one.commit({"t": row(0)})
    publish, done = one._publish, []

    def late(manifest):
        if not done:
            done.append(two.commit({"t": row(1)}, batch=f"other {manifest['version']}"))  # gets in between
        return publish(manifest)

    one._publish = late
    assert one.commit({"t": row(2)}) == 3
    assert sorted(r.height for r in one.read("t").collect()) == [0, 1, 2] and one.versions() == [1, 2, 3]
    done.clear()
    with pytest.raises(Conflict):
        one.commit({"t": row(3)}, expect=3)
    assert two.commit({"t": row(9)}, batch="other 4") == 4  # once


def test_compaction(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    for i in range(5):
        s.commit({"t": spark.range(i * 10, i * 10 + 10).withColumnRenamed("id", "height")}, batch=("stream", i))
    assert s.commit({"t": spark.range(5).withColumnRenamed("id", "height")}, batch=("stream", 3)) == 5
    s.truncate(33)
    s.compact("t")
    assert len(s.manifest()["tables"]["t"]["parts"]) == 1 and s.manifest()["streams"] == {"stream": 4}
    assert sorted(r.height for r in s.read("t").collect()) == list(range(34)) and s.vacuum() == 5


def test_record_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [bytes([i]) * 32 for i in range(50)]
    (tmp_path / "in" / "a").write_bytes(b"".join(rows[:30]) + b"torn")
    (tmp_path / "in" / "b").write_bytes(b"".join(rows[30:]))
    (tmp_path / "in" / "c").write_bytes(b"")
    records.register(spark)
    got = spark.read.format("ledger_records").option("rangeBytes", 100).load(str(tmp_path / "in"))
    assert [bytes(r.record) for r in got.orderBy("file", "position").collect()] == rows and got.rdd.getNumPartitions() > 10
    assert spark.read.format("ledger_records").load(str(tmp_path / "in" / "c")).count() == 0


def test_frames_in_pieces(monkeypatch):
    """Whatever is read at a time, the messages are the same, and noise that looks like a long message hides none."""
    import io

    magic, rng = bytes.fromhex("f9beb4d9"), random.Random(5)
    want = [(f"c{i}", rng.randbytes(rng.choice([0, 3, 200, 5000])) + magic * (i % 3 == 0)) for i in range(40)]
    data = b"".join(rng.choice([b"", magic[:2], magic, magic + b"x" * 12 + b"\xff\xff\xff\x00", rng.randbytes(50)]) + wire.framed(magic, c, p) for c, p in want)
    data += wire.framed(magic, "cut", b"abc")[:-1]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(wire, "READ_BYTES", size)
        assert list(wire.frames_in(io.BytesIO(data).read, magic)) == want


def test_requests(spark):
    peers = spark.createDataFrame([("a", 0), ("b", 250), ("c", 225)], "peer string, in_flight long")
    wanted = spark.range(100).select((F.col("id") * 3).alias("height"))
    got = C.requests(wanted, peers, batch=16, most=256)
    by_message = {m: sorted(r.height for r in got.collect() if r.message == m) for m in range(7)}
    assert by_message == {m: [3 * i for i in range(16 * m, min(100, 16 * m + 16))] for m in range(7)}
    assert {(r.message, r.peer) for r in got.collect()} == {(0, "a"), (1, "c")} | {(m, "a") for m in range(2, 7)}
    assert C.spare_room(peers).first().spare == 256 + 6 + 31
