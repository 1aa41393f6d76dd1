"""Queries that take their whole tables, against brute force on small fixtures."""

import datetime
import hashlib
from collections import Counter

import pytest

from tallyweave.queries import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def sha256d(x):
    return hashlib.sha256(hashlib.sha256(x).digest()).digest()


def brute_merkle(level):
    bad = False
    while len(level) > 1:
        bad |= any(a == b for a, b in zip(level[::2], level[1::2]))
        level = [sha256d(a + b) for a, b in zip(level[::2], level[1::2] + level[-1:])]
    return level[0].hex(), bad


def test_merkle_of_all_documents(spark, tables):
    """Source a has its equal siblings at ids 6 and 7 only, beyond the first five; source b none."""
    texts = {i: f"text {i - (i == 7)}" for i in range(45)}
    rows = [(i, "a", t) for i, t in texts.items()] + [(100 + i, "b", f"other {i}") for i in range(33)]
    at = tables(documents=(rows, "doc_id long, source string, text string"))
    want = {s: brute_merkle([sha256d(t.encode()) for _, own, t in rows if own == s]) for s in "ab"}
    roots = {r.source: r.root for r in QUERIES["merkle_root_by_source"](spark, at).collect()}
    flags = {r.source: r.mutated for r in QUERIES["merkle_mutation_flag"](spark, at).collect()}
    assert roots == {s: w[0] for s, w in want.items()} and flags == {s: w[1] for s, w in want.items()} == {"a": True, "b": False}


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, props string"


def events(n):
    return [(i, datetime.datetime(2024, 1, 1), i % 7, ("view", "error")[i % 2], f'{{"k": {i * i}}}') for i in range(n)]


def test_format_coins_of_all_orders(spark, tables):
    rows = [(k, datetime.datetime(2020, 1 + k % 12, 1 + k % 28)) for k in (1, 2, 3, 7, 999, 1000, 4_000_001, 5_999_999)]
    got = {r.o_orderkey: tuple(r)[1:] for r in QUERIES["format_coins"](spark, tables(orders=(rows, "o_orderkey long, o_orderdate timestamp"))).collect()}
    assert got == {k: (f"BTC {k // 4:,}.{k % 4 * 25:02d}", f"{k:,}", f"0x{k:08x}", f"{d.month}/{d.day}/{d.year}", min(k / 4_000_000, 1.0)) for k, d in rows}


def test_relative_time_of_all_events(spark, tables):
    units = (("year", 31_556_952), ("month", 2_419_200), ("week", 604_800), ("day", 86_400), ("hour", 3600), ("minute", 60), ("second", 1))

    def shown(i):
        s = (i - 300) * abs(i - 300)
        unit, size = next(((u, z) for u, z in units if abs(s) >= z), (None, 1))
        n = (2 * s + size) // (2 * size)
        text = f"{abs(n)} {unit}{'' if abs(n) == 1 else 's'}"
        return "now" if unit is None else f"{text} ago" if n < 0 else f"in {text}"

    rows = events(2400) + [(3_000_000, *events(1)[0][1:])]
    got = {r.event_id: r.shown for r in QUERIES["relative_time"](spark, tables(events=(rows, EVENTS))).collect()}
    assert got == {r[0]: shown(r[0]) for r in rows}


def test_frames_of_all_events(spark, tables):
    rows = events(1203)
    got = sorted(map(tuple, QUERIES["frame_source"](spark, tables(events=(rows, EVENTS))).collect()))
    assert got == [(i, kind, hashlib.sha256(props.encode()).hexdigest()) for i, _, _, kind, props in rows]


def test_parse_all_block_keys(spark, tables):
    rows = events(700)
    got = sorted(map(tuple, QUERIES["parse_block_keys"](spark, tables(events=(rows, EVENTS))).collect()))
    digests = {i: sha256d(f"{i}|{kind}|{user}".encode()) for i, _, user, kind, _ in rows}
    assert got == sorted((d[::-1].hex(), None, d.hex()) if i % 3 == 0 else (str(i), i, None) for i, d in digests.items())


def test_headers_of_a_busy_peer(spark, tables):
    """Peer 3 has more headers than a message may hold."""
    rows = [(i, t, 3 if i % 10 else i % 7 or None, kind, props) for i, t, _, kind, props in events(5003)]
    got = {r.peer: (r.headers, r.same) for r in QUERIES["headers_messages"](spark, tables(events=(rows, EVENTS))).collect()}
    assert got == {peer: (n, True) for peer, n in Counter(r[2] for r in rows).items()} and got[3][0] > 4000
