"""Heights from pointers in rounds of fewer and fewer links."""

import os
import random

import pytest

from tallyweave.operators import chain as C
from tallyweave.plans import shared

HEADER = "hash string, prev_hash string, bits long"


def forest(n, seed):
    """A chain with branches, twigs of their own, a circle, one that points at itself, and headers that attach nowhere."""
    r = random.Random(seed)
    up = {f"h{i}": f"h{i - 1}" if i else "root" for i in range(n)}
    up |= {f"b{i}": f"b{i - 1}" if i % 7 else f"h{r.randrange(n)}" for i in range(n // 3)}
    up |= {f"c{i}": f"c{(i + 1) % 9}" for i in range(9)} | {"d0": "c3", "d1": "d0", "self": "self", "e0": "nowhere", "e1": "e0", "f0": None}
    return up


def by_hand(up, known):
    out = {}
    for h in up:
        at, far, seen = h, 0, set()
        while at in up and at not in seen:
            seen.add(at)
            at, far = up[at], far + 1
        out[h] = known[at] + far if at in known and at not in up else None
    return out


@pytest.mark.parametrize("rest", [25, 1 << 16])
def test_heights_of_a_forest(spark, monkeypatch, rest):
    monkeypatch.setattr(C, "REST", rest)
    up = forest(90, rest)
    rows = [(h, p, 7) for h, p in up.items()]
    random.Random(1).shuffle(rows)
    known = {"root": 9, "other": 4}
    got = C.with_heights(spark.createDataFrame(rows + rows[:5], HEADER), spark.createDataFrame(list(known.items()), "hash string, height long"))
    assert got.columns == ["hash", "prev_hash", "bits", "height"]
    found = got.collect()
    assert len(found) == len(rows) + 5 and {r.hash: r.height for r in found} == by_hand(up, known)


def test_pointers_keep_no_round_on_disk(spark, monkeypatch):
    """What is left of the rounds is a few rows for each header; each round's links were kept before."""
    monkeypatch.setattr(C, "REST", 50)
    made = len(shared._MADE)
    rows = spark.range(400).selectExpr("concat('h', id) hash", "concat('h', id - 1) prev_hash")
    assert C.with_heights(rows, spark.createDataFrame([("h-1", -1)], "hash string, height long")).where("substr(hash, 2) <> height").count() == 0
    folder = shared._MADE[made].removeprefix("file://")
    assert not [x for x in os.listdir(folder) if x.startswith(("live", "out", "links")) and x != max((y for y in os.listdir(folder) if y.startswith("live")), key=lambda y: int(y[5:]))]


def test_hashes_that_share_a_number_are_followed_by_themselves(spark, monkeypatch):
    """All are said to clash."""
    real = C.stored
    monkeypatch.setattr(C, "stored", lambda rows, to: real(rows.selectExpr("id", "up", "true clash", "far") if "clash" in rows.columns else rows, to))
    rows = [(f"h{i}", f"h{i - 1}") for i in range(40)]
    got = C.with_heights(spark.createDataFrame(rows, "hash string, prev_hash string"), spark.createDataFrame([("h-1", 0)], "hash string, height long"))
    assert sorted(r.height for r in got.collect()) == list(range(1, 41))
