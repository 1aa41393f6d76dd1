"""Blocks whose hashes clash, as some of a large corpus do."""

import numpy as np
import pytest

from tallyweave.llm import bwt

SIZE = 200


def by_hand(texts):
    windows = [t[i : i + SIZE] for t in texts for i in range(len(t) - SIZE + 1)]
    count = {w: 0 for w in windows}
    for w in windows:
        count[w] += 1
    return [[count[t[i : i + SIZE]] > 1 for i in range(max(0, len(t) - SIZE + 1))] for t in texts]


@pytest.mark.parametrize("shard", [600, 1 << 16])
@pytest.mark.parametrize("bits", [0x0, 0xFFFF, 0x3 << 62])
def test_repeats_when_keys_of_blocks_clash(monkeypatch, shard, bits):
    """Within a shard and between shards, all keys or most of them the same."""

    class Clashing(bwt.Rolling):
        def every(self, size):
            return super().every(size) & np.uint64(bits)

    monkeypatch.setattr(bwt, "Rolling", Clashing)
    monkeypatch.setattr(bwt, "SHARD_BYTES", shard)
    r = np.random.default_rng(5)
    a, b = (bytes(r.integers(0, 256, 500, dtype=np.uint8)) for _ in range(2))
    texts = [a, b[:330], a[40:340] + b[100:450], b"", bytes(500), b"\0" * 199, a[200:420]]
    assert [m.tolist() for m in bwt.repeated(texts, SIZE)] == by_hand(texts)
