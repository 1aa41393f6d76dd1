"""The packing search runs until no bin has a step."""

import random
from collections import Counter

from tallyweave.llm import packing


def test_no_step_is_left():
    rng = random.Random(1)
    counts = Counter(rng.randint(100, 1100) for _ in range(1500))
    bins = packing.local_search(packing.best_fit(counts, 2048), 2048)
    under = [p for p in bins if sum(p) < 2048]
    assert all(packing._step(d, [p for p in under if p != d or bins[p] > 1], 2048) is None for d in under)
    assert sum((Counter({x: n * k for x, k in Counter(p).items()}) for p, n in bins.items()), Counter()) == counts
