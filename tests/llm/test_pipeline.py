"""The pipeline against the same decisions made plainly, on the driver's small table."""

import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark, small):
    from tallyweave.llm.common import documents
    from tallyweave.llm.langid import Field, predict, train
    from tallyweave.llm.quality import measure
    from tallyweave.llm.simhash import simhashes
    from tokenizers import Tokenizer

    docs = documents(spark, small).orderBy("doc_id").collect()
    good = [d for d in docs if measure([(d.text or "").encode()])["kept"][0]]
    field: Field = train(spark.createDataFrame(good, documents(spark, small).schema))
    known = [d for d in good if (lambda x: x[0][0] != "und" and x[1][0] >= 0.4)(predict(field, [d.text]))]
    fps = simhashes([d.text.encode() for d in known])
    label = list(range(len(known)))
    for _ in known:
        label = [min(label[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)) for i in range(len(known))]
    single = [d for i, d in enumerate(known) if label[i] == i]
    raw = [d.text.encode() for d in single]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    kept = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept.append(np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    library = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in zip(single, kept):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        at = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            want[d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len(good) < len(docs) and len(single) < len(known)
