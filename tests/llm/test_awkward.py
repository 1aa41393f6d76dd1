"""Ids of many rows and none, letters, many languages, spellings, very long texts; the pipeline on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyweave.llm import common, hmm, langid, licenses, multiset_hash, packing, pieces, quality, simhash, suffix, token_files  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="etaoinshrdlu"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows without an id, a third of one id, and equal rows among both."""
    rng = random.Random(1)
    rows = [(None, words(rng, 12)) for _ in range(60)] + [(7, words(rng, 12)) for _ in range(60)] + [(i, words(rng, 12)) for i in range(60)]
    rows += rows[:5] + rows[60:65] + [(None, None), (7, ""), (7, None)]
    return rows, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS).repartition(5)


def test_token_files_of_hot_ids(hot, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rows, docs = hot
    library = Tokenizer.from_file(BPE)
    folder = f"file://{tmp_path}/t"
    shards = token_files.write_tokens(docs, folder, BPE, 2, parts=12)
    monkeypatch.setattr(token_files, "READ_DOCS", 7)
    got = sorted(map(tuple, token_files.read_tokens(docs.sparkSession, folder).collect()), key=lambda r: r[1])
    ids = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u2")) for i, t in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].tobytes()), x[1].tobytes()))
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in ids])])
    assert got == [(i, int(a), len(x), zlib.crc32(x.astype("<u4").tobytes())) for (i, x), a in zip(ids, starts)]
    held = [set(token_files.read_shard(folder, s["part"])[0].tolist()) for s in shards]
    assert sum(7 in x for x in held) > 2 and sum(token_files.NO_ID in x for x in held) > 2


def test_files_are_read_by_ranges(hot, tmp_path, monkeypatch):
    """As on a folder that can't be mapped."""
    _, docs = hot
    folder = f"file://{tmp_path}/t"
    part = token_files.write_tokens(docs, folder, BPE, 2, parts=1)[0]["part"]
    mapped = [tuple(x.tolist() for x in r) for r in token_files.read_documents(folder, part)]
    monkeypatch.setattr(token_files.pafs, "LocalFileSystem", type("Other", (), {}))
    assert [tuple(x.tolist() for x in r) for r in token_files.read_documents(folder, part)] == mapped


def test_fingerprints_of_hot_ids(hot):
    rows, docs = hot
    ordered = [r.t for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("t")).collect()]
    want = Counter()
    for (i, _), t, after in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), ordered, ordered[1:] + ordered[:1]):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = multiset_hash.edited_fingerprints(docs)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()) == want


def test_removal_and_duplicates_without_ids(spark):
    rng = random.Random(3)
    text = words(rng, 80)
    rows = [(None, text), (None, text), (None, words(rng, 80)), (4, text + " more of it"), (4, words(rng, 80)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS)
    got = Counter((r.doc_id, r.n_removed > 0) for r in suffix.remove_repeats(docs).collect())
    assert got == {(None, True): 2, (None, False): 2, (4, True): 1, (4, False): 1}
    near = simhash.near_duplicates(docs).collect()
    twice = [r for r in near if r.fingerprint == next(x.fingerprint for x in near if Counter(y.fingerprint for y in near)[x.fingerprint] > 1)]
    assert len(near) == 6 and [r.doc_id for r in twice] == [None, None] and {r.component_id for r in twice} <= {None, 4}


def test_letters(spark):
    docs = spark.createDataFrame([(i, words(random.Random(i), 40), "en", "s", 1) for i in range(30)], DOCUMENTS)
    field = langid.train(docs)
    labels, scores = langid.predict(field, ["½ ²", "① Ⅷ", "— … 。", "12 34", "🙂", "a½", "日本", "é"])
    assert labels == ["und"] * 5 + ["en"] * 3 and list(scores[:5]) == [0.0] * 5


def test_rare_languages_are_learnt(spark, monkeypatch):
    """Twenty languages, some of few documents, and a bound that lets each have three."""
    monkeypatch.setattr(langid, "SAMPLE_MOST", 60)
    rng, rows = random.Random(2), []
    alphabets = ["".join(chr(0x4E00 + 12 * k + j) for j in range(9)) for k in range(20)]
    for k, letters in enumerate(alphabets):
        rows += [(None if k == 3 else 1000 * k + i, words(rng, 30, letters), f"l{k:02d}", "s", 1) for i in range(300 if k % 2 else 25)]
    field = langid.train(spark.createDataFrame(rows, DOCUMENTS))
    assert len(field.labels) == 20
    labels, _ = langid.predict(field, [words(rng, 20, letters) for letters in alphabets])
    assert labels == [f"l{k:02d}" for k in range(20)]


def test_sample_is_bounded():
    runs = langid.runs_of("word " * 50_000 + "x" * 10_000)
    assert sum(map(len, runs)) <= langid.SAMPLE_WORDS and max(len(w) for r in runs for w in r) <= langid.WORD_BYTES
    spread = langid.runs_of(" ".join(map(str, range(10_000))))
    assert int(spread[0][0]) == 0 and int(spread[-1][0]) > 9000


@pytest.mark.parametrize("a,b", [("licence licence", "license license"), ("a Licence, LICENCES", "A license licenses"), ("per cent per cent", "percent percent"), ("noncommercial licence", "non commercial license")])
def test_spellings_side_by_side(spark, a, b):
    got = spark.createDataFrame([(a,), (b,)], "t string").select(licenses.digest(F.col("t")).alias("d")).collect()
    assert got[0].d == got[1].d


def test_lines_of_equal_ids(spark):
    text = "Released under the MIT Licence.\nx\nThis file is licensed under the ISC license\nReleased under the MIT License."
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text), (1, text.replace("\n", " ")), (2, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.line_licenses, r.n_license_lines) for r in licenses.scan(docs).collect())
    assert got == {(1, "ISC MIT", 3): 2, (None, "ISC MIT", 3): 2, (1, "", 0): 1, (2, "", 0): 1}


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(6)
    text = words(rng, 150_000) + "\n" + "y" * 100_000
    return text, spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short", "en", "s", 5)], DOCUMENTS)


def first(rows):
    return next(r for r in rows.collect() if r.doc_id == 1)


def test_very_long_texts(spark, long):
    from tokenizers import Tokenizer

    text, docs = long
    n = len(text.split())
    ids = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    scored = first(hmm.score(docs, rounds=1))
    assert scored.n_tokens == n + 1 and np.isfinite(scored.score) and scored.score < 0
    cut = [r for r in packing.pack(docs, BPE).collect() if r.doc_id == 1]
    assert sum(r.length for r in cut) == len(ids) + 1 and len(cut) == -(-(len(ids) + 1) // 2048)
    written = first(token_files.token_files(docs, BPE, 2))
    assert written.n_tokens == len(ids) + 1 and written.ids_crc32 == zlib.crc32(np.array(ids + [2], "<u4").tobytes())
    assert first(multiset_hash.edited_fingerprints(docs)).n_chars == len(text)
    assert first(langid.identify(docs)).lang_pred == "en"
    assert first(licenses.scan(docs)).license is None
    assert first(pieces.encode_decode(docs, SP)).decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert first(quality.quality(docs)).n_words == n


def written(spark, rows, path):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, written(spark, [], tmp_path)).count() == 0


def test_pipeline_of_an_awkward_table(spark, tmp_path):
    """Nulls in every column, empty texts, rows twice: good texts come through, once each of what is equal."""
    import corpus_pipeline

    rng = random.Random(8)
    good = [(i if i % 5 else None, words(rng, 120), "en" if i % 2 else None, None, None) for i in range(20)]
    rows = good + good[:3] + [(90, None, None, "s", 0), (91, "", "en", "s", 0), (92, "same line\n" * 60, "en", "s", 600), (93, "12 34 56", "en", "s", 8)]
    at = written(spark, rows, tmp_path)
    before = common.made(spark)
    got = corpus_pipeline.run(spark, at).collect()
    assert common.made(spark) == before + 1  # the last stage's folder is all that is left
    assert Counter(r.doc_id for r in got if r.piece == 0 and r.doc_id is not None) == {i: 1 for i in range(20) if i % 5}
    assert sum(r.piece == 0 and r.doc_id is None for r in got) == 4 and all(r.length <= 2048 for r in got)


def test_likeness_is_near_the_true_one(spark):
    """Of multisets of neighbouring words: one less the squared distance over the squared sizes."""
    rng, texts_ = random.Random(9), []
    for i in range(60):
        base = words(rng, 150)
        texts_ += [base, base[: rng.randint(0, len(base))] + words(rng, rng.randint(1, 150))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts_)], DOCUMENTS)

    def pairs(t):
        return Counter(p for line in t.split("\n") for p in zip([""] + line.split(" "), line.split(" ")))

    def true(a, b):
        x, y = pairs(a), pairs(b)
        apart = sum((x[k] - y[k]) ** 2 for k in x.keys() | y.keys())
        return 1 - apart / (sum(v * v for v in x.values()) + sum(v * v for v in y.values()))

    off = []
    for r in multiset_hash.edited_fingerprints(docs).collect():
        t, after = texts_[r.doc_id], texts_[(r.doc_id + 1) % len(texts_)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        off += [r.near_edited - true(t, edited), r.near_next - max(0.0, true(t, after))]
    assert np.mean(np.abs(off)) < 0.1 and np.max(np.abs(off)) < 0.5 and abs(np.mean(off)) < 0.05
