"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyweave.llm import bwt, hmm, langid, licenses, multiset_hash, packing, pieces, quality, simhash, suffix, token_files, tokens  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, fp long, part int, length long, label string, bucket int, anchor long, kept string, ids string"
BLANK = r"[^\x20\x09-\x0D]+"


def make(spark, rows):
    """rows: (doc_id, text, lang); columns with the names that operators use themselves hold other things."""
    full = [(i, t, g, "s", None if t is None else len(t), "w", 1, 2, 3, "l", 4, 5, "k", "i") for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(rng, n, lang="en"):
    stems = {"en": ["the", "ing", "tion", "sh", "wh", "over"], "fr": ["eau", "ère", "qui", "les", "ou", "ç"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = [(i, prose(rng, rng.randint(20, 120), "fr" if i % 3 else "en"), "fr" if i % 3 else "en") for i in range(40)]
    rows += [(40, base, "en"), (41, base, "en"), (42, base[:900] + " x " + base[903:], "en"), (43, prose(rng, 30) + base[200:600], None)]
    rows += [(44, None, "en"), (45, "", "fr"), (46, "  \n\t ", None), (47, "Ünïcödé 日本 🙂 x", None), (48, "a", "en"), (49, "12 34", "en")]
    rows += [(50, prose(rng, 9000), "en"), (51, "same line of words here\n" * 40, "en"), (None, prose(rng, 50), "en"), (52, "row twice " * 30, "en"), (52, "row twice " * 30, "en")]
    rows += [(53, "Released under the MIT Licence\nMore text.", "en"), (54, licenses.KNOWN[0][1].replace("<year>", "1999").upper(), "en"), (55, "tab\there  two spaces <|endoftext|> ", None)]
    return rows


OPERATORS = {
    "op1": lambda d: hmm.score(d),
    "op2": lambda d: packing.pack(d, BPE),
    "op3": lambda d: token_files.token_files(d, BPE, 2),
    "op4": lambda d: multiset_hash.edited_fingerprints(d),
    "op5": lambda d: simhash.near_duplicates(d),
    "op6": lambda d: langid.identify(d),
    "op7": lambda d: licenses.scan(d),
    "op8": lambda d: pieces.encode_decode(d, SP),
    "op9": lambda d: suffix.remove_repeats(d),
    "op10": lambda d: quality.quality(d),
    "keep_good": quality.keep_good,
    "keep_known": langid.keep_known,
    "keep_one": simhash.keep_one,
    "without_repeats": suffix.without_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](make(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    got = OPERATORS[name](make(spark, [(None, None, None), (None, None, None), (3, None, None)])).collect()
    assert len(got) <= 3 and (name.startswith("keep") or len(got) == 3)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def lowered(text):
    return re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_scores(spark, table):
    got = by_id(hmm.score(make(spark, table)))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, _ in table if not held(i) for w in [*lowered(t), " "])
    total, distinct = sum(counts.values()), len(counts)
    for i, t, _ in table:
        words = [*lowered(t), " "]
        r = got[i][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words), sum(counts[w] > 0 for w in words), total)
        assert abs(r.base_score - sum(log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)) < 1e-6
        assert r.score < 0 and np.isfinite(r.score)
    assert sum(r.score for x in got.values() for r in x if not r.held_out) > sum(r.base_score for x in got.values() for r in x if not r.held_out)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Model.first(rng.uniform(1, 9, 20))
    texts = [rng.integers(0, 20, n).astype(np.uint16) for n in (1, 7, 30, 2, 30)]
    for text, got in zip(texts, hmm.forward(model, texts)):
        alpha = model.start * model.emit[text[0]]
        for c in text[1:]:
            alpha = (alpha @ model.step) * model.emit[c]
        assert abs(got - log10(alpha.sum())) < 1e-9


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    texts = [np.concatenate([rng.integers(0, 10, 40), rng.integers(10, 20, 40)]) for _ in range(20)]
    shares = np.full(20, 1 / 20)
    model, before = hmm.Model.first(shares * 1e6), None
    for _ in range(6):
        got = hmm.forward(model, texts).sum()
        assert before is None or got > before - 1e-6
        before = got
        model = hmm.Model.fitted(*hmm.expected(model, texts, 20), shares)
    one = [np.array([1, 2, 3])]
    start, step, emit = hmm.expected(model, one, 20)
    assert abs(start.sum() - 1) < 1e-4 and abs(step.sum() - 2) < 1e-4 and np.allclose(emit.sum(1)[[1, 2, 3]], 1, atol=1e-4)


def brute_counts(model, text):
    """Expected start, step and emit counts of one text, in plain scaled recursions."""
    n = len(text)
    alpha, beta, scale = np.zeros((n, hmm.STATES)), np.ones((n, hmm.STATES)), np.zeros(n)
    for t, c in enumerate(text):
        alpha[t] = (model.start if t == 0 else alpha[t - 1] @ model.step) * model.emit[c]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    step, emit = np.zeros_like(model.step), np.zeros_like(model.emit)
    for t in range(n - 2, -1, -1):
        ahead = model.emit[text[t + 1]] * beta[t + 1] / scale[t + 1]
        step += np.outer(alpha[t], ahead) * model.step
        beta[t] = model.step @ ahead
    np.add.at(emit, text, alpha * beta)
    return alpha[0] * beta[0], step, emit


@pytest.mark.parametrize("run", [1, 7, 512])
def test_counts_are_those_of_whole_texts(monkeypatch, run):
    monkeypatch.setattr(hmm, "RUN", run)
    monkeypatch.setattr(hmm, "HELD_SYMBOLS", 900)
    rng = np.random.default_rng(4)
    model = hmm.Model.first(rng.uniform(1, 9, 50) ** 3)
    model = hmm.Model.fitted(np.arange(hmm.STATES) * 3.0, rng.uniform(0, 9, (hmm.STATES, hmm.STATES)) ** 2, model.emit * 1000, np.full(50, 1 / 50))
    texts = [rng.integers(0, 50, n) for n in (2000, 1, 3, 512, 513, 40, 1025)]
    want = [sum(x) for x in zip(*(brute_counts(model, t) for t in texts))]
    for got, x in zip(hmm.expected(model, texts, 50), want):
        assert np.allclose(got, x, rtol=2e-3, atol=2e-3)


def test_scores_of_rarer_words(spark, table, monkeypatch):
    """score against the model's definition, with few words that have symbols of their own."""
    held = []
    monkeypatch.setattr(hmm, "train", lambda coded, size, shares, rounds: held.append(hmm.Model.first(shares * 1e6)) or held[-1])
    got = by_id(hmm.score(make(spark, table), frequent_words=25))
    model = held[0]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, _ in table if not out(i) for w in lowered(t))
    own = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode()))[:25])}
    kind = lambda w: hmm.word_class(w.encode())
    in_class, kinds = Counter(), Counter()
    for w, c in counts.items():
        if w not in own:
            in_class[kind(w)] += c
            kinds[kind(w)] += 1
    for i, t, _ in table:
        words, alpha, total = lowered(t), None, 0.0
        for code in [own[w] if w in own else 26 + kind(w) for w in words] + [25]:
            alpha = (model.start if alpha is None else alpha @ model.step) * model.emit[code]
            total += log10(alpha.sum())
            alpha /= alpha.sum()
        total += sum(log10((counts[w] + 0.5) / (in_class[kind(w)] + 0.5 * (kinds[kind(w)] + 1))) for w in words if w not in own)
        assert abs(got[i][0].score - total) < 1e-6 * max(1, abs(total))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_encoder_is_the_library(library):
    enc, rng = tokens.Encoder(BPE), random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", ".", ",", "'s", "don't", "é", "日本", "🙂", "12", "x.", "!?", "<|endoftext|>", " \n", "\x85", "\x1c", "ſ", "①"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, table, library):
    rows = packing.pack(make(spark, table), BPE, 2048, 0).collect()
    ids = Counter()
    for i, t, _ in table:
        x = library.encode(t or "", add_special_tokens=False).ids + [0]
        at = [0, *range((len(x) - 1) % 2048 + 1, len(x) + 1, 2048)]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            ids[i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == ids
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_local_search_empties_bins():
    # Best fit leaves three bins here; two hold all after one piece is exchanged for two.
    bins = Counter({(6, 3): 1, (4, 4): 1, (3,): 1})
    got = packing.local_search(bins, 10)
    assert sum(n * sum(p) for p, n in got.items()) == 20 and sum(got.values()) == 2
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 60)))
        first = packing.best_fit(counts, 40)
        last = packing.local_search(first, 40)
        fill = lambda b: sum(n * sum(p) ** 2 for p, n in b.items())
        assert sum((Counter({x: n * k for x, k in Counter(p).items()}) for p, n in last.items()), Counter()) == counts
        assert fill(last) >= fill(first) and sum(last.values()) <= sum(first.values()) and all(sum(p) <= 40 for p in last)


def test_token_files(spark, table, library, tmp_path):
    docs = make(spark, table)
    rows = by_id(token_files.token_files(docs, BPE, 2, f"file://{tmp_path}/t"))
    start = 0
    ordered = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t, _ in ordered:
        x = library.encode(t or "", add_special_tokens=False).ids + [2]
        r = next(r for r in rows[i] if r.start == start)
        assert (r.n_tokens, r.ids_crc32) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    keys, offsets, ids = token_files.read_shard(f"file://{tmp_path}/t", 0)
    assert ids.dtype == np.uint16 and len(offsets) == len(keys) + 1 and offsets.dtype == np.int64


def test_fingerprints(spark, table):
    rows = [r for r in table if r[0] is not None and r[0] != 52]
    got = by_id(multiset_hash.edited_fingerprints(make(spark, rows)))
    seen = {}
    for (i, t, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i][0]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for text, f in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert seen.setdefault(text, f) == f
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(seen.values())) == len(seen)
    assert sum(x[0].near_edited > x[0].near_next for x in got.values()) > 0.85 * len(got)


def test_fingerprints_are_homomorphic(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("ab", "one two\nthree"), ("ba", "three\none two"), ("a", "one two"), ("b", "three")], "k string, t string")
    f = {r.k: r.fingerprint for r in multiset_hash.fingerprint(rows, "k", "t").collect()}
    assert f["ab"] == f["ba"] != f["a"]
    both = spark.createDataFrame([(f["a"], f["b"], f["ab"])], "a string, b string, ab string")
    got = both.select(multiset_hash.combine(F.col("a"), F.col("b")).alias("sum"), multiset_hash.combine(F.col("ab"), F.col("b"), -1).alias("rest")).first()
    assert got["sum"] == f["ab"] and got.rest == f["a"]


def brute_simhash(text):
    w = lowered(text)
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_near_duplicates(spark, table):
    rows = [r for r in table if r[0] is not None]
    fps = [brute_simhash(t) for _, t, _ in rows]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    for (i, _, _), fp, k in zip(rows, fps, least):
        for r in by_id(simhash.near_duplicates(make(spark, rows)))[i] if i in (44, 52) else []:
            assert (r.fingerprint, r.component_id) == (f"{fp:016x}", rows[k][0])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make(spark, rows)).collect()}
    assert got == {i: (f"{fp:016x}", rows[k][0]) for (i, _, _), fp, k in zip(rows, fps, least)}


def test_dense_cells_lose_no_link(spark, monkeypatch):
    """Chains of fingerprints at up to three bits, in cells that are cut into many blocks."""
    monkeypatch.setattr(simhash, "CELL", 4)
    rng, fps = random.Random(9), set()
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from tallyweave.llm.components import components

    found = {r.node: r.label for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    label = list(range(len(fps)))
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(fps))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(fps))]
        if new == label:
            break
        label = new
    groups = {}
    for i, g in enumerate(label):
        groups.setdefault(g, set()).add(signed[i])
    got = {}
    for x in signed:
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_languages(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(3, 80), "fr" if i % 2 else "en"), "fr" if i % 2 else "en") for i in range(300)]
    rows += [(300, None, "en"), (301, "123 !!", "en"), (302, "🙂", None), (303, "", "fr")]
    got = by_id(langid.identify(make(spark, rows)))
    for i, t, lang in rows:
        r = got[i][0]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    test = [(got[i][0].lang_pred, lang) for i, t, lang in rows[:300] if got[i][0].held_out]
    assert np.mean([a == b for a, b in test]) > 0.97
    assert langid.identify(make(spark, [(1, "no label here", None)])).first().lang_pred == "und"


def test_switched_text():
    rng = random.Random(8)
    field = langid.fit([(prose(rng, 60, g), g) for _ in range(30) for g in ("en", "fr")])
    labels, scores = langid.predict(field, [prose(rng, 30, "en") + " " + prose(rng, 12, "fr")])
    assert labels == ["en"] and 0.5 < scores[0] < 0.9
    # Chances against the sum over all label sequences.
    emit, step = np.array([[0.3, -1], [0.2, 0.9], [1, 0.1]]), np.array([[0.5, -0.2], [0.1, 0.4]])
    chance, moves, norm = langid.marginals(emit, step, np.array([1, 1, 1]))
    import itertools

    paths = list(itertools.product((0, 1), repeat=3))
    w = np.array([np.exp(sum(emit[t, y] for t, y in enumerate(p)) + step[p[0], p[1]] + step[p[1], p[2]]) for p in paths])
    assert abs(norm - np.log(w.sum())) < 1e-9
    for t in range(3):
        assert abs(chance[t, 1] - w[[p[t] == 1 for p in paths]].sum() / w.sum()) < 1e-9
    assert abs(moves.sum() - 2) < 1e-9


def test_licenses(spark, table):
    got = by_id(licenses.scan(make(spark, table)))
    assert got[54][0].license == "MIT" and got[53][0].line_licenses == "MIT" and got[44][0].license is None and got[0][0].line_licenses == ""


def brute_repeats(items, size):
    seen = Counter(b[k : k + size] for b in items for k in range(len(b) - size + 1))
    out = []
    for b in items:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        out.append(gone)
    return out


def test_repeats(spark, table):
    rows = [r for r in table if r[0] is not None]
    rows += [(60, "x" * 300, None), (61, "ab" * 150, None), (62, "y" * 200, None), (63, "é" * 150, None), (64, "q" + "é" * 150, None), (65, "z" * 199, None), (66, "z" * 199, None)]
    masks = brute_repeats([(t or "").encode() for _, t, _ in rows], 200)
    want = Counter()
    for (i, t, _), gone in zip(rows, masks):
        kept = bytes(np.frombuffer((t or "").encode(), np.uint8)[~gone])
        want[i, len(gone), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, suffix.remove_repeats(make(spark, rows)).collect())) == want
    texts = {r.doc_id: r.text for r in suffix.without_repeats(make(spark, rows)).collect()}
    for (i, t, _), gone in zip(rows, masks):
        assert texts[i] == bytes(np.frombuffer((t or "").encode(), np.uint8)[~gone]).decode("utf-8", "ignore")


@pytest.mark.parametrize("hot", [1, 3, 10])
def test_frequent_anchors(spark, monkeypatch, hot):
    """Anchors with many contexts, equal and different ones, are narrowed."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SEEN_BYTES", 500)
    rng = random.Random(1)
    common = prose(rng, 30)[:150]
    rows = [(i, prose(rng, 20 + i % 3)[: 60 + i] + common + (prose(random.Random(i % 4), 30)), None) for i in range(40)]
    rows += [(100 + i, common + "!" + common[:120] + str(i // 3), None) for i in range(30)] + [(200 + i, "same text " * 40, None) for i in range(30)]
    masks = brute_repeats([t.encode() for _, t, _ in rows], 200)
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(make(spark, rows)).collect()}
    assert got == {i: int(g.sum()) for (i, _, _), g in zip(rows, masks)} and any(got.values())


def test_merged_transforms(monkeypatch):
    rng = random.Random(3)
    for _ in range(120):
        monkeypatch.setattr(bwt, "BLOCK", rng.choice([1, 2, 5]))
        monkeypatch.setattr(bwt, "SHARD_BYTES", rng.choice([5, 20, 100, 10**6]))
        size = bwt.BLOCK * rng.choice([1, 2, 3, 4])
        items = [bytes(rng.choice(b"ab") if rng.random() < 0.9 else rng.choice(b"abcde") for _ in range(rng.choice([0, 1, 3, 10, 30, 60]))) for _ in range(rng.randint(1, 12))]
        seen = Counter(t[k : k + size] for t in items for k in range(len(t) - size + 1))
        for t, got in zip(items, bwt.repeated(items, size)):
            assert got.tolist() == [seen[t[k : k + size]] > 1 for k in range(len(t) - size + 1)]


def test_quality(spark, table):
    got = by_id(quality.quality(make(spark, table)))
    for i, t, _ in table:
        t = t or ""
        w = re.findall(BLANK, t)

        def covered(n):
            seen = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            on = [False] * len(w)
            for k in range(len(w) - n + 1):
                if seen[tuple(w[k : k + n])] > 1:
                    on[k : k + n] = [True] * n
            return on

        lines, again = [x for x in t.split("\n") if re.search(BLANK, x)], 0
        for k, x in enumerate(lines):
            again += x in lines[:k]
        r = got[i][0]
        chars = sum(map(len, w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), again, sum(covered(8)))
        assert r.base_failed == (len(w) < 20 or 100 * sum(covered(8)) > 30 * len(w))
        for n in quality.NGRAM_LIMITS:
            assert r[f"dup_chars_{n}"] == sum(len(x) for x, on in zip(w, covered(n)) if on)
        assert not (r.kept and r.base_failed)
    assert got[0][0].kept and not got[51][0].kept


def test_stages_keep_columns(spark, table):
    docs = make(spark, table)
    for stage in (quality.keep_good, langid.keep_known, simhash.keep_one, suffix.without_repeats):
        assert stage(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = quality.keep_good(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, rs in by_id(quality.quality(docs)).items() for r in rs if r.kept)
    one = [r.doc_id for r in simhash.keep_one(docs).collect()]
    roots = by_id(simhash.near_duplicates(docs))
    assert 52 in one and one.count(52) == 1 and 41 not in one and 40 in one
    assert all(i is None or roots[i][0].component_id == i for i in one)


def test_frequent_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyweave.llm import common

    monkeypatch.setattr(common, "FREQUENT_LEAST", 20)
    rows = spark.range(500).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 60).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k <> 3")
    got = {(r.k, r.id, r.n, r.low) for r in common.joined_to_counts(rows, counts, ["k"]).collect()}
    assert got == {(r.k, r.id, r.n, r.low) for r in rows.join(counts, "k").select("k", "id", "n", "low").collect()} and len(got) > 400


@pytest.mark.parametrize("name", ["op7_license_scan", "op10_quality_rules"])
def test_queries_against_sql(spark, small, name):
    import duckdb

    from tallyweave.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = QUERIES[name](spark, small)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    text = prose(rng, 3000).encode()
    text += text[500:1500] + b"end"
    whole, parts = suffix.anchors([text]), suffix.anchors_in_parts([text], most=700)

    def windows(found):
        return {x: (a, x - s) for a, s, n in zip(*(found[i].tolist() for i in (1, 2, 3))) for x in range(s, s + n - 199)}

    assert windows(whole).keys() == windows(parts).keys() == set(range(len(text) - 199))
    assert {x: a for x, (a, _) in windows(whole).items()} == {x: a for x, (a, _) in windows(parts).items()}
    items = [text, b"", b"one two", text[:300]]
    before = simhash.simhashes(items)
    monkeypatch.setattr(simhash, "SHINGLES", 50)
    assert (simhash.simhashes(items) == before).all() and before[0] == brute_simhash(text.decode())
