"""Language of each text by a linear-chain conditional random field over its words.

A word's features are its byte n-grams, those at its edges being its affixes,
and the word itself (the lexicon), hashed to fixed tables. Weights and
transitions are fitted on a bounded sample of labelled documents, cut into runs
of words in the executors and shuffled so that languages switch within a sequence. Forward and
backward passes over a whole text give each word's chances; their mean over the
words with letters is the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import COLUMNS_SCHEMA, by_bytes, crc32_of, document_columns, gathered, small_batches, texts, tidy
from .hmm import by_position

#: Labelled documents of each language that the fit uses at most, and of all languages, among which they are shared out evenly (one each at least).
SAMPLE, SAMPLE_MOST = 250, 4000
#: Words of a document that the fit uses at most, in runs from all over it, and the bytes of a word.
SAMPLE_WORDS, WORD_BYTES = 600, 200
#: Bits of the feature tables' hashes, and lengths of n-grams.
TABLE_BITS, GRAMS = 16, (2, 3, 4)
#: Steps, step size and penalty of the fit; words in a training run and runs in a sequence.
STEPS, RATE, PENALTY, RUN, RUNS = 40, 0.15, 1e-6, 12, 6
#: Bytes of text that are labelled at once, longer texts alone.
LABEL_BYTES = 4 << 20
#: The least score of a document whose language counts as known.
SURE = 0.4
UNDETERMINED = "und"
#: Letters, and numerals such as fractions and Roman ones, which aren't.
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint32(2654435761)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the words, one after the other, and where each word's start (every word has some)."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" \0\0\0", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the blank before it
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = starts[-1]
    grams, rolled = [], flat
    for k in range(2, max(GRAMS) + 1):
        rolled = rolled[: len(flat) - k + 1] * np.uint32(0x01000193) + flat[k - 1 :]
        if k in GRAMS:
            grams.append(((rolled[:n] * _MIX) >> np.uint32(32 - TABLE_BITS)) + np.uint32(len(grams) << TABLE_BITS))
    at = np.arange(n, dtype=np.uint32) - np.repeat(starts[:-1], sizes).astype(np.uint32)
    whole = np.add.reduceat((flat[:n] + np.uint32(1)) * ((at + np.uint32(7)) * (at + np.uint32(7)) * _MIX), starts[:-1], dtype=np.uint32)
    lexicon = ((whole ^ (whole >> np.uint32(15))) * _MIX >> np.uint32(32 - TABLE_BITS)) + np.uint32(len(GRAMS) << TABLE_BITS)
    out = np.empty(n * len(GRAMS) + len(words), np.uint32)
    first = starts[:-1] * len(GRAMS) + np.arange(len(words))
    head = np.zeros(len(out), bool)
    head[first] = True
    out[head] = lexicon
    out[~head] = np.stack(grams, axis=1).ravel()
    return out, first


def marginals(emit: np.ndarray, step: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chances of each label at each place (rows position by position), expected transitions, log of the normalisers."""
    labels = emit.shape[1]
    top = emit.max(1, keepdims=True)
    emit, move, ones = np.exp(emit - top), np.exp(step), np.ones(labels)
    first = np.concatenate([[0], np.cumsum(active)])
    alphas, scales = np.empty_like(emit), np.empty(len(emit))
    for t, n in enumerate(active):
        a = first[t]
        alpha = emit[a : a + n] if t == 0 else (alphas[first[t - 1] : first[t - 1] + n] @ move) * emit[a : a + n]
        scales[a : a + n] = scale = alpha @ ones
        alphas[a : a + n] = alpha / scale[:, None]
    moves, beta = np.zeros((labels, labels)), np.ones((active[0] if len(active) else 0, labels))
    for t in range(len(active) - 1, -1, -1):
        a, n = first[t], active[t]
        if t + 1 < len(active):
            b, m = first[t + 1], active[t + 1]
            after = emit[b : b + m] * beta[:m] / scales[b : b + m, None]
            moves += alphas[a : a + m].T @ after
            beta[:m] = after @ move.T
        alphas[a : a + n] *= beta[:n]
    return alphas, moves * move, float(np.log(scales).sum() + top.sum())


class Field:
    """labels; weights of features (rows) for labels; weights of transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, step: np.ndarray):
        self.labels, self.weights, self.step = labels, weights, step

    def emissions(self, words: list[bytes]) -> np.ndarray:
        rows, first = features(words)
        return np.add.reduceat(self.weights[rows], first, axis=0)


def runs_of(text: str) -> list[list[bytes]]:
    """Runs of a text's words that the fit uses: all, or as many as SAMPLE_WORDS allows, evenly from the whole text."""
    words = [w[:WORD_BYTES] for w in split(text)]
    starts = range(0, len(words), RUN)
    most = max(1, SAMPLE_WORDS // RUN)
    if len(starts) > most:
        starts = [starts[i * len(starts) // most] for i in range(most)]
    return [words[i : i + RUN] for i in starts]


def fit(sample: list[tuple[str, str]], seed: int = 7) -> Field:
    """Fit a field to (text, label) rows; every word of a text has the text's label."""
    return fit_runs([(run, label) for text, label in sample for run in runs_of(text)], sorted({label for _, label in sample}), seed)


def fit_runs(sample: list[tuple[list[bytes], str]], labels: list[str], seed: int = 7) -> Field:
    """Fit a field to (words, label) rows."""
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    runs = [([known.setdefault(w, len(known)) for w in words], labels.index(label)) for words, label in sample if words]
    field = Field(labels, np.zeros(((len(GRAMS) + 1) << TABLE_BITS, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    if len(labels) < 2 or not runs:
        return field
    order = rng.permutation(len(runs))
    mixed = [[runs[i] for i in order[k : k + RUNS]] for k in range(0, len(order), RUNS)]
    words = [np.concatenate([np.array(r, np.int64) for r, _ in m]) for m in mixed]
    gold = [np.concatenate([np.full(len(r), y) for r, y in m]) for m in mixed]
    ids, active, _ = by_position(words)
    ys, _, _ = by_position(gold)
    truth = np.zeros((len(labels), len(labels)))
    for g in gold:
        np.add.at(truth, (g[:-1], g[1:]), 1)
    rows, first = features(list(known))
    sizes = np.diff(np.append(first, len(rows)))
    hit = np.zeros((len(ids), len(labels)))
    hit[np.arange(len(ids)), ys] = 1
    n = len(ids)
    state = {k: (np.zeros_like(x, float), np.zeros_like(x, float)) for k, x in (("w", field.weights), ("s", field.step))}
    for t in range(1, STEPS + 1):
        emit = np.add.reduceat(field.weights[rows], first, axis=0)
        chance, moves, _ = marginals(emit[ids].astype(float), field.step, active)
        off = chance - hit
        by_word = np.stack([np.bincount(ids, weights=off[:, k], minlength=len(known)) for k in range(len(labels))], axis=1)
        grad_w = np.stack([np.bincount(rows, weights=np.repeat(by_word[:, k], sizes), minlength=len(field.weights)) for k in range(len(labels))], axis=1) / n
        for key, x, g in (("w", field.weights, grad_w + PENALTY * field.weights), ("s", field.step, (moves - truth) / n + PENALTY * field.step)):
            mean, square = state[key]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            x -= RATE * (mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)).astype(x.dtype)
    return field


def predict(field: Field, items: list[str]) -> tuple[list[str], np.ndarray]:
    """Label and score of each text."""
    labels, scores = [UNDETERMINED] * len(items), np.zeros(len(items))
    use = [i for i, x in enumerate(items) if x and has_letter(x)] if field.labels else []
    if use:
        known: dict[bytes, int] = {}
        place = known.setdefault
        coded = [np.array([place(w, len(known)) for w in split(items[i])], np.int64) for i in use]
        names = list(known)
        emit = field.emissions(names)
        lettered = np.array([has_letter(w.decode("utf-8", "replace")) for w in names])
        ids, active, order = by_position(coded)
        chance, _, _ = marginals(emit[ids].astype(float), field.step, active)
        row = np.concatenate([np.arange(n) for n in active])
        keep = lettered[ids]
        sums = np.stack([np.bincount(row[keep], weights=chance[keep, k], minlength=len(use)) for k in range(len(field.labels))], axis=1)
        means = sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)
        best = means.argmax(1)
        for r, (i, k) in enumerate(zip(np.array(use)[order], best)):
            labels[i], scores[i] = field.labels[k], min(1.0, float(means[r, k]))
    return labels, scores


def held_out(docs: DataFrame):
    """True for those documents that nothing is learnt from; a null doc_id's remainder counts as 0."""
    return F.coalesce(F.pmod(crc32_of(F.col("doc_id").cast("long")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame) -> Field:
    """Fit on at most SAMPLE documents of each language, chosen by a hash of doc_id and text, and no more than SAMPLE_MOST of all.

    What comes to the driver is bounded: so many documents, and of each at most
    SAMPLE_WORDS words of at most WORD_BYTES bytes.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([])
    each = max(1, min(SAMPLE, SAMPLE_MOST // len(counts)))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    # So many rows of a language that the least of them are as many as are wanted, but for a chance that isn't worth a word.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, (1.5 * each + 30) / n)).otherwise(share)
    few = labelled.select("text", "lang", place.alias("place")).where(F.col("place") < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [runs_of(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.list_(pa.list_(pa.binary()))), b.column(1).cast(pa.string()), b.column(2)], names=["runs", "lang", "place"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", F.xxhash64("runs")))
    rows = few.mapInArrow(cut, "runs array<array<binary>>, lang string, place double").select("*", rank.alias("rank")).where(F.col("rank") <= each).collect()
    rows.sort(key=lambda r: (r["place"], r["lang"]))
    return fit_runs([([bytes(w) for w in run], r["lang"]) for r in rows for run in r["runs"]], sorted(counts))


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document.

    Null texts and texts without a letter (by Unicode's categories, so numerals
    are none) are ``und`` with score 0, as all are if no document is labelled.
    Rows with equal or null doc_id are each labelled; very long texts are
    labelled whole; of equal chances the language first by name is taken; an
    empty table gives an empty result.
    """
    field = field or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.labels, field.weights, field.step))
    source = texts(docs, held_out(docs).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for b in gathered(batches, LABEL_BYTES):
            items = b.column(1).to_pylist()
            for lo, hi in by_bytes(items, LABEL_BYTES):
                labels, scores = predict(own, items[lo:hi])
                cut = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(2), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents, with their columns, whose language is known; learnt from these documents unless field is given.

    If no document is labelled nothing can be told, and all stay. Null texts and
    texts without a letter go; rows with equal or null doc_id are each judged; an
    empty table gives an empty result.
    """
    field = field or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.labels, field.weights, field.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for b in gathered(batches, LABEL_BYTES):
            items = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in by_bytes(items, LABEL_BYTES):
                labels, scores = predict(own, items[lo:hi])
                yield b.slice(lo, hi - lo).filter(pa.array([x != UNDETERMINED and y >= SURE for x, y in zip(labels, scores)]))

    return document_columns(docs).mapInArrow(tidy(run), COLUMNS_SCHEMA) if field.labels else document_columns(docs)
