"""Language-model scores by a hidden Markov model over words.

A state emits a symbol: one of the most frequent words, the end, or, for any
other word, a class given by its first and last letters; within its class a
word has its smoothed share, whatever the state. So the probability of a text
is that of its symbols, by the scaled forward recursion, times the shares of
its rarer words. Baum-Welch counts are taken over every whole training document
in each partition and added up; what is broadcast (the frequent words, the
parameters) has a fixed size, and counts of rarer words meet the texts in a
join.

A long text is taken in runs side by side, without a cut between them: the
product of a run's steps and emissions, a matrix of states, carries the forward
chances over it, and back over it the backward ones, so that each run starts
and ends with what the whole text gives there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, batch, by_bytes, checkpoint, crc32_of, encoded, gathered, texts, tidy, work_dir

#: Hidden states, frequent words with a symbol of their own, and classes of the others.
STATES, FREQUENT, CLASSES = 8, 30_000, 4096
#: Rounds of Baum-Welch over all training documents.
ROUNDS = 3
#: Distinct words that a task counts in memory before it hands them on.
HELD_WORDS = 300_000
#: Symbols of a run, and symbols whose chances are held at once. Neither changes any result.
RUN, HELD_SYMBOLS = 512, 1 << 19
#: Bytes of codes that are scored at once, longer texts alone.
SCORE_BYTES = 2 << 20
#: What smoothing adds to expected emission and transition counts.
EMIT_PRIOR, STEP_PRIOR = 0.05, 1.0
#: The end of a text; no word holds a space.
END = " "
_SEED = 20240229


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_AZ).split()


def word_class(word: bytes) -> int:
    """The class of a word outside the frequent ones: its first and last two bytes."""
    return (word[0] * 131 + word[-1] * 31 + (word[-2] * 7 if len(word) > 1 else 0)) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over (doc_id, text) rows; each text counts one END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = batch({"word": (list(held), pa.binary()), "c": (list(held.values()), pa.int64())})
            held.clear()
            return b

        for b in batches:
            for x in encoded(b.column(1)):
                held.update(words_of(x))
            held[END.encode()] += b.num_rows
            if len(held) > HELD_WORDS:
                yield out()
        if held:
            yield out()

    return docs.mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Symbols:
    """Codes of the frequent words, then the end, then the classes."""

    def __init__(self, frequent: list[bytes]):
        self.words = {w: i for i, w in enumerate(frequent)}
        self.end = len(frequent)
        self.size = self.end + 1 + CLASSES

    def codes(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.words.get, words))
        rare = [i for i, x in enumerate(got) if x is None]
        for i in rare:
            got[i] = self.end + 1 + word_class(words[i])
        got.append(self.end)
        return np.array(got, np.int32)


def code_type(size: int) -> str:
    """How codes of so many symbols are written."""
    return "<u2" if size <= 1 << 16 else "<u4"


class Model:
    """start (states), step (states x states) and emit (symbols x states)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def first(cls, counts: np.ndarray, seed: int = _SEED) -> "Model":
        """States that mostly stay, with emissions near the words' shares, each pulled its own way."""
        rng = np.random.default_rng(seed)
        emit = (counts[:, None] + EMIT_PRIOR) * rng.uniform(0.4, 1.6, (len(counts), STATES))
        step = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(step, 0.9)
        return cls(np.full(STATES, 1 / STATES), step, emit / emit.sum(0))

    @classmethod
    def fitted(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> "Model":
        """From expected counts; the prior of an emission follows the symbol's share of all tokens."""
        emit = emit + EMIT_PRIOR * len(shares) * shares[:, None]
        start, step = start + STEP_PRIOR, step + STEP_PRIOR
        return cls(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def by_position(texts_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts from the longest down, position by position: codes, how many texts reach each position, the order."""
    sizes = np.array([len(t) for t in texts_])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    flat = np.concatenate([texts_[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # position-major order of the flat codes
    position = np.arange(len(flat)) - np.repeat(starts, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(active)[:-1]])
    out = np.empty(len(flat), flat.dtype)
    out[first[position] + row] = flat
    return out, active, order


def forward(model: Model, texts_: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each coded text, by the scaled forward recursion."""
    codes, active, order = by_position(texts_)
    step, total = model.step, np.zeros(len(texts_))
    ones, at, alpha = np.ones(STATES), 0, None
    for n in active:
        emit = model.emit[codes[at : at + n]]
        alpha = emit * model.start if alpha is None else (alpha[:n] @ step) * emit
        scale = alpha @ ones
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
        at += n
    out = np.empty(len(texts_))
    out[order] = total
    return out


def _products(model: Model, runs: list[np.ndarray]) -> np.ndarray:
    """For each run the product of its steps and emissions, each up to a factor."""
    codes, active, order = by_position(runs)
    back = np.ascontiguousarray(model.step.T, np.float32)
    emits = np.ascontiguousarray((model.emit / model.emit.max(1, keepdims=True)).T, np.float32)
    # By row of the matrices, then by column, then by run, which are many.
    product = np.zeros((STATES, STATES, len(runs)), np.float32)
    product[range(STATES), range(STATES)] = 1
    at = 0
    for t, n in enumerate(active):
        now = back @ product[:, :, :n]
        now *= emits[:, codes[at : at + n]]
        if t % 4 == 3:
            now /= now.max((0, 1))
        product[:, :, :n] = now
        at += n
    out = np.empty((len(runs), STATES, STATES))
    out[order] = product.transpose(2, 0, 1)
    return out


def _carried(model: Model, texts_: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The texts' runs, which of them begin a text, the forward chances before each (0 for those) and the backward ones after it, up to a factor."""
    runs, owner = [], []
    for k, x in enumerate(texts_):
        parts = [x[i : i + RUN] for i in range(0, len(x), RUN)]
        runs += parts
        owner += [k] * len(parts)
    owner = np.array(owner)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    before, after = np.zeros((len(runs), STATES)), np.ones((len(runs), STATES))
    long = np.flatnonzero(~first | np.append(~first[1:], False))  # runs of texts that have several
    if len(long):
        products, at_once = np.empty((len(runs), STATES, STATES)), max(1, HELD_SYMBOLS // RUN)
        for lo in range(0, len(long), at_once):
            part = long[lo : lo + at_once]
            products[part] = _products(model, [runs[i] for i in part])
        # The first runs of such texts are whole ones; a first symbol has no step before it.
        heads = long[first[long]]
        codes = np.stack([runs[i] for i in heads], axis=1)
        chances = model.start * model.emit[codes[0]]
        for c in codes[1:]:
            chances = (chances / chances.sum(1, keepdims=True) @ model.step) * model.emit[c]
        heads = dict(zip(heads.tolist(), chances / chances.sum(1, keepdims=True)))
        for i in long.tolist():
            if i in heads:
                chance = heads[i]
            else:
                before[i] = chance
                chance = chance @ products[i]
                chance /= chance.sum()
        for i in long[::-1]:
            if i + 1 < len(runs) and not first[i + 1]:
                after[i] = products[i + 1] @ after[i + 1]
                after[i] /= after[i].max()
    return runs, first, before, after


def expected(model: Model, texts_: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of some whole coded texts: start, step, emit."""
    runs, first, before, after = _carried(model, texts_)
    sums, lo = (np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES))), 0
    while lo < len(runs):
        hi, held = lo, 0
        while hi < len(runs) and (hi == lo or held + len(runs[hi]) <= HELD_SYMBOLS):
            held += len(runs[hi])
            hi += 1
        for total, x in zip(sums, _expected_in_runs(model, runs[lo:hi], first[lo:hi], before[lo:hi], after[lo:hi], size)):
            total += x
        lo = hi
    return sums


def _expected_in_runs(model: Model, runs: list[np.ndarray], starts: np.ndarray, before: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, active, order = by_position(runs)
    # By state, then by run, which are many.
    starts = starts[order]
    before, after = (np.ascontiguousarray(x[order].T, np.float32) for x in (before, after))
    first = np.concatenate([[0], np.cumsum(active)])
    step, emits = model.step.astype(np.float32), np.ascontiguousarray(model.emit.T, np.float32)
    back = np.ascontiguousarray(step.T)
    alphas, scales = np.empty((STATES, len(codes)), np.float32), np.empty(len(codes), np.float32)
    alpha = np.where(starts, model.start.astype(np.float32)[:, None], back @ before)
    for t, n in enumerate(active):
        here = slice(first[t], first[t] + n)
        alpha = (alpha if t == 0 else back @ alpha[:, :n]) * emits[:, codes[here]]
        scales[here] = scale = alpha.sum(0)
        alpha /= scale
        alphas[:, here] = alpha
    steps = np.zeros((STATES, STATES))
    beta, ends = after, np.append(active[1:], 0)
    gamma = alphas
    for t in range(len(active) - 1, -1, -1):
        a, n, m = first[t], active[t], ends[t]  # from m on, runs end here
        if m < n:
            beta[:, m:n] /= (alphas[:, a + m : a + n] * beta[:, m:n]).sum(0)
        if m:
            after_it = slice(first[t + 1], first[t + 1] + m)
            ahead = emits[:, codes[after_it]] * beta[:, :m]
            ahead /= scales[after_it]
            steps += alphas[:, a : a + m] @ ahead.T
            beta[:, :m] = step @ ahead
        if t == 0:
            steps += before @ (emits[:, codes[:n]] * beta[:, :n] / scales[:n]).T  # the step into a run that goes on
        gamma[:, a : a + n] *= beta[:, :n]  # alphas of t are used no more
    emit = np.stack([np.bincount(codes, weights=x, minlength=size) for x in gamma], axis=1)
    return gamma[:, : active[0]][:, starts].sum(1), steps * step, emit


def _pack(parts: tuple[np.ndarray, ...]) -> bytes:
    return np.concatenate([x.ravel() for x in parts]).astype("<f8").tobytes()


def _unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, "<f8")
    return flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 :].reshape(size, STATES)


def train(coded: DataFrame, size: int, shares: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows (codes binary); each task's counts go, slice by slice, to sums over tasks."""
    spark, kind = coded.sparkSession, code_type(size)
    model = Model.first(shares * 1e6)
    slices = 16  # of a task's counts, so that their sums are made by several tasks
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.start, model.step, model.emit))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = Model(*shared.value), None
            for b in batches:
                items = b.column(0).to_pylist()
                for lo, hi in by_bytes(items, 1 << 20):
                    got = expected(own, [np.frombuffer(x, kind) for x in items[lo:hi]], size)
                    sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
            if sums is not None:
                data = np.array_split(np.frombuffer(_pack(sums), "<f8"), slices)
                yield batch({"slice": (range(slices), pa.int32()), "data": ([x.astype("<f4").tobytes() for x in data], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.frombuffer(data, "<f4").astype("<f8")
                    sums[k] = sums[k] + x if k in sums else x
            if sums:
                yield batch({"slice": (list(sums), pa.int32()), "data": ([x.tobytes() for x in sums.values()], pa.binary())})

        partial = coded.mapInArrow(tidy(count), "slice int, data binary").repartitionById(slices, F.col("slice"))
        got = dict(partial.mapInArrow(tidy(add), "slice int, data binary").collect())
        shared.unpersist()
        if not got:
            return model
        model = Model.fitted(*_unpack(b"".join(bytes(got[k]) for k in range(slices)), size), shares)
    return model


def _most_frequent(words: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words with their counts, ties by the word. Only about as many are sorted."""
    digits = F.greatest(F.floor(F.log2("c")) - 9, F.lit(0)).cast("int")  # of a count, all but the first ten bits are dropped
    kinds = words.select((F.expr("c") - F.pmod(F.col("c"), F.pow(F.lit(2), digits).cast("long"))).alias("low")).groupBy("low").agg(F.count("*").alias("n")).collect()
    taken, least = 0, 0
    for low, n in sorted(kinds, reverse=True):
        taken, least = taken + n, low
        if taken >= most:
            break
    return {bytes(r["word"]): r["c"] for r in words.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(most).collect()}


def score(docs: DataFrame, rounds: int = ROUNDS, frequent_words: int = FREQUENT) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) mod 5 isn't 1.

    frequent_words: how many words have a symbol, and so chances of their own in
    each state; with as many as there are words, all have. They are broadcast.
    Texts count and are scored whole, however long. Null and empty texts are the end alone; a null doc_id's remainder counts as
    0, so such rows train; rows with equal doc_id are each scored, as they are
    each counted; an empty table gives an empty result. If nothing trains, all
    words are unknown.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(5)) == 1, F.lit(False))
    source = texts(docs)
    counts = checkpoint(count_words(source.where(~held)))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != F.lit(END).cast("binary"))
    frequent = _most_frequent(words, frequent_words)
    symbols = Symbols(list(frequent))
    ends = counts.where(F.col("word") == F.lit(END).cast("binary")).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w != b" " and w not in frequent:
                    k = word_class(w)
                    n[k] += c
                    v[k] += 1
        own = np.flatnonzero(v)
        yield batch({"k": (own, pa.int32()), "n": (n[own], pa.int64()), "v": (v[own], pa.int64())})

    sums = counts.mapInArrow(tidy(classes), "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, v in sums.collect():  # at most CLASSES rows
        class_n[k], class_v[k] = n, v

    shares = np.concatenate([np.fromiter(frequent.values(), float, len(frequent)), [ends], class_n]) + 0.5
    shares /= shares.sum()
    base_all = total + 0.5 * (distinct + 1)
    class_all = class_n + 0.5 * (class_v + 1)
    known = np.concatenate([np.fromiter(frequent.values(), float, len(frequent)), [ends]])
    base_known = np.concatenate([np.log10((known + 0.5) / base_all), np.zeros(CLASSES)])

    kind_of_code = code_type(symbols.size)
    names = spark.sparkContext.broadcast((symbols, base_known))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols_, base = names.value
        end, row = symbols_.end, TaskContext.get().partitionId() << 40  # a row's own number, as doc_id may repeat
        for b in batches:
            words = [words_of(x) for x in encoded(b.column(2))]
            codes = [symbols_.codes(w) for w in words]
            rare = [Counter(w for w, c in zip(ws, cs) if c > end) for ws, cs in zip(words, codes)]
            rows = range(row, row + b.num_rows)
            row += b.num_rows
            yield batch(
                {
                    "row": (rows, pa.int64()),
                    "doc_id": (b.column(0), pa.int64()),
                    "held_out": (b.column(1), pa.bool_()),
                    "n_tokens": ([len(c) for c in codes], pa.int64()),
                    "sure": ([int((c <= end).sum()) for c in codes], pa.int64()),
                    "base": ([float(base[c].sum()) for c in codes], pa.float64()),
                    "codes": ([c.astype(kind_of_code).tobytes() for c in codes], pa.binary()),
                    "words": (pa.array([list(r) for r in rare], pa.list_(pa.binary())), None),
                    "times": (pa.array([list(r.values()) for r in rare], pa.list_(pa.int32())), None),
                }
            )

    # Words are taken apart once; rounds and scores read the codes alone, the join the rarer words alone.
    path = work_dir(spark, "hmm-codes")
    source.select("doc_id", held.alias("held_out"), "text").mapInArrow(tidy(read), "row long, doc_id long, held_out boolean, n_tokens long, sure long, base double, codes binary, words array<binary>, times array<int>").write.parquet(path)
    coded = spark.read.parquet(path)
    model = train(coded.where("not held_out").select("codes"), symbols.size, shares, rounds)
    shared = spark.sparkContext.broadcast((model.start, model.step, model.emit))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in gathered(batches, SCORE_BYTES):
            codes = b.column(6).to_pylist()
            for lo, hi in by_bytes(codes, SCORE_BYTES):
                scores = forward(own, [np.frombuffer(x, kind_of_code) for x in codes[lo:hi]])
                cut = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*cut.columns[:6], pa.array(scores, pa.float64())], names=["row", "doc_id", "held_out", "n_tokens", "sure", "base", "score"])

    rated = coded.select("row", "doc_id", "held_out", "n_tokens", "sure", "base", "codes").mapInArrow(tidy(rate), "row long, doc_id long, held_out boolean, n_tokens long, sure long, base double, score double")
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    size = F.length("word")
    byte = lambda i: F.conv(F.hex(F.substring(F.col("word"), i, 1)), 16, 10).cast("int")
    kind = F.pmod(byte(1) * 131 + byte(-1) * 31 + F.when(size > 1, byte(-2) * 7).otherwise(0), F.lit(CLASSES))
    shares_ = spark.createDataFrame([(k, float(x)) for k, x in enumerate(class_all)], "k int, all double")
    c = F.coalesce("c", F.lit(0))
    met = rare.join(counts, "word", "left").select("row", "n", c.alias("c"), kind.cast("int").alias("k")).join(F.broadcast(shares_), "k")
    n = F.col("n")
    tails = met.groupBy("row").agg(
        F.sum(n * F.log10((F.col("c") + 0.5) / base_all)).alias("tail_base"),
        F.sum(n * F.log10((F.col("c") + 0.5) / F.col("all"))).alias("tail_score"),
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("tail_known"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rated.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        ((F.col("sure") if ends else F.col("sure") - 1) + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"),
        (F.col("score") + zero("tail_score")).alias("score"),
    )
