"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over whole texts, give the
characters that lie inside duplicated n-grams; duplicated lines are measured
beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import COLUMNS_SCHEMA, batch, by_bytes, document_columns, encoded, ranges, texts, tidy

#: n-gram lengths and the share of a text's characters that may lie in n-grams found more than once.
NGRAM_LIMITS = {5: 0.50, 8: 0.40, 10: 0.40}
#: Share of a text's characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.30
#: Symbols for each character of the words, at most.
SYMBOL_LIMIT = 0.25
#: The window, fewest words and share of repeated words (in hundredths) of the base rule.
BASE_WINDOW, BASE_WORDS, BASE_SHARE = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_DOC = np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)
)


def repeated_words(hashes: np.ndarray, doc: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """For each n, a mask of the words inside an n-word window that its document holds at least twice.

    hashes: a 64-bit hash of each word, documents one after the other; doc: the document of each word.
    """
    out, rolled = {}, hashes.copy()
    salt = doc.astype(np.uint64) * _DOC
    for n in range(1, max(lengths) + 1):
        if n > 1:
            rolled = rolled[:-1] * _STEP + hashes[n - 1 :]
        if n not in lengths:
            continue
        covered = np.zeros(len(hashes) + 1, np.int64)
        if len(rolled):
            inside = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :])
            keys = (rolled[inside] ^ (rolled[inside] >> np.uint64(29))) * _STEP + salt[inside]
            ordered = np.sort(keys)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                at = np.searchsorted(twice, keys)
                at[at == len(twice)] = 0
                starts = inside[twice[at] == keys]
                covered[starts] += 1
                np.subtract.at(covered, starts + n, 1)
        out[n] = np.cumsum(covered[:-1]) > 0
    return out


def measure(items: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text."""
    words = [x.split() for x in items]
    counts = np.fromiter(map(len, words), np.int64, len(items))
    flat = [w for x in words for w in x]
    hashes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    doc = np.repeat(np.arange(len(items)), counts)
    body = np.frombuffer(b"".join(flat), np.uint8)
    at = ranges(np.fromiter(map(len, flat), np.int64, len(flat)))
    points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    chars = (points[at[1:]] - points[at[:-1]]) if flat else np.zeros(0, np.int64)

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=len(items)).astype(np.int64)

    covered = repeated_words(hashes, doc, {*NGRAM_LIMITS, BASE_WINDOW})
    out = {"n_words": counts, "word_chars": summed(chars), "n_repeat_words": summed(covered[BASE_WINDOW])}
    out |= {f"dup_chars_{n}": summed(chars * covered[n]) for n in NGRAM_LIMITS}
    out["n_symbols"] = np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in items], np.int64)
    dup_lines, dup_chars = [], []
    for x in items:
        again, size = 0, 0
        if b"\n" in x:
            seen = set()
            for line in x.split(b"\n"):
                if not line.isspace() and line:
                    if line in seen:
                        again += 1
                        size += sum(len(w.decode("utf-8", "replace")) for w in line.split())
                    seen.add(line)
        dup_lines.append(again)
        dup_chars.append(size)
    out["n_dup_lines"], out["dup_line_chars"] = np.array(dup_lines, np.int64), np.array(dup_chars, np.int64)
    out["base_failed"] = (counts < BASE_WORDS) | (100 * out["n_repeat_words"] > BASE_SHARE * counts)
    bad = out["base_failed"] | (out["dup_line_chars"] > LINE_LIMIT * out["word_chars"]) | (out["n_symbols"] > SYMBOL_LIMIT * out["word_chars"])
    for n, most in NGRAM_LIMITS.items():
        bad = bad | (out[f"dup_chars_{n}"] > most * out["word_chars"])
    out["kept"] = ~bad
    return out


def quality(docs: DataFrame) -> DataFrame:
    """Repetition measures and the verdict of each document.

    Null and empty texts have no words and fail; rows with equal doc_id are each
    measured; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.strip().split(" ") for x in SCHEMA.split(",")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_()}
        for b in batches:
            items = encoded(b.column(1))
            for lo, hi in by_bytes(items):
                got = measure(items[lo:hi]) | {"doc_id": b.column(0).slice(lo, hi - lo)}
                yield batch({name: (got[name], kinds[kind]) for name, kind in fields})

    return texts(docs).mapInArrow(tidy(run), SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, that quality keeps: null and empty texts go, rows with equal or null doc_id are each judged, an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = encoded(b.column(1))
            for lo, hi in by_bytes(items):
                yield b.slice(lo, hi - lo).filter(pa.array(measure(items[lo:hi])["kept"]))

    return document_columns(docs).mapInArrow(tidy(run), COLUMNS_SCHEMA)


def oracle() -> str:
    """The same in SQL."""
    n_grams = sorted({*NGRAM_LIMITS, BASE_WINDOW})
    starts = ", ".join(f"CASE WHEN i + {n} <= len(words) THEN array_to_string(words[i + 1 : i + {n}], ' ') END AS g{n}" for n in n_grams)
    twice = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 THEN 1 ELSE 0 END AS t{n}" for n in n_grams)
    covered = ", ".join(f"max(t{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in n_grams)
    chars = ", ".join(f"CAST(coalesce(sum(length(word) * c{n}), 0) AS BIGINT) AS dup_chars_{n}" for n in NGRAM_LIMITS)
    bad = " OR ".join(f"dup_chars_{n} > CAST({most} AS DOUBLE) * word_chars" for n, most in NGRAM_LIMITS.items())
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, i, words, words[i + 1] AS word FROM (SELECT r, regexp_extract_all(text, '{word}') AS words FROM d), unnest(range(len(words))) AS t(i)),
g AS (SELECT r, i, word, {starts} FROM w), t AS (SELECT r, i, word, {twice} FROM g), c AS (SELECT r, word, {covered} FROM t),
s AS (SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(c{BASE_WINDOW}) AS BIGINT) AS n_repeat_words, {chars} FROM c GROUP BY r),
l AS (SELECT r, i, lines[i + 1] AS line FROM (SELECT r, string_split(text, chr(10)) AS lines FROM d), unnest(range(len(lines))) AS t(i)),
e AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM l WHERE regexp_matches(line, '{word}')),
p AS (SELECT r, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS BIGINT) AS dup_line_chars FROM e WHERE nth > 1 GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 coalesce(dup_line_chars, 0) AS dup_line_chars, {', '.join(f'coalesce(dup_chars_{n}, 0) AS dup_chars_{n}' for n in NGRAM_LIMITS)} FROM d LEFT JOIN s USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_SHARE} * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR dup_line_chars > CAST({LINE_LIMIT} AS DOUBLE) * word_chars OR n_symbols > CAST({SYMBOL_LIMIT} AS DOUBLE) * word_chars OR {bad}) AS kept FROM b"""
