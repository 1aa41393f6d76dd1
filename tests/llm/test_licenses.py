"""Full licence texts, tables of licences from the caller, and texts wrapped anew."""

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import licenses


def scanned(spark, texts, known=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r.doc_id, r) for r in licenses.scan(docs, known).collect())]


def test_full_texts(spark):
    texts = licenses._full_texts()
    assert {n for n, _ in texts} >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Artistic-1.0-Perl"}
    got = scanned(spark, [t for _, t in texts] + [t.upper() + "x" for _, t in texts])
    assert [r.license for r in got] == [n for n, _ in texts] + [None] * len(texts)


def test_given_licenses(spark):
    known = spark.createDataFrame([("House", "Free for all\nwho ask kindly."), ("Other", "Ask before use"), ("Null", None)], "license string, text string")
    got = scanned(spark, ["FREE for all who\nask kindly", "a\nAsk, before use!\nb", licenses.KNOWN[0][1], ""], known)
    assert [(r.license, r.line_licenses) for r in got] == [("House", ""), (None, "Other"), (None, ""), (None, "")]
    assert [r.license for r in scanned(spark, ["Ask before use"], known.limit(0))] == [None]
    with pytest.raises(ValueError):
        licenses.scan(known.select(F.lit(1).alias("doc_id"), "text"), spark.range(licenses.MOST_KNOWN + 1).select(F.col("id").cast("string").alias("license"), F.lit("x").alias("text")))


NOTICE = re.compile(r"\W*copyright (\(c\) )?(<|\[|\d{4}|the regents)", re.I)


def wrapped(text, width):
    """Paragraphs filled anew; lines of copyright notices stay lines."""
    out = []
    for paragraph in re.split(r"\n[ \t]*\n", text):
        lines = [[]]
        for line in paragraph.split("\n"):
            if NOTICE.match(line):
                lines += [[line], []]
            else:
                lines[-1].append(line)
        out.append("\n".join(x[0] if len(x) == 1 and NOTICE.match(x[0]) else textwrap.fill(" ".join(x), width, break_long_words=False, break_on_hyphens=False) for x in lines if x))
    return "\n\n".join(out)


def test_wrapped_texts(spark):
    texts = [*licenses.KNOWN, *licenses._full_texts()]
    got = scanned(spark, [wrapped(t, w) for w in (70, 72, 74, 76, 78, 80) for _, t in texts])
    missed = [(n, w) for (n, w), r in zip([(n, w) for w in (70, 72, 74, 76, 78, 80) for n, _ in texts], got) if r.license != n]
    assert not missed


def test_notices(spark):
    drop = ["copyright 2019 jane", "copyright (c) <year> <owner>", "(c) 2001 x", "© 2020 y", "copyright © 2020", "// copyright (c) microsoft corporation.", "copyright [yyyy] [name]", "copyright jane doe"]
    stay = ["copyright notice and this permission notice appear in all copies.", "copyright holders be liable", "(c) you must retain all notices", "copyright and related rights", "copyrighted 2019"]
    rows = spark.createDataFrame([(x,) for x in drop + stay], "t string").select("t", F.trim(licenses.canonical(F.col("t"))).alias("c")).collect()
    assert {r.t for r in rows if not r.c} == set(drop)
