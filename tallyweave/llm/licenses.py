"""Licence scan by canonical digests.

A text is brought to a canonical form: A-Z to lower case, lines of copyright
notices dropped, everything but letters and digits to single blanks, equivalent
spellings to one. Its SHA-256 is looked up among those of known licences in a
hash join; so are the digests of its lines, as notices often stand in a line of
their own (NOTICES, made of names and sentences). Only DataFrame functions; the same steps are given as SQL, with the
texts of KNOWN and a coarser rule for notices.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licences (identifier, text). Texts and notices as their owners publish them.
_MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>
"""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", _MIT.split("\n", 1)[1]),
    ("ISC", _ISC),
    ("ISC", _ISC.split("\n", 1)[1]),
    ("0BSD", _ZERO_BSD),
    ("Unlicense", _UNLICENSE),
)
# How licences are called in notices, and sentences that name them.
NAMES = (
    ("MIT", ("the MIT License",)),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0")),
    ("GPL-2.0-only", ("the GNU General Public License, version 2", "the GNU General Public License v2.0")),
    ("GPL-3.0-only", ("the GNU General Public License, version 3", "the GNU General Public License v3.0")),
    ("LGPL-2.1-only", ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1")),
    ("LGPL-3.0-only", ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0")),
    ("AGPL-3.0-only", ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the 2-Clause BSD License")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the 3-Clause BSD License")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0")),
    ("ISC", ("the ISC License",)),
    ("CC0-1.0", ("CC0 1.0",)),
    ("CC-BY-4.0", ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License")),
)
SENTENCES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.", "This program is licensed under {}.", "This file is licensed under {}.")
#: All that is known but the full texts in files.
NOTICES = tuple((name, sentence.format(called)) for name, calls in NAMES for called in calls for sentence in SENTENCES) + tuple((name, f"SPDX-License-Identifier: {name}") for name, _ in NAMES)
# Full texts that stand in license_texts (identifier, file); a text doesn't tell "only" from "or later".
FULL = (
    ("Apache-2.0", "Apache-2.0"),
    ("Artistic-1.0-Perl", "Artistic"),
    ("CC0-1.0", "CC0-1.0"),
    ("GFDL-1.2", "GFDL-1.2"),
    ("GFDL-1.3", "GFDL-1.3"),
    ("GPL-1.0", "GPL-1"),
    ("GPL-2.0", "GPL-2"),
    ("GPL-3.0", "GPL-3"),
    ("LGPL-2.0", "LGPL-2"),
    ("LGPL-2.1", "LGPL-2.1"),
    ("LGPL-3.0", "LGPL-3"),
    ("MPL-1.1", "MPL-1.1"),
    ("MPL-2.0", "MPL-2.0"),
)
# Equivalent spellings, brought to the second.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("noncommercial", "non commercial"),
    ("non infringement", "noninfringement"),
    ("https", "http"),
    ("per cent", "percent"),
    ("wilful", "willful"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Known texts that scan takes at most, as every row looks into all of them.
MOST_KNOWN = 2000
#: A line that is a copyright notice: with a year or placeholder, with (c) and an owner, or an owner alone in a paragraph of its own.
_MARK = r"(?:copyright|\(c\)|\x{a9})"
_NO_OWNER = r"(?!(?:notices?|holders?|owners?|laws?|licen[cs]e[sd]?|disclaimers?|statements?|interests?|and|or|in|on|of|is|to|for)\b)"
NOTICE_LINE = "|".join((
    rf"(?m)^[^a-z\n]*{_MARK}(?:[ \t]*{_MARK})*[ \t:,]*(?:\d{{4}}\b|[<\[{{])[^\n]*$",
    r"^[^a-z\n]*copyright[ \t]*(?:\(c\)|\x{a9})[ \t]*+(?!year\b|yyyy\b|19yy\b|19xx\b)[^\n]*$",
    rf"(?<=\A|\n[ \t\r]{{0,8}}\n)[^a-z\n]*copyright[ \t]+{_NO_OWNER}[^\n]*(?=\n[ \t\r]*\n|\n?\z|\n[ \t]*all rights)",
))
#: The SQL's notices: any line that begins so. And what is neither an ASCII letter or digit nor outside ASCII.
NOTICE = r"(?m)^[^a-z\n]*(copyright|\(c\)|\x{a9})[ \t][^\n]*$"
OTHER = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical(text: Column) -> Column:
    """The canonical form, a blank at either end."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), NOTICE_LINE, "")
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), OTHER, " ")
    for spelling, to in SPELLINGS:
        # Once more, as a word that is replaced takes the blank that an equal one after it begins with.
        for _ in range(2):
            out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {to} "))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _full_texts() -> list[tuple[str, str]]:
    """The full texts, also without what follows their terms, and the BSD ones with and without numbers, title and reservation."""
    folder = Path(__file__).parent / "license_texts"
    out = []
    for name, file in FULL:
        text = (folder / f"{file}.txt").read_text("utf-8")
        out.append((name, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(name, terms), (name, terms + end)]
    regents = (folder / "BSD.txt").read_text("utf-8")
    owner = regents.replace("name of the University", "name of the copyright holder").replace("BY THE REGENTS AND", "BY THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    for three in (regents, owner):
        third, end = three.index("3. Neither"), three.index("THIS SOFTWARE")
        for name, text in (("BSD-3-Clause", three), ("BSD-2-Clause", three[:third] + three[end:])):
            body = text[text.index("Redistribution") :]
            for rules in (body, re.sub(r"(?m)^\d\. ", "* ", body)):
                out += [(name, f"{title}{rights}{rules}") for title in ("", f"{name.replace('-', ' ', 1)} License\n\n") for rights in ("", "All rights reserved.\n\n")]
    return out


def known(spark: SparkSession, licenses: DataFrame | None = None) -> DataFrame:
    """(digest, license, form) of the known texts, KNOWN, NOTICES and the full texts unless others are given as (license, text); form is canonical.

    Of licences whose texts have the same form, the first by name. Null and blank texts are dropped.
    """
    rows = spark.createDataFrame([*KNOWN, *NOTICES, *_full_texts()], "license string, text string") if licenses is None else licenses.select("license", "text").limit(MOST_KNOWN + 1)
    held = rows.select(canonical(F.col("text")).alias("form"), "license").where("license is not null and trim(form) <> ''")
    return held.groupBy("form").agg(F.min("license").alias("license")).select(F.sha2(F.col("form").cast("binary"), 256).alias("digest"), "license", "form")


def _needed(forms: list[str]) -> str:
    """A pattern that any line with one of the forms matches: "license" in some spelling, or else the form's last words, as far as no spelling touches them."""
    touched = {w for _, to in SPELLINGS for w in to.split()}
    found = {"licen[cs]e"}
    for form in forms:
        if "license" not in form:
            tail: list[str] = []
            for w in reversed(form.split()[-4:]):
                if w in touched:
                    break
                tail.insert(0, re.escape(w))
            found.add(OTHER.join(tail))
    return "" if "" in found else "|".join(sorted(found))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (of the entire text), line_licenses and n_license_lines.

    Known licences are KNOWN, NOTICES and the full texts in license_texts, or
    those of the given table (license, text), of at most MOST_KNOWN rows;
    ValueError for more. The digests of entire texts and of lines meet those of
    the known texts in a hash join, and only what is found moves further. A null
    text is as an empty one, and matches nothing; licences of lines are distinct,
    ascending and joined by blanks, an empty string if there are none; rows with
    equal or null doc_id are each scanned; very long texts are scanned whole; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    if licenses is not None and licenses.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences")
    table = known(spark, licenses).collect()  # at most MOST_KNOWN rows
    held = spark.createDataFrame([(r["digest"], r["license"]) for r in table], "digest string, license string")
    needed = _needed([r["form"] for r in table])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.length("text")
    whole = rows.select("doc_id", F.xxhash64("text", size).alias("h"), digest(F.col("text")).alias("digest"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike(needed))
    parts = rows.select("doc_id", F.xxhash64("text", size).alias("h"), F.posexplode(F.transform(lines, digest)).alias("at", "digest"))
    found = parts.join(F.broadcast(held), "digest").groupBy(F.col("doc_id").alias("of"), F.col("h").alias("h_of")).agg(F.array_join(F.array_sort(F.collect_set("license")), " ").alias("line_licenses"), F.count_distinct("at").alias("n_license_lines"))
    # Rows with the same doc_id and hash are the same text, and what is found in it is counted by line, once.
    told = whole.join(F.broadcast(held), "digest", "left")
    met = told.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("h_of")), "left")
    return met.select("doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def _apart(words: str) -> str:
    return words.replace(" ", "  ")


def _sql_canonical(text: str) -> str:
    """The canonical form in SQL, where each word has blanks of its own while spellings are replaced."""
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{NOTICE}', '', 'g')"
    out = f"regexp_replace(' ' || {out} || ' ', '{OTHER}', ' ', 'g')"
    out = f"replace({out}, ' ', '  ')"
    for spelling, to in SPELLINGS:
        out = f"replace({out}, ' {_apart(spelling)} ', ' {_apart(to)} ')"
    return f"replace({out}, '  ', ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in (*KNOWN, *NOTICES))
    return f"""
WITH known AS (SELECT DISTINCT sha256({_sql_canonical('t')}) AS digest, name FROM (VALUES {values}) AS v(name, t)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT r, doc_id, sha256({_sql_canonical('text')}) AS digest FROM docs),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (SELECT r, name FROM (SELECT r, sha256({_sql_canonical('line')}) AS digest FROM lines WHERE regexp_matches(translate(line, '{UPPER}', '{LOWER}'), 'licen[cs]e')) JOIN known USING (digest)),
summed AS (SELECT r, string_agg(DISTINCT name, ' ' ORDER BY name) AS line_licenses, count(*) AS n FROM found GROUP BY r)
SELECT doc_id, whole.digest, known.name AS license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM whole LEFT JOIN known ON known.digest = whole.digest LEFT JOIN summed USING (r)"""
