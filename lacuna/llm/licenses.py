"""Licence texts found by the digest of their canonical form; DataFrame functions only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Spellings that licence matching treats as equal, applied to lower-case words in this order.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"),
    ("non infringement", "noninfringement"), ("whilst", "while"),
    ("wilful", "willful"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("per cent", "percent"), ("v", "version"), ("gpl", "general public license"), ("attribution", "by"),
    ("noncommercial", "nc"), ("non commercial", "nc"), ("creative commons", "cc"),
]

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and \
associated documentation files (the "Software"), to deal in the Software without restriction, including without \
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the \
Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING \
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO \
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN \
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER \
DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without \
fee is hereby granted"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS \
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR \
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR \
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH \
THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted \
provided that the following conditions are met:"""
_BSD_CLAUSES = ["""Redistributions of source code must retain the above copyright notice, this list of conditions and \
the following disclaimer.""", """Redistributions in binary form must reproduce the above copyright notice, this list of \
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
                """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or \
promote products derived from this software without specific prior written permission."""]
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR \
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A \
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, \
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF \
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY \
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT \
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd(n: int) -> list[tuple[str, str]]:
    """The complete text of n clauses, with and without its title and the clauses' numbers."""
    titles = ["", f"BSD {n}-Clause License\n\n"]
    if n == 2:
        titles += ['BSD 2-Clause "Simplified" License\n\n']
    else:
        titles += ['BSD 3-Clause "New" or "Revised" License\n\n']
    lists = ["\n".join(f"{mark(i)} {c}" for i, c in enumerate(_BSD_CLAUSES[:n], 1)) for mark in (lambda i: "*", lambda i: f"{i}.")]
    return [(f"BSD-{n}-Clause", f"{t}Copyright (c) <year>, <holder>\n\n{_BSD_GRANT}\n\n{x}\n\n{_BSD_DISCLAIMER}")
            for t in titles for x in lists]


def _notices() -> list[tuple[str, str]]:
    """The usual one-line notices of each identifier."""
    names = {"MIT": ["MIT License"], "ISC": ["ISC License"], "0BSD": ["Zero Clause BSD License"], "Unlicense": ["Unlicense"],
             "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
             "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
             "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
             "MPL-1.1": ["Mozilla Public License, v. 1.1"], "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"]}
    for kind, name, versions in (("GPL", "General", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")),
                                 ("AGPL", "Affero General", ("3.0",))):
        for v in versions:
            short = v.removesuffix(".0")
            names[f"{kind}-{v}-only"] = [f"GNU {name} Public License, version {short}", f"GNU {name} Public License v{v}"]
            names[f"{kind}-{v}-or-later"] = [f"GNU {name} Public License, version {short} or later",
                                             f"GNU {name} Public License, version {short} or any later version"]
    out = [(k, f"{verb} under the {n}.") for k, ns in names.items() for n in ns
           for verb in ("Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed")]
    words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = "-".join(words[w] for w in parts.split("-"))
        for v, word in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            names[f"CC-{parts}-{v}"] = []
            out += [(f"CC-{parts}-{v}", f"{verb} under {n}.") for verb in (
                "Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed") for n in (
                f"CC {parts} {v}", f"a Creative Commons {long} {v} {word} License", f"the Creative Commons {long} {v} {word} License",
                f"Creative Commons {long} {v}")]
    ids = [*names, "MIT-0", "CC0-1.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "GFDL-1.2-only", "GFDL-1.3-only"]
    return out + [(k, f"SPDX-License-Identifier: {k}") for k in ids]


def _texts() -> list[tuple[str, str]]:
    """The complete texts of ``license_texts``, named by SPDX identifier."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        body = path.read_text(encoding="utf-8")
        out.append((path.stem, body))
        terms, end, _ = body.partition("END OF TERMS AND CONDITIONS")
        if end:  # also without the appendix on how to apply it
            out += [(path.stem, terms + end), (path.stem, terms)]
        if "All Rights Reserved." in body:  # it can come to begin a line
            out.append((path.stem, body.replace("All Rights Reserved.", "")))
    return out


# Public licence texts and one-line notices, by SPDX identifier.
KNOWN = [
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holder>\n\n{_MIT_GRANT}, subject to the following conditions:\n\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial "
            f"portions of the Software.\n\n{_MIT_DISCLAIMER}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-0", f"MIT No Attribution\n\nCopyright <year> <holder>\n\n{_MIT_GRANT}.\n\n{_MIT_DISCLAIMER}"),
    ("ISC", f"ISC License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}, provided that the above copyright notice "
            f"and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    *_bsd(2), *_bsd(3), *_texts(), *_notices(),
]


# How a copyright line begins, the sentences of GNU texts that follow in the same paragraph, and the
# examples of a notice in them, which need not begin a line.
_MARK = "[0-9]{4}|<|\\[|\\{|year |yyyy"
_FOLLOWS = "(?:\n[ \t]*)?(everyone[ \t\n]+is[ \t\n]+permitted|permission[ \t\n]+is[ \t\n]+granted)"
_EXAMPLE = "copyright[ \t\n]+\\(c\\)[ \t\n]+(?:<year>|19yy|year)[ \t\n]+(?:<?name[ \t\n]+of[ \t\n]+author>?|your[ \t\n]+name)"
NOTICE = (f"(?:^|\n)[ \t]*(?:{_EXAMPLE}|"
          f"(?:copyright:?[ \t]*(?:\\(c\\)|©|{_MARK})|(?:\\(c\\)|©)[ \t]*(?:copyright[ \t]*)?(?:{_MARK}))"
          f"(?:(?:[^\n]|\n[ \t]*[^ \t\n]){{0,300}}?{_FOLLOWS}|[^\n]*)|all rights reserved[^\n]*)|{_EXAMPLE}")


def canonical(text: Column) -> Column:
    """The form whose digest is looked up.

    Copyright lines are removed: those that begin with "copyright" and a year, "(c)", © or a placeholder, not sentences
    that a line break has brought to such a word; in a paragraph that goes on with the sentence of the GNU texts, all
    that stands before it. A-Z are lower-cased, ASCII punctuation and white space folded into single spaces,
    "(c)" and equivalent spellings unified. Other characters are kept as they are. Null stays null.
    """
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, NOTICE, "\n$1")
    out = F.regexp_replace(out, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")
    # Words are framed by two spaces each, so that neighbours of one spelling do not share one.
    out = F.concat(F.lit(" "), F.regexp_replace(F.trim(out), " ", "  "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(" " + a.replace(" ", "  ") + " "), F.lit(" " + b.replace(" ", "  ") + " "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, lowercase hex."""
    return F.sha2(canonical(text), 256)


def catalogue(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license, license_digest): one row per known digest. Of two licences with one digest the first name stays."""
    known = spark.createDataFrame(texts, "license string, body string")
    return known.select("license", digest(F.col("body")).alias("license_digest")).groupBy("license_digest").agg(
        F.min("license").alias("license"))


def scan_texts(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with text_digest and license: the licence that the entire text is, or null.

    A null text has a null digest and no licence; an empty one has the digest of the empty form. Rows are neither
    lost nor multiplied. Existing columns of the two names are replaced.
    """
    own = [c for c in docs.columns if c not in ("text_digest", "license")]
    hashed = docs.select(*own, digest(F.col(text_col).cast("string")).alias("text_digest"))
    names = known.select(F.col("license_digest").alias("_known_digest"), "license").dropDuplicates(["_known_digest"])
    return hashed.join(names, hashed["text_digest"] == names["_known_digest"], "left").select(
        *[hashed[c] for c in own], "text_digest", "license")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_digest, license, line_licenses (array of licence names), n_license_lines.

    The whole text and each of its lines are entire texts to look up: a notice usually stands alone on a line.
    Lines are told to be worth a digest by no prefilter. Known digests that hit are gathered per row as
    (digest, count) pairs, never the lines.

    Repeated rows are one group and come back as often as they were there; null ids and texts are kept.
    """
    body = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), body.alias("text"), F.xxhash64(body).alias("row"))
    lines = rows.select("id", "row", F.explode(F.split("text", "\n")).alias("line"), F.lit(1).alias("one"))
    # A join key that can be null is computed twice, for a filter on it and for the join; a line is never null.
    key = F.coalesce(digest(F.col("line")), F.lit(""))
    hit = lines.where(F.trim("line") != "").select("id", "row", key.alias("d")).join(
        known.select(F.col("license_digest").alias("d"), "license").dropDuplicates(["d"]), "d")
    found = hit.groupBy("id", "row").agg(F.array_sort(F.collect_set("license")).alias("names"),
                                         F.count("*").alias("hits"))
    copies = rows.groupBy("id", "row").agg(F.count("*").alias("copies"))
    per = found.alias("f").join(copies.alias("c"), F.col("f.id").eqNullSafe(F.col("c.id"))
                                & F.col("f.row").eqNullSafe(F.col("c.row"))).select(
        F.col("f.id").alias("_hit_id"), F.col("f.row").alias("_hit_row"), "names",
        (F.col("hits") / F.col("copies")).cast("long").alias("hits"))
    whole = scan_texts(rows, known)
    return whole.join(per, F.col("id").eqNullSafe(F.col("_hit_id")) & (F.col("row") == F.col("_hit_row")), "left").select(
        "id", "text_digest", "license", F.coalesce("names", F.array().cast("array<string>")).alias("line_licenses"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("n_license_lines"))
