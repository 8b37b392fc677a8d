"""Licence scans by canonical digests, in DataFrame functions only.

A text's canonical form: lower case, without copyright notices, equivalent spellings made one, every run of other characters than letters and digits
one space. Paragraphs end at lines without letters and digits, other line breaks count as spaces, so it doesn't matter how a text is wrapped. A notice begins
a paragraph with a mark of copyright and a year or second mark (an item "(c)" is none); it is a paragraph of at most 60 words (also one that goes on with other words: what stands with a holder's name can't be told from it), or the first line of a longer one. Its SHA-256 is looked up among the digests of known licences' canonical forms. The units looked up are the whole text and each of its lines, so
a document that is a licence and a document that carries a notice line are both found; a unit matches as a whole or not at all.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: spellings that licence matching treats as equal, in the order in which they are replaced
EQUIVALENT = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("noninfringement", "non-infringement"),
    ("merchantibility", "merchantability"),
    ("https://", "http://"),
    ("version 2.0", "version 2"),
    ("version 3.0", "version 3"),
    ("&", " and "),
)

# fixed values: public licence texts and notices
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Licensed under the MIT License.",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "SPDX-License-Identifier: ISC",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}


#: Lines that stand above or instead of a text's own heading.
HEADINGS: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License"),
    "BSD-3-Clause": ("The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def whole_texts() -> dict[str, tuple[str, ...]]:
    """The whole texts in the folder license_texts, and those of MIT and ISC in KNOWN, each with and without its heading and the appendix after its terms."""
    out = {}
    files = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
    for name, text in {**files, "MIT": KNOWN["MIT"][0], "ISC": KNOWN["ISC"][0]}.items():
        found = [text]
        parts = re.split(r"\n\s*\n", text.strip(), maxsplit=2)
        if name not in ("MIT", "ISC", "Unlicense"):
            found.append("\n\n".join(parts[1:]))
        if name == "CC0-1.0":  # two headings
            found.append(parts[2])
        for x in list(found):
            terms, end, _ = x.partition("END OF TERMS AND CONDITIONS")
            if end:
                found += [terms, terms + end]
        if name.startswith("BSD"):
            bare = found[1]
            numbered = re.sub(r"(?m)^\d\. ", "* ", bare)
            found += [numbered, *(f"All rights reserved.\n\n{x}" for x in (bare, numbered))]
            found += [f"{parts[0]}\n\n{x}" for x in found[2:]]
        found += [f"{heading}\n\n{x}" for heading in HEADINGS.get(name, ()) for x in list(found) if not x.startswith(parts[0]) or name in ("MIT", "ISC", "Unlicense")]
        out[name] = tuple(dict.fromkeys(found))
    return out


#: Between paragraphs, and between the lines of one.
_PARAGRAPH, _LINE = "\x1e", "\x1f"
_GAP, _WORD = r"[ \x1f]", r"[^ \x1e\x1f]"
_MARK, _YEAR = r"(?:©|\(c\))", r"(?:[0-9]{4}|[\[<{(](?:yyyy|year)[\]>})])"
_NOTICE = rf"(^|\x1e)[^\p{{L}}\p{{N}}©(\x1e]*(?:copyright:?{_GAP}?{_MARK}|copyright:?{_GAP}{_YEAR}|{_MARK}{_GAP}?(?:copyright|{_YEAR})){_WORD}*"
#: One of these is in every text that may be looked up, or all are canonicalised.
ANCHORS = ("licen", "permission", "rights", "domain")


def canonical(text: Column) -> Column:
    """Empty for a text that has no letters or digits outside copyright notices."""
    out = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\x0b\f\xa0]+", " ")
    out = F.regexp_replace(out, r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}©(]*", _PARAGRAPH * 2)  # two, so that neighbours share none
    out = F.replace(out, F.lit("\n"), F.lit(_LINE))
    out = F.regexp_replace(out, rf"{_NOTICE}(?:{_GAP}+{_WORD}+){{0,60}}{_GAP}*(\x1e|$)", "$1$2")
    for _ in range(2):
        out = F.regexp_replace(out, rf"{_NOTICE}(?: +{_WORD}+){{0,24}} *\x1f", "$1")
    out = F.translate(out, _PARAGRAPH + _LINE, "  ")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def _may_be(text: Column, *lists: Mapping[str, tuple[str, ...]]) -> Column:
    """Whether a text has one of ANCHORS, without which it can be none of the known ones; true if one of these has none."""
    if not all(any(a in text.lower() for a in ANCHORS) for known in lists for texts in known.values() for text in texts):
        return F.lit(True)
    low, out = F.lower(text), F.lit(False)
    for a in ANCHORS:
        out = out | F.contains(low, F.lit(a))
    return out


def known_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """(digest, license), one row for each known text; its size is that of the list given."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    return spark.createDataFrame(rows, "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


#: Known digests that are broadcast at most; a longer list is joined by a shuffle.
BROADCAST = 100_000


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: Mapping[str, tuple[str, ...]] = KNOWN, whole: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, text_license, line_licenses, n_license_lines) for every row.

    text_license: the licence that the whole text is, of those in known and whole (whole_texts() if None), null if none. line_licenses: names of licences and notices that single lines are, sorted, each once, joined by
    commas, empty if none; n_license_lines counts the lines. Both units are hash-joined to the known digests. Null and empty texts are no licence; very long texts and lines are taken whole; repeated rows give repeated rows; other
    columns are ignored, whatever their names. An empty table gives an empty one. The texts aren't shuffled: of the lines only those that are known are, and a text's digest with its key.
    """
    spark, long = docs.sparkSession, whole_texts() if whole is None else whole
    sent = lambda df, *lists: F.broadcast(df) if sum(len(x) for of in lists for x in of.values()) <= BROADCAST else df
    lines = known_digests(spark, known)
    texts = sent(lines.union(known_digests(spark, long).join(lines, "digest", "left_anti")), known, long)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("own", F.sha2("text", 256))
    cut = rows.where(_may_be(F.col("text"), known)).select("own", F.posexplode(F.split("text", "\n")).alias("line", "unit")).where(_may_be(F.col("unit"), known)).select("own", "line", F.sha2(canonical(F.col("unit")), 256).alias("digest"))
    # copies of a text have the same lines
    hits = cut.join(sent(lines, known), "digest").groupBy("own", "line").agg(F.min("license").alias("license")).groupBy("own").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"), F.count("*").alias("n"))
    whole_digest = F.when(_may_be(F.col("text"), known, long), F.sha2(canonical(F.col("text")), 256))
    found = rows.select("key", "own", whole_digest.alias("digest")).join(texts, "digest", "left").join(hits, "own", "left")
    return found.select(F.col("key").alias(key), F.col("license").alias("text_license"), F.coalesce("names", F.lit("")).alias("line_licenses"), F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"))
