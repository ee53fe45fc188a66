"""License notices by recognised sentences and ordered rules, in DataFrame functions only.

A text is normalised (lower case, letters and digits only; comment marks go with the rest) and
looked through for known license sentences. A sentence ends at a stop mark, a semicolon, a
colon or a blank line. A single line break ends one too, but may also stand inside one, so
that hard-wrapped notices and headings without a stop mark are both read. A known wording
that holds such a mark is several sentences, and rules list all of them. What is recognised
becomes a sequence of sentence identifiers, in text order, and rules match that sequence: a
rule is an ordered list of identifiers, which may be interrupted by sentences that are not
known. Longer rules are tried first and take their sentences, so a three-clause notice is not
also a two-clause one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences in their usual wording; {v} stands for a version number.
SENTENCES = {
    "mit-name": ["The MIT License", "MIT License", "The MIT License (MIT)", "Released under the MIT License",
                 "Licensed under the MIT License", "This project is licensed under the MIT License",
                 "Distributed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                  "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                  "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                  "furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
              "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                      "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                      "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                  "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                  "all copies"],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
                     "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and "
                   "the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                   "and the following disclaimer in the documentation and/or other materials provided with the "
                   "distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission"],
    "bsd-name": ["Licensed under the BSD License", "Released under the BSD License",
                 "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "apache-{v}": ["Licensed under the Apache License, Version {v}", "Released under the Apache License, Version {v}",
                   "Licensed under the Apache License, Version {v} (the \"License\")",
                   "Apache License, Version {v}", "SPDX-License-Identifier: Apache-{v}"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-obtain": ["You may obtain a copy of the License at"],
    "gpl-{v}": ["This work is licensed under the GNU General Public License, version {v}",
                "Licensed under the GNU General Public License, version {v}",
                "GNU General Public License version {v}", "GNU General Public License, version {v}"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version {v} of the "
                 "License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                     "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-{v}": ["Licensed under the GNU Lesser General Public License, version {v}",
                 "GNU Lesser General Public License, version {v}"],
    "mpl-{v}": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}",
                "Licensed under the Mozilla Public License, version {v}"],
    "cc-by-{v}": ["Licensed under CC BY {v}", "This work is licensed under CC BY {v}",
                  "This work is licensed under a Creative Commons Attribution {v} International License"],
    "cc-by-sa-{v}": ["Licensed under CC BY-SA {v}", "This work is licensed under CC BY-SA {v}",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License"],
    "cc-by-nc-{v}": ["Licensed under CC BY-NC {v}", "This work is licensed under CC BY-NC {v}",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial {v} International License"],
    "cc-by-nc-sa-{v}": ["Licensed under CC BY-NC-SA {v}", "This work is licensed under CC BY-NC-SA {v}"],
    "cc-by-nd-{v}": ["Licensed under CC BY-ND {v}", "This work is licensed under CC BY-ND {v}"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work", "Released under CC0 1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved"],
}
VERSIONS = ["1.0", "1.1", "2.0", "2.1", "2.5", "3.0", "4.0", "1", "2", "3"]
# Ordered rules. A license needs its identifiers in this order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-{v}", ["apache-{v}", "apache-comply", "apache-obtain"]),
    ("GPL-{v}-or-later", ["gpl-free-{v}", "gpl-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("GPL-{v}-or-later", ["gpl-free-{v}"]),
    ("Apache-{v}", ["apache-{v}"]),
    ("MIT", ["mit-name"]),
    ("BSD", ["bsd-name"]),
    ("ISC", ["isc-grant"]),
    ("GPL-{v}", ["gpl-{v}"]),
    ("LGPL-{v}", ["lgpl-{v}"]),
    ("MPL-{v}", ["mpl-{v}"]),
    ("CC-BY-{v}", ["cc-by-{v}"]),
    ("CC-BY-SA-{v}", ["cc-by-sa-{v}"]),
    ("CC-BY-NC-{v}", ["cc-by-nc-{v}"]),
    ("CC-BY-NC-SA-{v}", ["cc-by-nc-sa-{v}"]),
    ("CC-BY-ND-{v}", ["cc-by-nd-{v}"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("All-Rights-Reserved", ["proprietary"]),
]
#: Every known sentence holds one of these; texts and sentences without them are not looked up.
CUES = ["licens", "permission", "redistribut", "warrant", "liable", "copyright", "public domain", "free software",
        "rights reserved", "cc0"]


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def plain(sentence: str) -> str:
    """What :func:`normal` makes of a sentence of the list above."""
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


#: A stop that ends no sentence: of "v. 2.0" and of the colon in an SPDX line.
INNER = r"(\bv(?=\.[^\p{L}\p{N}]+[0-9])|spdx-license-identifier(?=:))[^\p{L}\p{N}]+"
STOP = r"(?<=[.!?])\s+|[;:]\s"


def parts(wording: str) -> list[str]:
    """The sentences of a known wording, by the marks that split a text."""
    kept = re.sub(r"(?i)(\bv)\. (?=[0-9{])|(spdx-license-identifier): ", lambda m: m[0].rstrip(".: ") + " ", wording)
    return re.split(STOP, kept)


def part_names(name: str, wording: str) -> list[str]:
    """Identifiers of the sentences of a wording: the last has the name, versions go where they stand."""
    found = parts(wording)
    names = [*[f"{name.removesuffix('-{v}')}-part{k}" for k in range(1, len(found))], name]
    return [f"{n}-{{v}}" if "{v}" in p and "{v}" not in n else n for n, p in zip(names, found)]


def known() -> dict[str, str]:
    """Normalised sentence to identifier, versions spelled out."""
    out: dict[str, str] = {}
    for name, wordings in SENTENCES.items():
        for wording in wordings:
            for key, part in zip(part_names(name, wording), parts(wording)):
                if "{v}" in part:
                    out |= {plain(part.replace("{v}", v)): key.replace("{v}", v.removesuffix(".0")) for v in VERSIONS}
                else:
                    out[plain(part)] = key
    return out


def rules() -> list[tuple[str, list[str]]]:
    """Rules with versions spelled out, longest first."""
    out: list[tuple[str, list[str]]] = []
    whole = {part_names(name, w[0])[-1]: part_names(name, w[0]) for name, w in SENTENCES.items()}
    for name, listed in RULES:
        ids = [p for i in listed for p in whole[i]]
        if any("{v}" in i for i in ids):
            versions = dict.fromkeys(v.removesuffix(".0") for v in VERSIONS)
            out += [(name.replace("{v}", v if "." in v or name.startswith("GPL") else f"{v}.0"),
                     [i.replace("{v}", v) for i in ids]) for v in versions]
        else:
            out.append((name, ids))
    return sorted(out, key=lambda r: -len(r[1]))


def has_cue(text: Column) -> Column:
    """Whether a text holds a cue; the words of one may be wrapped, also in a comment."""
    lower = F.lower(text)
    out = lower.rlike("|".join(c.replace(" ", r"[^\p{L}\p{N}]+") for c in CUES if " " in c))
    for cue in CUES:
        out = out if " " in cue else out | lower.contains(cue)
    return out


def marked_words(text: Column) -> Column:
    """Words with one mark between two: ``|`` where a sentence ends, a line break, or a space."""
    lines = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    stops = F.regexp_replace(F.regexp_replace(lines, INNER, "$1 "), STOP, "\u0001")
    bare = F.regexp_replace(F.regexp_replace(stops, r"[^\p{L}\p{N}\u0001\n]+", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(bare, "\n\n+|[ \n]?\u0001[ \n]?", "|"))


def known_pattern() -> str:
    """Any known sentence between two marks, the longest first, over single line breaks."""
    wordings = sorted(known(), key=lambda w: (-len(w), w))
    return r"(?<![^|\n])(?:" + "|".join(w.replace(" ", r"[ \n]") for w in wordings) + r")(?![^|\n])"


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (known sentences in order), ``licenses`` (sorted, distinct)
    and ``unknown_sentences`` (how many mention a cue but are not known).

    Null, empty and cue-less texts have none of them; repeated rows are alike; columns of
    ``docs`` with those names are replaced. Everything is row by row: no exchange.
    """
    docs = docs.drop("sentence_ids", "licenses", "unknown_sentences")
    none = F.array().cast("array<string>")
    lookup = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    pattern = known_pattern()
    marked = docs.withColumn("_words", F.when(has_cue(F.col(text_col)), marked_words(F.col(text_col))))
    found = F.transform(F.regexp_extract_all("_words", F.lit(pattern), F.lit(0)),
                        lambda s: F.element_at(lookup, F.translate(s, "\n", " ")))
    others = F.filter(F.split(F.regexp_replace("_words", pattern, "|"), r"\|+"), has_cue)
    marked = marked.withColumns({"sentence_ids": F.coalesce(found, none),
                                 "unknown_sentences": F.coalesce(F.size(F.when(F.col("_words").isNotNull(), others)), F.lit(0))})
    # the sequence as text, one identifier between bars; a matched rule takes its identifiers away
    steps = F.named_struct(F.lit("rest"), F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|")),
                           F.lit("found"), F.array().cast("array<string>"))
    table = F.array(*[F.struct(
        F.lit(name).alias("name"),
        F.lit("".join(("(.*?)" if k else "") + rf"\|{i.replace('.', '[.]')}\|" for k, i in enumerate(wanted))).alias("pattern"),
        F.lit("".join(f"${k}" for k in range(1, len(wanted)))).alias("between")) for name, wanted in rules()])
    matched = F.aggregate(table, steps, lambda state, rule: F.when(
        F.regexp_like(state["rest"], rule["pattern"]), F.named_struct(
            F.lit("rest"), F.regexp_replace(state["rest"], rule["pattern"], rule["between"]),
            F.lit("found"), F.array_append(state["found"], rule["name"]))).otherwise(state))
    licenses = F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(matched["found"]))).otherwise(
        F.array().cast("array<string>"))
    return marked.withColumn("licenses", licenses).drop("_words")
