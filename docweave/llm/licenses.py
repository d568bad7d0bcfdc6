"""Licence scans: Dice coefficient over word bigrams against templates; DataFrame operations only.

The blocks of a text are its lines, its paragraphs and the whole of it. A block is
compared only with templates whose size could still reach the limit, and a text is
looked into only if it has one of the guard words of which every match has one. All of
it is one projection without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 0.8

# fixed values: wordings of public licences and of notices that name them
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Clauses that ``find_notices`` looks for besides the templates; the blocks of ``scan_licenses`` are not compared with them.
CLAUSES: list[tuple[str, str]] = [
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
]
#: Words too frequent in any English text to guard with.
_COMMON = set("a all an and any as at by can for in is it of on or the this to under with work you your".split())

#: Keeps sizes that are exactly at a bound.
_ROUNDING = 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = _template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def guard_words(limit: float = LIMIT, templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    """Words of which every block has at least one that reaches ``limit`` with some template.

    A match shares at least ``b * limit / (2 - limit)`` of a template's ``b`` bigrams, so
    one of any larger number than the rest is among them: long words of the template are
    taken until they stand in that many.
    """
    guard: set[str] = set()
    for _, text in templates:
        grams = [g.split() for g in template_bigrams(text)]
        words = sorted({w for g in grams for w in g}, key=lambda w: (w in _COMMON, -len(w), w))
        chosen: set[str] = set()
        for word in words:
            if sum(not chosen.isdisjoint(g) for g in grams) > len(grams) * (1 - limit / (2 - limit)) + _ROUNDING:
                break
            chosen.add(word)
        guard |= chosen
    return sorted(guard)


def _guard(words: list[str]) -> str:
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"


def _all_bigrams(block: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.translate(block, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(block: Column) -> Column:
    return F.array_distinct(_all_bigrams(block))


def _templates(templates: list[tuple[str, str]] = TEMPLATES) -> Column:
    rows = [
        F.struct(
            F.lit(name).alias("license"),
            F.array(*map(F.lit, template_bigrams(text))).alias("grams"),
            F.lit(len(_template_words(text))).alias("n_words"),
        )
        for name, text in templates
    ]
    return F.array(*rows)


def scan_licenses(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``doc_id`` and ``matches`` (block, license, dice) per row of ``docs(doc_id, text)``.

    Every block is listed with its best template if their Dice coefficient is at least
    ``limit``; equal scores go to the alphabetically first licence. Equal blocks of a
    text count once. A null, empty or one-word text has no matches. Repeated rows are
    scanned each; other columns are ignored. A notice inside a longer block, or over
    several lines of a comment, is no block: ``find_notices`` finds those.
    """
    text = F.col("text")
    guard = _guard(guard_words(limit))
    low, high = limit / (2 - limit) - _ROUNDING, (2 - limit) / limit + _ROUNDING

    def best(block: Column) -> Column:
        grams = block["grams"]
        size = F.size(grams)
        fitting = F.filter(
            _templates(), lambda t: (size >= F.size(t["grams"]) * F.lit(low)) & (size <= F.size(t["grams"]) * F.lit(high))
        )
        scored = F.transform(
            fitting,
            lambda t: F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (size + F.size(t["grams"]))).alias("dice"),
                t["license"].alias("license"),
            ),
        )
        enough = F.array_sort(F.filter(scored, lambda s: s["dice"] >= limit), _better)
        return F.struct(
            block["block"].alias("block"), F.get(enough, 0)["license"].alias("license"), F.get(enough, 0)["dice"].alias("dice")
        )

    blocks = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, "\n[ \t\r]*\n", -1), F.array(text)))
    largest = max(len(template_bigrams(t)) for _, t in TEMPLATES) * high
    sized = F.filter(
        F.transform(
            F.filter(blocks, lambda b: b.rlike(guard)), lambda b: F.struct(b.alias("block"), _bigrams(b).alias("grams"))
        ),
        lambda b: (F.size(b["grams"]) > 0) & (F.size(b["grams"]) <= largest),
    )
    matches = F.filter(F.transform(sized, best), lambda m: m["license"].isNotNull())
    none = F.array().cast("array<struct<block:string,license:string,dice:double>>")
    found = F.when(text.rlike(guard), matches)
    return docs.select("doc_id", F.coalesce(found, none).alias("matches"))


def find_notices(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``doc_id`` and ``notices`` (license, first_word, n_words, dice) per row of ``docs(doc_id, text)``.

    A notice is any run of as many words as a template or clause has (fewer at the end of
    the text) that begins with one of its bigrams and has a Dice coefficient of at least
    ``limit`` with it; overlapping runs are all listed. Words are runs of ASCII letters and
    digits, so line breaks and comment marks do not part a notice. Only templates of whose
    bigrams the text has enough are looked for word by word.
    """
    text, known = F.col("text"), TEMPLATES + CLAUSES
    least = limit / (2 - limit) - _ROUNDING

    def runs(grams: Column, t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(t["grams"], F.get(grams, i - 1)))

        def score(i: Column) -> Column:
            part = F.slice(grams, i, t["n_words"] - 1)
            both, own = F.size(F.array_intersect(part, t["grams"])), F.size(F.array_distinct(part))
            return F.struct(
                t["license"].alias("license"),
                (i - 1).alias("first_word"),
                (F.size(part) + 1).alias("n_words"),
                (F.lit(2.0) * both / (own + F.size(t["grams"]))).alias("dice"),
            )

        return F.filter(F.transform(starts, score), lambda m: m["dice"] >= limit)

    def notices(grams: Column) -> Column:
        likely = F.filter(
            _templates(known), lambda t: F.size(F.array_intersect(grams, t["grams"])) >= F.size(t["grams"]) * F.lit(least)
        )
        return F.flatten(F.transform(likely, lambda t: runs(grams, t)))

    found = F.when(text.rlike(_guard(guard_words(limit, known))), F.flatten(F.transform(F.array(_all_bigrams(text)), notices)))
    none = F.array().cast("array<struct<license:string,first_word:int,n_words:int,dice:double>>")
    return docs.select("doc_id", F.coalesce(found, none).alias("notices"))


def _better(a: Column, b: Column) -> Column:
    return (
        F.when(a["dice"] > b["dice"], -1)
        .when(a["dice"] < b["dice"], 1)
        .when(a["license"] < b["license"], -1)
        .when(a["license"] > b["license"], 1)
        .otherwise(0)
    )
