"""Licence notices in texts, by Dice coefficient over word bigrams (operator 5), with DataFrame functions only.

A unit of text is a line, a paragraph, or the whole text. Units and templates are normalised (lower case; everything
but letters and digits is a gap) and become sets of word bigrams; a unit bears a licence if 2 |A n B| / (|A| + |B|) of
the two sets is at least `similarity`. A unit whose number of bigrams lies outside (s / (2 - s)) to ((2 - s) / s) times
that of a template cannot reach s, so these bounds choose the candidate templates of a unit; units outside the bounds of
all templates go before their bigrams are made. A unit that reaches s lacks at most the share 1 - s / (2 - s) of a
template's bigrams, so it holds one of any larger part of them: texts without any word of such a part are never split
into units, and units without any bigram of such a part are never compared.

The templates are a short list given as a parameter; they travel as literals.

Defined cases: null and empty texts bear nothing; a unit of one word has no bigrams; ties between templates go to the
smaller name; repeated rows agree; an empty table or template list gives an empty or unmarked result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, functions as F

from .quality import STOP_WORDS

SIMILARITY = 0.8
# Customary notices, as their licences propose them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def normalised(lowered: Column) -> Column:
    """Gaps of a text in lower case as one blank; line feeds stay."""
    return F.regexp_replace(lowered, r"[^\p{L}\p{N}\n]+", " ")


def units(text: Column) -> Column:
    """Lines, paragraphs and the whole of a normalised text, each different one once."""
    one_line = lambda u: F.trim(F.regexp_replace(u, r"[ \n]+", " "))
    lines = F.transform(F.split(text, "\n"), lambda u: F.trim(u))
    paragraphs = F.transform(F.split(text, r"\n ?(?:\n ?)+"), one_line)
    return F.array_distinct(F.concat(lines, paragraphs, F.array(one_line(text))))


def bigrams(words: Column) -> Column:
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, 2, 1_000_000_000).alias("b"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"])))


def telling_words(pairs: list[str], low: float) -> list[str]:
    """Few, preferably long and rare words of a template, such that a unit with a share `low` of its bigrams holds one."""
    most_missing, touched, chosen = len(pairs) - ceil(low * len(pairs) - 1e-9), set(), []
    for word in sorted({w for p in pairs for w in p.split(" ")}, key=lambda w: (w in STOP_WORDS, -len(w), w)):
        if len(touched) > most_missing:
            break
        new = {p for p in pairs if word in p.split(" ")} - touched
        if new:
            chosen.append(word)
            touched |= new
    return chosen


def _holds(lowered: Column, word: str) -> Column:
    """Whether a text holds a word; short words must stand alone."""
    if len(word) >= 5:
        return F.contains(lowered, F.lit(word))
    return F.contains(lowered, F.lit(word)) & lowered.rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])")


def notices(docs: DataFrame, templates: Mapping[str, str] = NOTICES, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, unit, license and dice: for every unit of a text that bears a licence, its best template."""
    sets = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    sets = {name: pairs for name, pairs in sets.items() if pairs}
    low, high = similarity / (2 - similarity), (2 - similarity) / similarity
    bounds = [(ceil(low * len(pairs) - 1e-9), floor(high * len(pairs) + 1e-9)) for pairs in sets.values()]
    words = dict.fromkeys(w for pairs in sets.values() for w in telling_words(pairs, low))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("_low"))
    rows = rows.where(reduce(lambda a, w: a | _holds(F.col("_low"), w), words, F.lit(False)))
    rows = rows.select("doc_id", normalised(F.col("_low")).alias("_n")).select("doc_id", F.explode(units(F.col("_n"))).alias("unit"))
    gaps = F.length("unit") - F.length(F.translate("unit", " ", ""))
    # Distinct bigrams may be fewer than gaps, never more.
    rows = rows.where(gaps >= min((a for a, _ in bounds), default=1))
    rows = rows.withColumn("_pairs", bigrams(F.split("unit", " ")))
    n = F.size("_pairs")
    needed = [pairs[: len(pairs) - ceil(low * len(pairs) - 1e-9) + 1] for pairs in sets.values()]
    some = F.array(*[F.lit(p) for p in dict.fromkeys(p for part in needed for p in part)]) if sets else F.array().cast("array<string>")
    rows = rows.where(n.between(min((a for a, _ in bounds), default=1), max((b for _, b in bounds), default=0)))
    rows = rows.where(F.arrays_overlap("_pairs", some))
    tried = []
    for (name, pairs), (a, b) in zip(sets.items(), bounds):
        shared = F.size(F.array_intersect("_pairs", F.array(*[F.lit(p) for p in pairs])))
        dice = F.when(n.between(a, b), 2.0 * shared / (n + len(pairs)))
        tried.append(F.struct((-dice).alias("order"), F.lit(name).alias("license")))
    best = F.array_min(F.filter(F.array(*tried), lambda x: x["order"].isNotNull())) if tried else F.lit(None).cast("struct<order:double,license:string>")
    rows = rows.withColumn("_best", best).where(-F.col("_best.order") >= similarity)
    return rows.select("doc_id", "unit", F.col("_best.license").alias("license"), (-F.col("_best.order")).alias("dice"))


def licenses(docs: DataFrame, templates: Mapping[str, str] = NOTICES, similarity: float = SIMILARITY) -> DataFrame:
    """For every document: the licences its units bear, in order of name, how many, and the best coefficient."""
    per_document = notices(docs, templates, similarity).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("license")).alias("licenses"), F.max("dice").alias("best_dice")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    rows = ids.join(per_document, F.col("_id") == F.col("doc_id"), "left")
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.coalesce(F.size("licenses"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("licenses", ","), F.lit("")).alias("licenses"),
        "best_dice",
    )
