"""Licence scans with DataFrame functions only.

Texts are cut into paragraphs at line ends, but for those within a hard-wrapped sentence. A sparse logistic regression over word n-grams names the
licence family of a paragraph. Its vocabulary holds only n-grams with an anchor word (a word that the
licence texts use and ordinary prose does not), so a paragraph without anchors has the score of the empty
paragraph, which is `none`; such paragraphs, and texts without any, are left out by a plain substring test
before words are made. Scores are scaled by a temperature, and two thresholds say what is `none` and what is
`unknown`: all three are fitted on templates that the scoring model has not seen in any form. A predicted family is
confirmed if one of its templates is covered by the paragraph's word 3-grams (or, for a long template, the
paragraph by it).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.common import ascii_lower, settled, split_words

#: Sentences of well-known licences and their usual notices (fixed values).
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU GPL version 2.",
        "Distributed under the terms of the GPL.",
        "Released under the GPL v3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is distributed under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "This work has been dedicated to the public domain.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "Proprietary": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Sentences that use licence words without granting a licence, and plain prose (fixed values).
OTHER: list[str] = [
    "She lost her driving license and had to apply for a new one.",
    "The city council granted a license to the restaurant last year.",
    "Fishing without a licence is prohibited in this county.",
    "The warranty covers parts and labour for two years.",
    "Software engineers write code and review the work of others.",
    "The general public is invited to the opening of the new library.",
    "You may not use the pool without permission of the staff.",
    "A copy of the report was distributed to all members of the board.",
    "The foundation was established to support free education.",
    "The Apache helicopter landed at the base in version two of the story.",
    "He studied at MIT before he moved to the west coast.",
    "The source of the river lies in the mountains.",
    "All rights of the workers must be respected by their employers.",
    "The creative process of the commons is described in the book.",
    "Terms and conditions of the rental agreement are listed below.",
    "The law requires that drivers carry their licences at all times.",
    "The weather was fine and the children played outside all day.",
    "Prices include delivery, and orders are shipped within two days.",
    "The mozilla of the story is a lizard that lives by the sea.",
    "The public domain of the king reached to the northern sea.",
    "A book on copyright law and the work of its authors lay on the desk.",
    "The museum holds the copyright in the photographs of the exhibition.",
    "Er kam mit dem Zug nach Hause und sprach mit seiner Mutter.",
    "Mit der Zeit wurde das Wetter besser, und wir gingen mit den Kindern hinaus.",
    "Sie arbeitet mit ihm zusammen an einem Buch mit vielen Bildern.",
    "The herd of gnu crossed the river as is its habit in the spring.",
    "He limited the committee to members with the right of submission.",
    "The attribution of the painting to the old master was disputed for years.",
    "The bus left as is usual at nine, and the driver showed his licence.",
    "The school redistributed the books among the classes after the flood.",
]
#: Anchors are found as substrings, so inflected forms count.
ANCHORS = ("licens", "licenc", "copyright", "gnu", "apache", "mozilla", "spdx", "redistribut", "sublicens", "creativecommons", "creative commons", "public domain", "cc0", "mit", "bsd", "gpl", "cc by", "unencumbered", "hereby granted", "rights reserved", "proprietary", "as is", "attribution", "sharealike", "noncommercial")
WORD = r"[^a-z0-9.+]+"
SEPARATORS = r"\x00-\x2A\x2C\x2D\x2F\x3A-\x60\x7B-\x7F"
EPOCHS, RATE, L2, SEED, FOLDS, COVERED = 300, 0.5, 1e-4, 5, 3, 0.8
NONE, UNKNOWN = "none", "unknown"


def words(text: str) -> list[str]:
    """Words of a paragraph: runs of lowered letters, digits, + and inner points; other signs part them."""
    lowered = "".join(c.lower() if c < "\x80" else c for c in text)
    return [w.strip(".") for w in re.split(f"[{SEPARATORS}]+", lowered) if w.strip(".")]


def ngrams(parts: list[str]) -> set[str]:
    return {" ".join(parts[i : i + n]) for n in (1, 2, 3) for i in range(len(parts) - n + 1)}


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]  # n-gram -> a weight for each class
    temperature: float
    some: float  # the least probability of any licence that is not `none`
    least: float  # the least probability of a family that is not `unknown`


def _softmax(z: list[float], t: float = 1.0) -> list[float]:
    top = max(z)
    e = [math.exp((x - top) / t) for x in z]
    return [x / sum(e) for x in e]


def _train(rows: list[tuple[set[str], int]], classes: int, vocabulary: set[str]) -> tuple[list[float], dict[str, list[float]]]:
    """Multinomial logistic regression by full-batch gradient steps; absent n-grams cost nothing."""
    bias, weights = [0.0] * classes, defaultdict(lambda: [0.0] * classes)
    rows = [(sorted(g & vocabulary), y) for g, y in rows]
    counts = Counter(y for _, y in rows)
    for _ in range(EPOCHS):
        step_b, step_w = [0.0] * classes, defaultdict(lambda: [0.0] * classes)
        for grams, y in rows:
            scale = 1 / math.sqrt(len(grams)) if grams else 0.0
            z = [b + scale * sum(weights[g][c] for g in grams) for c, b in enumerate(bias)]
            p = _softmax(z)
            for c in range(classes):
                d = ((c == y) - p[c]) / counts[y] / classes
                step_b[c] += d
                for g in grams:
                    step_w[g][c] += d * scale
        for c in range(classes):
            bias[c] += RATE * step_b[c] * 4
        for g, s in step_w.items():
            w = weights[g]
            for c in range(classes):
                w[c] += RATE * 20 * s[c] - L2 * w[c]
    return bias, weights


def _examples(rng: random.Random) -> list[tuple[list[str], str, int]]:
    """(words, class, fold): templates, whole and embedded in prose, and the other sentences.

    All that is made from one sentence is in one fold.
    """
    prose = [w for s in OTHER[14:] for w in words(s)]
    out = []
    for family, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            w = words(text)
            made = [w, rng.sample(prose, 4) + w, w + rng.sample(prose, 6), *([w[: len(w) * 2 // 3]] if len(w) > 12 else [])]
            out += [(x, family, k % FOLDS) for x in made]
    for k, text in enumerate(OTHER):
        w = words(text)
        out += [(x, NONE, k % FOLDS) for x in (w, w + rng.sample(prose, 5), rng.sample(prose, 8))]
    return out


def _split(rows: list[tuple[float, bool]]) -> float:
    """The threshold that puts most of the true rows at or above it and most of the others below; ties: the least one."""
    points = sorted({0.0, 1.0, *(p for p, _ in rows)})
    middles = [(a + b) / 2 for a, b in zip(points, points[1:])]
    good, bad = sum(y for _, y in rows) or 1, sum(not y for _, y in rows) or 1
    gain = [sum(y for p, y in rows if p >= t) / good + sum(not y for p, y in rows if p < t) / bad for t in middles]
    best = [t for t, g in zip(middles, gain) if g == max(gain)]
    return best[0]


def fit() -> Model:
    """Train on the built-in sentences; the same model each time."""
    rng = random.Random(SEED)
    examples = _examples(rng)
    classes = (NONE, *TEMPLATES)
    vocabulary = {g for w, _, _ in examples for g in ngrams(w) if any(a in g for a in ANCHORS)}
    rows = [(ngrams(w), classes.index(y), fold) for w, y, fold in examples]
    # Temperature and thresholds from sentences of which the model of the other folds has seen nothing.
    held: list[tuple[list[float], int]] = []
    for part in range(FOLDS):
        rest = [(g, y) for g, y, fold in rows if fold != part]
        b, ws = _train(rest, len(classes), {g for x, _ in rest for g in x} & vocabulary)
        for grams, y, fold in rows:
            if fold == part:
                known = [g for g in grams if g in ws]
                scale = 1 / math.sqrt(len(known)) if known else 0.0
                held.append(([x + scale * sum(ws[g][c] for g in known) for c, x in enumerate(b)], y))
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=lambda t: -sum(math.log(max(1e-9, _softmax(z, t)[y])) for z, y in held))
    held_p = [(_softmax(z, temperature), y) for z, y in held]
    some = _split([(1 - p[0], y > 0) for p, y in held_p])
    least = _split([(max(p[1:]), p.index(max(p[1:]), 1) == y) for p, y in held_p if y > 0 and 1 - p[0] >= some])
    bias, weights = _train([(g, y) for g, y, _ in rows], len(classes), vocabulary)
    return Model(classes, tuple(bias), {g: tuple(w) for g, w in sorted(weights.items())}, temperature, some, least)


def _templates() -> list[tuple[str, list[str]]]:
    """(family, its distinct 3-grams) of every template; one of fewer words is one gram."""
    found = [(family, words(text)) for family, texts in TEMPLATES.items() for text in texts]
    return [(family, sorted({" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or {" ".join(w)})) for family, w in found]


def _gram_table(spark: SparkSession, model: Model) -> DataFrame:
    """(known, w, ids): the weights of an n-gram, and the numbers of the templates that hold it; the empty n-gram has neither."""
    holders: dict[str, list[int]] = {"": []}
    for k, (_, grams) in enumerate(_templates()):
        for g in grams:
            holders.setdefault(g, []).append(k)
    rows = [(g, list(model.weights[g]) if g in model.weights else None, holders.get(g, [])) for g in sorted({*model.weights, *holders})]
    return spark.createDataFrame(rows, "known string, w array<double>, ids array<int>")


#: A line end within a hard-wrapped sentence: after 40 to 120 characters without a full stop, before a small letter.
WRAPPED = r"(?m)^([^\n]{40,120}+)(?<=[^\s.!?:;])\n[ \t]*(?=[a-z])"


def _scored(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_paragraphs, paragraph, family, probability, template_cover, confirmed) for every paragraph with an anchor,
    and one row with a null paragraph for every text without any. ``row`` tells repeated rows apart.

    N-grams are exploded alone, without the paragraph they are of: a long paragraph costs as much as its words.
    """
    lowered = ascii_lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WRAPPED, "$1 "))
    marked = lambda text: f"({_plain_anchors(text)}) OR rlike({text}, '{_parted_anchors()}')"
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(lowered, "\n").alias("lines"))
    lines = F.expr(f"filter(transform(lines, (x, i) -> struct(i AS paragraph, x AS line)), x -> {marked('x.line')})")
    parts = base.select("row", "id", F.size("lines").cast("long").alias("n_paragraphs"), F.explode_outer(lines).alias("p"))
    parts = parts.select("row", "id", "n_paragraphs", "p.paragraph", F.coalesce("p.line", F.lit("")).alias("line"))
    stripped = F.filter(F.transform(split_words(F.col("line"), SEPARATORS), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")
    keys = ["row", "id", "n_paragraphs", "paragraph"]
    parts = parts.select(*keys, stripped.alias("words"))
    gram = lambda n: f"if(size(words) >= {n}, transform(sequence(0, size(words) - {n}), i -> concat_ws(' ', {', '.join(f'words[i + {k}]' for k in range(n))})), CAST(array() AS ARRAY<STRING>))"
    parts = parts.select(*keys, F.expr(f"array_distinct(concat({gram(1)}, {gram(2)}))").alias("short"), F.expr(f"array_distinct({gram(3)})").alias("triples"))
    parts = parts.select(*keys, F.size("triples").alias("n_triples"), F.explode(F.concat(F.array(F.lit("")), "short", "triples")).alias("gram"))
    known = F.broadcast(_gram_table(docs.sparkSession, model))  # the vocabulary and the templates: a few thousand rows
    sums = parts.join(known, F.col("gram") == F.col("known")).groupBy(*keys, "n_triples").agg(
        F.count("w").alias("n"), *[F.coalesce(F.sum(F.get("w", F.lit(c))), F.lit(0.0)).alias(f"s{c}") for c in range(len(model.classes))], F.flatten(F.collect_list("ids")).alias("ids")
    )
    scale = F.when(F.col("n") > 0, 1 / F.sqrt("n")).otherwise(0.0)
    z = [(F.lit(b) + scale * F.col(f"s{c}")) / F.lit(model.temperature) for c, b in enumerate(model.bias)]
    scored = sums.select(*keys, "n_triples", "ids", F.array(*z).alias("z"))
    scored = scored.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    scored = scored.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)))
    scored = scored.withColumn("families", F.slice("p", 2, len(model.classes) - 1))
    scored = scored.withColumn("best", F.array_position("families", F.array_max("families")).cast("int"))
    scored = scored.select(*keys, "n_triples", "ids", (1 - F.get("p", F.lit(0))).alias("any"), F.array_max("families").alias("own"), F.element_at(F.array(*[F.lit(c) for c in model.classes[1:]]), F.col("best")).alias("named"))
    # A template confirms if the paragraph holds its 3-grams, or it holds those of a paragraph cut from it.
    by_family: dict[str, list[tuple[int, int]]] = {}
    for k, (family, grams) in enumerate(_templates()):
        by_family.setdefault(family, []).append((k, len(grams)))
    covers = [
        F.when(F.col("named") == family, F.greatest(F.lit(0.0), *[F.expr(f"size(filter(ids, x -> x = {k}))") / F.greatest(F.lit(1), F.least(F.lit(n), F.greatest(F.lit(3), F.col("n_triples")))) for k, n in numbers]))
        for family, numbers in by_family.items()
    ]
    compared = scored.withColumn("template_cover", F.least(F.lit(1.0), F.coalesce(*covers, F.lit(0.0))))
    covered = F.col("template_cover") >= F.lit(COVERED)
    family = F.when(F.col("any") < F.lit(model.some), F.lit(NONE)).when((F.col("own") >= F.lit(model.least)) | covered, F.col("named")).otherwise(F.lit(UNKNOWN))
    compared = compared.withColumn("family", family).withColumn("probability", F.when(family == UNKNOWN, F.col("any")).when(family == NONE, 1 - F.col("any")).otherwise(F.col("own")))
    confirmed = covered & ~F.col("family").isin(NONE, UNKNOWN)
    return settled(compared.select(*keys, "family", "probability", "template_cover", confirmed.alias("confirmed")))


def paragraphs(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, ``id_col``, paragraph, family, probability, template_cover, confirmed): every paragraph not classed `none`.

    ``family`` is the classifier's, or `unknown` where a licence is likely but the likeliest family neither has a
    calibrated probability that is high enough nor a template that agrees, which ``confirmed`` tells.
    """
    found = _scored(docs, model or fit(), id_col, text_col).where((F.col("family") != NONE) & F.col("paragraph").isNotNull())
    return found.select("row", F.col("id").alias(id_col), "paragraph", "family", "probability", "template_cover", "confirmed")


def _plain_anchors(text: str) -> str:
    return " OR ".join(f"contains({text}, '{a}')" for a in ANCHORS if " " not in a)


def _parted_anchors() -> str:
    """Pattern of the anchors of more words: ``words`` may have found any separators and points between them."""
    return "|".join(a.replace(" ", r"[\\x00-\\x2A\\x2C-\\x2F\\x3A-\\x60\\x7B-\\x7F]+") for a in ANCHORS if " " in a)


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_paragraphs, n_license, families, license, confirmed, probability, template_cover) for every row of ``docs``.

    ``families`` are the confirmed families of the text's paragraphs, sorted and comma-joined. ``license`` is the
    family of the most probable confirmed paragraph (ties: the first), else that of the most probable one that no
    template confirms, else `unknown` if a paragraph reads like a licence of no known family, else `none`;
    ``confirmed``, probability and cover are that paragraph's. ``n_license`` counts the paragraphs that are not `none`.
    Null and empty texts have one empty paragraph and no licence. Repeated rows give repeated results. Other columns
    are ignored; an empty table gives no rows.
    """
    found = _scored(docs, model or fit(), id_col, text_col)
    reads = F.col("paragraph").isNotNull() & (F.col("family") != NONE)
    best = F.max(F.when(reads, F.struct(F.col("confirmed"), (F.col("family") != UNKNOWN).alias("named"), F.col("probability"), (-F.col("paragraph")).alias("first"), F.col("family"), F.col("template_cover"))))
    families = F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",")
    per_row = found.groupBy("row", "id", "n_paragraphs").agg(F.count(F.when(reads, 1)).alias("n_license"), families.alias("families"), best.alias("best"))
    return per_row.select(
        F.col("id").alias(id_col), "n_paragraphs", "n_license", "families", F.coalesce(F.col("best.family"), F.lit(NONE)).alias("license"), F.coalesce(F.col("best.confirmed"), F.lit(False)).alias("confirmed"),
        F.coalesce(F.col("best.probability"), F.lit(0.0)).alias("probability"), F.coalesce(F.col("best.template_cover"), F.lit(0.0)).alias("template_cover"),
    )
