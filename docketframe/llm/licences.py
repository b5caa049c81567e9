"""Licence scan: a trained paragraph classifier whose predictions a template comparison confirms.

A paragraph is what stands between lines without a letter or digit. Its pieces are its lines, each two lines that follow
one another, and overlapping runs of twelve, so that every seven lines are in one run. A piece that holds any of the cues below is turned into word 1- and 2-grams and the letter
runs of its words, a sparse hashed vector, and classified by multinomial logistic regression into a licence family, ``unknown`` (a licence of none of
the families) or ``none`` (no licence at all). A family whose probability stays under a calibrated bound becomes
``unknown``, unless the paragraph holds all of one of its names. A prediction is confirmed if the family's name phrases cover enough of the paragraph's n-grams.
Everything runs as DataFrame operations and fitted Spark models.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the families as their notices give them.
FAMILIES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license", "Apache-2.0"],
    "MIT": ["the MIT License", "the MIT licence", "an MIT-style license", "MIT License (Expat)"],
    "BSD": ["the BSD License", "the 3-Clause BSD License", "the BSD 2-Clause License", "BSD-3-Clause", "the New BSD license"],
    "ISC": ["the ISC License", "ISC licence", "the ISC license terms"],
    "GPL": [
        "the GNU General Public License, version 3", "the GNU General Public License as published by the Free Software Foundation",
        "GNU GPL v3", "GPL-3.0-or-later", "the GNU General Public License, version 2", "GPLv2", "GPL-2.0-only",
    ],
    "LGPL": ["the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "LGPL-2.1", "LGPLv3"],
    "AGPL": ["the GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0", "AGPLv3"],
    "MPL": ["the Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International", "the Creative Commons Attribution License", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "the Creative Commons Attribution-ShareAlike License", "CC-BY-SA-3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "the Creative Commons Attribution-NonCommercial License", "CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International", "CC-BY-ND-4.0"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal public domain dedication", "the Creative Commons Zero license", "CC0-1.0"],
}
# Training frames: how notices name a licence.
FRAMES = [
    "Licensed under {}.", "This work is licensed under {}.", "Released under {}.", "Distributed under the terms of {}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of {}.", "License: {}", "SPDX-License-Identifier: {}",
    "This file is available under {}; see LICENSE for details.", "Copyright 2019 the authors. Licensed under {}.",
    "Permission is granted under {} to use and share the text.", "The source code is covered by {}", "All content here is published under {}, unless noted.",
]
# Bare SPDX ids.
SPDX = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT"], "BSD": ["BSD-2-Clause", "BSD-3-Clause", "0BSD"], "ISC": ["ISC"],
    "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0"],
    "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"], "MPL": ["MPL-2.0", "MPL-1.1"], "CC-BY": ["CC-BY-4.0", "CC-BY-3.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"], "CC-BY-NC": ["CC-BY-NC-4.0", "CC-BY-NC-3.0"], "CC-BY-ND": ["CC-BY-ND-4.0", "CC-BY-ND-3.0"], "CC0": ["CC0-1.0"],
}
SPDX_FRAMES = ["SPDX-License-Identifier: {}", "// SPDX-License-Identifier: {}", "SPDX-License-Identifier: {} */"]
# Grants, conditions and warranty paragraphs of the licences themselves, and the long notices of the others.
TEXTS = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "GPL": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "LGPL": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."],
    "AGPL": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication."],
}
TEXT_FRAMES = ["{}", "Copyright (c) 2020 Jane Doe {}", "All rights reserved. {}", "1. {}", "* {}"]
UNFAMILIAR = [
    "the Acme Open License 1.1", "our own terms", "a proprietary license", "a commercial license", "the Foo Bar License, version 5", "the terms of the vendor agreement",
    "a custom licence", "the Sample Data License", "an end user license agreement", "the Open Map License 1.0", "all rights reserved terms", "the house rules of the publisher",
]
PLAIN = [
    "The driver lost his license last year.", "She asked for permission to leave early.", "There is no warranty that it will rain.", "A fishing licence costs ten coins.",
    "The copyright debate went on for hours.", "Copyright law is taught in the third term.", "He needed a license to sell food.", "The warranty on the car ended in May.",
    "They redistributed the seats after the vote.", "Wealth was redistributed among the towns.", "Poetic license allows for such lines.", "The pub lost its licence to sell beer.",
    "No permission was given for the march.", "Without permission nobody may enter.", "License plates are made in the north.", "A warrant was issued on Monday.",
    "Copyright in songs is old.", "The licence fee rose again.", "Permission slips are due on Friday.", "The book talks about the license of the age.",
    "The film was released under another title.", "Leaflets were distributed under the doors.", "The hills are covered by snow.", "She is available under this number.",
    "The novel was published under a pen name.", "The Apache lived in the south.", "He studied physics at MIT.", "Copyright (c) 2020 Jane Doe", "Copyright 2019 the authors.",
]
LONE = ["license", "licence", "licensed", "licensing", "copyright", "permission", "warranty", "warrant", "redistribute", "redistribution", "public domain", "creative commons"]
CUES = ("licen", "copyright", "spdx", "gpl", "redistribut", "warrant", "permission")
# The cues that are words or pairs of words; MIT and ISC only in capitals, as "mit" is a common German word.
CUE_WORDS = (
    r"(?i:\b(?:apache|bsd)\b|\bmpl(?:\b|v?[0-9])|\bcc0|\bcc[^a-z0-9]+by\b|\bcreative[^a-z0-9]+commons\b|\bpublic[^a-z0-9]+domain\b"
    r"|\b(?:released|distributed|published|available)[^a-z0-9]+under\b|\bcovered[^a-z0-9]+by\b)|\b(?:MIT|ISC)\b"
)
NONE, UNKNOWN = "none", "unknown"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
N_FEATURES = 1 << 12
LEAST_SIMILARITY = 0.6
# What joined lines need: they hold more words that fit by chance.
JOINED_SIMILARITY = 0.8


@dataclass(frozen=True)
class LicenceModel:
    """The fitted regression, its labels in order, and the probability a family needs."""

    regression: LogisticRegressionModel
    labels: list[str]
    bound: float


def has_cue(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for cue in CUES:
        found = found | F.contains(low, F.lit(cue))
    return found | F.rlike(text, F.lit(CUE_WORDS))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def runs_of(words: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def grams_of(words: Column, longest: int = 2) -> Column:
    """All distinct n-grams of the words up to the given length."""
    return F.array_distinct(F.concat(words, *(runs_of(words, n) for n in range(2, longest + 1))))


def training_rows() -> list[tuple[str, str]]:
    """``label, text``: every name in every frame, names of no family, and sentences that grant nothing."""
    rows = [(family, frame.format(name)) for family, names in FAMILIES.items() for name in names for frame in FRAMES]
    rows += [(family, frame.format(name)) for family, names in SPDX.items() for name in names for frame in SPDX_FRAMES]
    rows += [(family, frame.format(text)) for family, texts in TEXTS.items() for text in texts for frame in TEXT_FRAMES]
    rows += [(family, " ".join(texts)) for family, texts in TEXTS.items() if len(texts) > 1]
    rows += [(UNKNOWN, frame.format(name)) for name in UNFAMILIAR for frame in FRAMES]
    rows += [(NONE, text) for text in PLAIN] + [(NONE, f"{a} {b}") for a in PLAIN for b in PLAIN[:5] if a != b]
    return rows + [(NONE, f"{a} {word} {b}".strip()) for word in LONE for a in ("", "a", "the") for b in ("", "it", "was", "in the end")]


def as_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    data = F.lit(json.dumps([{"label": label, "text": text} for label, text in rows]))
    return spark.range(1).select(F.inline(F.from_json(data, "array<struct<label:string,text:string>>")))


def vectors(rows: DataFrame, text: str) -> DataFrame:
    hashing = HashingTF(inputCol="_grams", outputCol="_vector", numFeatures=N_FEATURES, binary=True)
    letters = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    rows = rows.withColumn("_words", words_of(F.col(text)))
    return hashing.transform(rows.withColumn("_grams", F.array_distinct(F.concat(grams_of(F.col("_words")), letters))))


def predictions(rows: DataFrame, text: str, regression: LogisticRegressionModel, labels: list[str]) -> DataFrame:
    """The rows with ``_label``, the likeliest, and ``probability``."""
    scored = regression.transform(vectors(rows, text)).withColumn("_p", vector_to_array("probability")).drop("probability")
    names = F.array(*(F.lit(label) for label in labels))
    best = F.array_max("_p")
    return scored.withColumn("probability", best).withColumn("_label", F.element_at(names, F.array_position(F.col("_p"), best).cast("int")))


def train_licence_model(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> LicenceModel:
    """Fit on three quarters of the labelled rows, calibrate on the rest.

    The bound is the probability that 99 in 100 held-out rows of ``unknown`` and ``none`` stay under when they are taken
    for a family, and at least one half. The labelled rows are the ones above: a table of fixed size.
    """
    rows = rows or training_rows()
    labels = sorted({label for label, _ in rows})
    number = F.array_position(F.array(*(F.lit(label) for label in labels)), F.col("label")) - 1
    table = as_table(spark, rows).withColumn("number", number.cast("double")).withColumn("part", F.pmod(F.crc32("text"), F.lit(4)))
    regression = LogisticRegression(
        featuresCol="_vector", labelCol="number", predictionCol="_prediction", rawPredictionCol="_raw", probabilityCol="probability",
        family="multinomial", regParam=0.002, maxIter=30, standardization=False,
    ).fit(vectors(table.where("part > 0"), "text"))
    held = predictions(table.where("part = 0"), "text", regression, labels)
    wrong = held.where(F.col("label").isin(NONE, UNKNOWN) & ~F.col("_label").isin(NONE, UNKNOWN))
    bound = wrong.agg(F.percentile("probability", 0.99)).first()[0]
    return LicenceModel(regression, labels, max(0.5, bound or 0.0))


def template_similarity(words: Column, family: Column) -> Column:
    """The largest share of a name phrase's n-grams (up to 2 words) that the paragraph has, over the family's phrases."""
    grams = grams_of(words)
    out = F.lit(0.0)
    for name, phrases in FAMILIES.items():
        shares, named = [], []
        for phrase in phrases:
            own = [w for w in phrase.lower().replace(",", " ").replace("(", " ").replace(")", " ").split() if w not in ("the", "an")]
            named.append([*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))])
        for text in [*(SPDX_FRAMES[0].format(x) for x in SPDX[name]), *TEXTS.get(name, [])]:
            own = re.findall(WORD, text.lower())
            named.append([*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))])
        for parts in (list(dict.fromkeys(x)) for x in named):
            shares.append(F.size(F.array_intersect(grams, F.split(F.lit("|".join(parts)), r"\|"))) / F.lit(float(len(parts))))
        out = F.when(family == name, F.greatest(*shares)).otherwise(out)
    return out


def licence_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """``doc_id, row, paragraph, line, span, text, family, probability, similarity, confirmed`` of all pieces with a cue.

    ``row`` tells rows of ``docs`` apart, ``paragraph`` is the paragraph's number from 0, ``line`` the piece's first line in
    it and ``span`` its number of lines. ``family`` is a family, ``unknown`` or ``none``; only a family can be confirmed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(has_cue(F.col("text")))
    plain = F.regexp_replace("text", r"(?m)^[^\p{L}\p{N}\n]*+$", "")
    parts = rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.posexplode(F.split(plain, r"\n\n+")).alias("paragraph", "text"))
    parts = parts.where(has_cue(F.col("text"))).withColumn("_lines", F.split("text", "\n")).withColumn("_n", F.size("_lines"))

    def runs(first: Column, span: int) -> Column:
        return F.transform(first, lambda i: F.struct(i.alias("line"), F.lit(span).alias("span"), F.array_join(F.slice("_lines", i + 1, span), " ").alias("text")))

    none = F.array().cast("array<int>")
    n = F.col("_n")
    pieces = F.concat(
        runs(F.sequence(F.lit(0), n - 1), 1), runs(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(none), 2),
        runs(F.when(n > 2, F.sequence(F.lit(0), F.greatest(n - 7, F.lit(0)), F.lit(6))).otherwise(none), 12),
    )
    lines = parts.select("doc_id", "row", "paragraph", F.inline(F.filter(pieces, lambda x: has_cue(x["text"]))))
    scored = predictions(lines, "text", model.regression, model.labels)
    found = scored.withColumn("similarity", template_similarity(F.col("_words"), F.col("_label")))
    sure = (F.col("probability") >= model.bound) | (F.col("similarity") == 1)
    found = found.withColumn("family", F.when(F.col("_label").isin(NONE, UNKNOWN) | sure, F.col("_label")).otherwise(UNKNOWN))
    found = found.withColumn("similarity", F.when(F.col("family") == UNKNOWN, 0.0).otherwise(F.col("similarity")))
    confirmed = F.col("similarity") >= F.when(F.col("span") == 1, LEAST_SIMILARITY).otherwise(JOINED_SIMILARITY)
    return found.select("doc_id", "row", "paragraph", "line", "span", "text", "family", "probability", "similarity", confirmed.alias("confirmed"))


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with the licences of its paragraphs.

    Returns ``doc_id, family, n_paragraphs, families, probability, confirmed``: the family of the likeliest confirmed
    piece, else of the likeliest one; how many paragraphs are licences; all families in them; ``none``, 0, an empty
    list, NULL and false without one, which is also what a NULL or empty text gets. Only documents with a cue are exploded
    and grouped again. Repeated rows are scanned each; an empty table gives an empty one.
    """
    text = F.col("text").cast("string")
    without = docs.where(~F.coalesce(has_cue(text), F.lit(False))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(NONE).alias("family"), F.lit(0).cast("long").alias("n_paragraphs"),
        F.array().cast("array<string>").alias("families"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("confirmed"),
    )
    found = licence_paragraphs(docs, model)
    # Each line takes the licence of the piece that fits it best, the shortest of equal ones; joined lines count if confirmed.
    licence = (F.col("family") != NONE) & ((F.col("span") == 1) | F.col("confirmed"))
    own = F.when(licence, F.sequence("line", F.col("line") + F.col("span") - 1)).otherwise(F.array().cast("array<int>"))
    spread = found.select("row", "doc_id", "paragraph", F.explode_outer(own).alias("line"), F.when(licence, F.struct("confirmed", "similarity", (-F.col("span")).alias("size"), "probability", "family")).alias("fit"))
    by_line = spread.groupBy("row", "doc_id", "paragraph", "line").agg(F.max("fit").alias("fit")).select("row", "doc_id", "paragraph", "line", "fit.*")
    licence = F.col("family").isNotNull()
    order = F.when(licence, F.struct("confirmed", "probability", "similarity", (-F.col("paragraph")).alias("place"), (-F.col("line")).alias("line"), "family"))
    grouped = by_line.groupBy("row", "doc_id").agg(
        F.max(order).alias("best"), F.count_distinct(F.when(licence, F.col("paragraph"))).alias("n_paragraphs"), F.sort_array(F.collect_set(F.when(licence, F.col("family")))).alias("families")
    )
    return without.unionByName(grouped.select(
        "doc_id", F.coalesce("best.family", F.lit(NONE)).alias("family"), "n_paragraphs", "families", F.col("best.probability").alias("probability"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
    ))
