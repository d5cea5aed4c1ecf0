"""Operator 4: licence notices by a trained paragraph classifier.

A paragraph is a line, joined with the next one where a line is wrapped (it has 40 characters or more and ends in a letter, digit or comma, and
the next begins with a small letter). Features are word unigrams and bigrams that occur in the notices below, as sparse indicator vectors; a multinomial logistic regression
with a lasso penalty is trained on the notices, on pieces of them, and on the class unknown: sentences that speak of licences, notices with
their words reversed (the same words in no notice's order), and a bounded sample of corpus paragraphs (FIT_PARAGRAPHS, any paragraph of a
text), but for those that share MIN_OVERLAP of their bigrams with a notice. Its probabilities are calibrated by a temperature on rows kept out of the
fit; under MIN_PROBABILITY a paragraph is unknown. A predicted family is confirmed if the paragraph shares MIN_OVERLAP of its bigrams (or of the
notice's, if shorter) with one of the family's notices.

A paragraph that has names of several families (words or bigrams of notices of at most SHORT words that no other family's notices have) is also read
clause by clause (parted at commas, semicolons, slashes, and, or). Clauses are scored and confirmed like paragraphs; one counts only if it has a name of its
family, and only where a paragraph's clauses tell two families or more: "MIT or Apache-2.0" gives both.

Every paragraph is scored. One without a word that any positive weight belongs to, alone or as the first of two, has the score of an empty one,
which is unknown; this is found by one overlap of word lists, and only the others go through the sums. Scoring is expressions on the row, without any
shuffle: weights, notices and offsets are literals of fixed size, whatever the corpus.

Results, one row for each row of docs: n_paragraphs (with a word), n_scored (all of them), n_confirmed, n_unconfirmed, families (confirmed,
sorted, comma-joined; empty if none), probability (highest of the confirmed; null if none), n_several (paragraphs whose clauses tell several families). A null text has no paragraph. A tie between families goes
to the first by name. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, saved

FIT_PARAGRAPHS = 1500
SAMPLE_WEIGHT = 0.1
"""Of a corpus paragraph against a notice in the fit: there are many more of them, and most are far from any notice."""
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.6
SHORT = 4
"""Notices of so many words are names that may stand alone; they have no reversed form."""
UNKNOWN = "unknown"

# Notices as their licences ask for them, by family, and sentences that speak of licences without granting one.
NOTICES = {
    "AGPL": (
        "AGPL-3.0",
        "GNU AGPL",
        "GNU Affero General Public License v3.0",
        "GNU Affero General Public License, version 3",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "Apache": (
        "Apache-2.0",
        "Apache License 2.0",
        "Lizenziert unter der Apache-Lizenz, Version 2.0.",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "BSD-3-Clause",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSL": (
        "BSL-1.0",
        "Boost Software License",
        "Boost Software License 1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "CC-BY": (
        "CC BY 4.0",
        "Licensed under CC BY 4.0.",
        "Creative Commons Attribution 4.0 International (CC BY 4.0)",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "CC BY-NC 4.0",
        "Licensed under CC BY-NC 4.0.",
        "Creative Commons Attribution-NonCommercial 4.0 International (CC BY-NC 4.0)",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-ND": (
        "CC BY-ND 4.0",
        "Licensed under CC BY-ND 4.0.",
        "Creative Commons Attribution-NoDerivatives 4.0 International (CC BY-ND 4.0)",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "CC-BY-SA": (
        "CC BY-SA 4.0",
        "Licensed under CC BY-SA 4.0.",
        "Creative Commons Attribution-ShareAlike 4.0 International (CC BY-SA 4.0)",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "EPL": (
        "EPL-2.0",
        "Eclipse Public License",
        "Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL": (
        "GPLv3",
        "GPL-3.0",
        "GNU General Public License",
        "GNU General Public License v3.0",
        "Veröffentlicht unter der GNU General Public License, Version 3.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Distributed under the terms of the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "ISC License",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL": (
        "LGPL-3.0",
        "GNU LGPL",
        "GNU Lesser General Public License",
        "GNU Lesser General Public License v3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "MIT License",
        "under MIT",
        "Veröffentlicht unter der MIT-Lizenz.",
        "Publié sous licence MIT.",
        "Publicado bajo la licencia MIT.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "MPL-2.0",
        "Mozilla Public License",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without the prior written permission of the copyright holder.",
        "This document is proprietary and confidential. Unauthorized copying is prohibited. All rights reserved.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "CC0 1.0 Universal",
        "The Unlicense",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "zlib License",
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
}
OTHERS = (
    "He lost his driving licence and had to walk to the office.",
    "The record was released under the title of the film.",
    "The song was released under the label in the spring.",
    "Poetic license lets an author change the order of events.",
    "The city will license new taxis next year.",
    "A license fee is paid for each television.",
    "The police had a warrant for the house.",
    "The warranty of the machine ends in two years.",
    "Permission to enter the garden is given at the gate.",
    "Copyright is a hard subject, said the teacher.",
    "The shop sells licensed toys and hats.",
    "Public domain names were sold in an auction.",
    "The city will license an Apache helicopter under the budget.",
    "A general public meeting was held under the new version of the plan.",
    "All rights of the reserved seats are held by the club.",
    "The source code of the old program was lost, and the author with it.",
)


_WRAPPED = r"\n(?<=[^\n]{40}\n)(?<=[\p{L}\p{N},][ \t]?\n)[ \t]*(?=\p{Ll})"


def paragraphs(text: str) -> Column:
    return F.filter(F.split(F.regexp_replace(text, _WRAPPED, " "), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)


_CLAUSE = r"(?i)[,;/]|\b(?:and|or|und|oder|et|ou|y)\b"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _grams(words: Column) -> Column:
    """w: distinct words, b: distinct bigrams, the last word with an empty one after it. `words` has to be a column or a variable."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit(""))))
    return F.struct(F.array_distinct(words).alias("w"), F.array_distinct(pairs).alias("b"))


def _list(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")


def _numbers(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(repr(x) for x in values.ravel().tolist())), ",").cast("array<double>")


def _overlap(bigrams: Column, notice: list[str]) -> Column:
    return F.size(F.array_intersect(bigrams, _list(notice))) / F.greatest(F.lit(1), F.least(F.size(bigrams), F.lit(len(notice))))


class Model:
    """Of each feature and family, the weight over that of unknown; start: the same of no feature. Divided by the temperature.

    names: (name, number of its family). held_out: paragraphs kept out of the first fit, and how many of them it gave a family, how many have one, how many got the right one.
    """

    def __init__(self, families: list[str], features: list[str], weights: np.ndarray, start: np.ndarray, notices: list[tuple[int, list[str]]], names: list[tuple[str, int]], held_out: dict):
        self.families, self.features, self.weights, self.start, self.notices, self.names, self.held_out = families, features, weights, start, notices, names, held_out

    def triggers(self) -> list[str] | None:
        """The words without which a paragraph scores no more than an empty one; None if an empty one has a family."""
        if self.start.max() >= 0:
            return None
        return sorted({f.split(" ")[0] for f, w in zip(self.features, self.weights, strict=True) if w.max() > 0})


def _texts() -> list[tuple[str, str]]:
    """(family, text) of notices, of their halves and with words around, and of the class unknown."""
    rows = [(f, t) for f, ts in NOTICES.items() for t in ts]
    for f, t in list(rows):
        w = t.split()
        if len(w) > 14:
            rows += [(f, " ".join(w[: len(w) // 2 + 2])), (f, " ".join(w[len(w) // 2 - 2 :]))]
        rows.append((f, "Notice: " + t + " See the file for details."))
        if len(w) <= SHORT:
            rows += [(f, t + " applies to this file"), (f, t + " for the source code")]
        else:
            rows.append((UNKNOWN, " ".join(reversed(w))))
    return rows + [(UNKNOWN, t) for t in OTHERS for _ in range(3)]


def fit(docs: DataFrame) -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    names = sorted(NOTICES)
    texts = _texts()
    known = spark.createDataFrame([(f, t) for f, t in texts], "family string, text string")
    known = known.withColumn("ws", _words(F.col("text"))).withColumn("g", _grams(F.col("ws")))
    grams = {(r.family, r.text): r.g for r in known.collect()}
    notices = [(k, list(grams[f, t].b)) for k, f in enumerate(names) for t in NOTICES[f]]
    of = {}
    for f, t in texts:
        for x in {*grams[f, t].w, *grams[f, t].b} if f != UNKNOWN else ():
            of.setdefault(x, set()).add(f)
    short = {x for f in names for t in NOTICES[f] if len(grams[f, t].w) <= SHORT for x in [*grams[f, t].w, *grams[f, t].b]}
    alone = [(x, names.index(*of[x])) for x in sorted(short) if len(of[x]) == 1]
    vocabulary = sorted({x for (f, _), g in grams.items() if f != UNKNOWN for x in [*g.w, *g.b]})
    total = docs.where("text is not null").count()
    share = min(1.0, 2 * FIT_PARAGRAPHS / max(1, total))
    unit = F.pmod(F.xxhash64("text", F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    lines = docs.where(unit < share).select("text", paragraphs("text").alias("l")).where(F.size("l") > 0)
    drawn = lines.select(F.lit(UNKNOWN).alias("family"), F.get("l", F.pmod(F.xxhash64("text", F.lit(43)), F.greatest(F.lit(1), F.size("l"))).cast("int")).alias("text"))
    drawn = drawn.orderBy(F.xxhash64("text"), "text").limit(FIT_PARAGRAPHS).withColumn("ws", _words(F.col("text"))).withColumn("g", _grams(F.col("ws")))
    sample = drawn.where(F.greatest(*[_overlap(F.col("g.b"), g) for _, g in notices]) < MIN_OVERLAP)
    label = F.coalesce(*[F.when(F.col("family") == f, F.lit(float(i))) for i, f in enumerate([*names, UNKNOWN])])
    weight = F.when(F.col("sampled"), F.lit(SAMPLE_WEIGHT)).otherwise(1.0)
    both = known.withColumn("sampled", F.lit(False)).unionByName(sample.withColumn("sampled", F.lit(True)))
    rows = both.select("text", label.alias("label"), weight.alias("weight"), F.concat("g.w", "g.b").alias("f"), (F.pmod(F.xxhash64("text", F.lit(5)), F.lit(4)) == 0).alias("out"))
    rows = saved(rows.coalesce(1))
    data = CountVectorizerModel.from_vocabulary(vocabulary, "f", "features").setBinary(True).transform(rows)
    lr = LogisticRegression(regParam=0.0003, elasticNetParam=1.0, maxIter=80, weightCol="weight", family="multinomial", standardization=False)
    y, z = [], []
    trial = lr.fit(data.where("not out"))
    for r in trial.transform(data.where("out")).select("label", vector_to_array("rawPrediction").alias("z")).collect():
        y.append(int(r.label))
        z.append(r.z)
    y, z = np.array(y, dtype=int), np.array(z).reshape(len(y), -1)

    def loss(t: float) -> float:
        q = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean())

    t = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) if len(y) and z.shape[1] > len(names) else 1.0
    held = {}
    if len(y) and z.shape[1] > len(names):
        p = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        guess = np.where(p.max(axis=1) / p.sum(axis=1) >= MIN_PROBABILITY, p.argmax(axis=1), len(names))
        held = {"rows": len(y), "given": int((guess < len(names)).sum()), "have": int((y < len(names)).sum()), "right": int(((guess == y) & (y < len(names))).sum())}
    model = lr.fit(data)
    weights, start = model.coefficientMatrix.toArray().T / t, np.array(model.interceptVector.toArray()) / t
    weights, start = weights[:, :-1] - weights[:, -1:], start[:-1] - start[-1]
    used = np.flatnonzero(np.abs(weights).max(axis=1) > 1e-9)
    return Model(names, [vocabulary[i] for i in used], weights[used], start, notices, alone, held)


def _named(g: Column, model: Model) -> Column:
    """The numbers of the families of which grams have a name."""
    names, family = _list([x for x, _ in model.names]), _list([str(y) for _, y in model.names])
    return F.array_distinct(F.transform(F.array_intersect(F.concat(g["w"], g["b"]), names), lambda x: F.get(family, F.array_position(names, x).cast("int") - 1).cast("int")))


def score_paragraphs(lines: Column, model: Model, named: bool = False) -> Column:
    """An array (family, probability, overlap), in order, of those of the paragraphs that have a family; named: and a name of it."""
    k, features, weights = len(model.families), _list(model.features), _numbers(model.weights)
    grams = F.transform(F.transform(lines, _words), _grams)
    held = (lambda g: _named(g, model)) if named else lambda g: F.array().cast("array<int>")
    found = F.transform(grams, lambda g: F.struct(g["b"].alias("b"), F.array_intersect(F.concat(g["w"], g["b"]), features).alias("f"), held(g).alias("n")))
    add = lambda acc, f: F.zip_with(acc, F.slice(weights, (F.array_position(features, f).cast("int") - 1) * k + 1, k), lambda a, b: a + b)
    logits = F.transform(found, lambda g: F.struct(g["b"].alias("b"), g["n"].alias("n"), F.aggregate(g["f"], _numbers(model.start), add).alias("z")))
    logits = F.transform(logits, lambda g: F.struct(g["b"].alias("b"), g["n"].alias("n"), g["z"].alias("z"), F.array_max(g["z"]).alias("top")))
    share = lambda g: F.exp(g["top"]) / F.aggregate(F.transform(g["z"], F.exp), F.lit(1.0), lambda a, b: a + b)
    best = F.transform(logits, lambda g: F.struct(g["b"].alias("b"), g["n"].alias("n"), (F.array_position(g["z"], g["top"]) - 1).cast("int").alias("y"), share(g).alias("p")))
    sure = F.filter(best, lambda g: (g["p"] >= MIN_PROBABILITY) & (F.array_contains(g["n"], g["y"]) if named else F.lit(True)))
    overlap = lambda g: F.greatest(*[F.when(g["y"] == f, _overlap(g["b"], n)) for f, n in model.notices])
    names = _list(model.families)
    return F.transform(sure, lambda g: F.struct(F.get(names, g["y"]).alias("family"), g["p"].alias("probability"), overlap(g).alias("overlap")))


def scan(docs: DataFrame, model: Model | None = None, gate: bool = True) -> DataFrame:
    """gate=False sends every paragraph through the sums, for tests: the rows are the same."""
    model = model or fit(docs)
    triggers = model.triggers() if gate else None
    rows = docs.select("doc_id", paragraphs("text").alias("l"))
    likely = F.col("l") if triggers is None else F.filter("l", lambda x: F.arrays_overlap(_words(x), _list(triggers)))
    n = F.greatest(F.coalesce(F.size("l"), F.lit(0)), F.lit(0)).cast("long")
    rows = rows.select("doc_id", n.alias("n_paragraphs"), n.alias("n_scored"), likely.alias("l"))
    several = F.filter("l", lambda x: F.size(F.array_distinct(F.flatten(F.transform(F.transform(F.array(_words(x)), _grams), lambda g: _named(g, model))))) > 1)
    rows = rows.withColumns({"s": F.when(F.size("l") > 0, score_paragraphs(F.col("l"), model)), "l": F.when(F.size("l") > 0, several)})
    confirmed = lambda s: F.filter(s, lambda x: x["overlap"] >= MIN_OVERLAP)
    clauses = F.transform("l", lambda x: confirmed(score_paragraphs(F.split(x, _CLAUSE), model, named=True)))
    told = F.filter(clauses, lambda c: F.size(F.array_distinct(c["family"])) > 1)
    none = F.array().cast("array<struct<family:string,probability:double,overlap:double>>")
    rows = rows.withColumn("t", F.coalesce(F.when(F.size("l") > 0, told), F.array(none)))
    rows = rows.withColumns({"yes": F.concat(F.coalesce(confirmed(F.col("s")), none), F.flatten("t")), "t": F.filter("t", lambda c: F.size(c) > 0)})
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    families = F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("yes.family"))), ","), F.lit(""))
    return rows.select("doc_id", "n_paragraphs", "n_scored", count(confirmed(F.col("s"))).alias("n_confirmed"), (count(F.col("s")) - count(confirmed(F.col("s")))).alias("n_unconfirmed"), families.alias("families"), F.array_max(F.col("yes.probability")).alias("probability"), count(F.col("t")).alias("n_several"))
