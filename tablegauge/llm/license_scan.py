"""Licence notices in texts: a paragraph classifier whose findings templates confirm.

A multinomial logistic regression with an L1 penalty over hashed word n-grams names a
paragraph's licence family or calls it unknown. Its probabilities are tempered on
paragraphs it was not fitted on, and the least probability that counts as a family is
chosen on the same. A family is confirmed if the paragraph holds the word pairs of one of
the family's templates, or is itself a clear part of one. Everything runs as column
expressions within a row; no text is shuffled.
"""

import json
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.words import let, stored

# Wording of common notices, by family.
TEMPLATES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        ' on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is licensed under the Apache License 2.0.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-Clause BSD License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2 or later.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "Public domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this"
        " work.",
    ),
    "Reserved": (
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written"
        " permission of the publisher.",
    ),
}
# Sentences that use a licence's words without being one.
OTHERWISE = (
    "She renewed her driving license at the public office before the version expired.",
    "The law required a copy of the permission, and the conditions were met in writing.",
    "The software of the following year was distributed in source form to the general public.",
    "Their license to sell fish was granted by the city, free of charge, for any person.",
    "The author has rights to the work, and the notice was included in a list of copies.",
    "A patent or copyright dispute about the domain went to court under public attention.",
)
#: Words that make a paragraph a candidate, whatever its likeness to a template.
CUES = ("license", "licence", "copyright", "permission", "redistribut", "public domain", "rights", "cc by")

SIZE = 2048
ORDERS = (1, 2, 3)
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Documents whose paragraphs stand for the unknown class, and paragraphs taken of all their whole texts, at most.
SAMPLE, LINES = 300, 2400
TEMPERATURES = tuple(2.0**k for k in range(-3, 4))
FLOORS = tuple(k / 20 for k in range(6, 20))
PRECISION = 0.99
SIMILAR = 0.8
#: Below this likeness to every template a paragraph is an example of the unknown class; those between teach nothing.
UNLIKE = 0.5
#: What a paragraph must share with a template to be confirmed as a part of it: so many word pairs, or this share of the template.
CLEAR, PART = 6, 0.6
#: Slots of the bitmaps of template pairs that paragraphs are held against first.
SLOTS = 1 << 16

_WORDS = "filter(split({}, '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')"
_PAIRS = "array_distinct(if(size({0}) < 2, {0}, transform(sequence(1, size({0}) - 1), i -> concat({0}[i - 1], ' ', {0}[i]))))"


@dataclass(frozen=True)
class Model:
    """`weights` (SIZE x families, flat) and `biases` of the regression; temperature and floor of its probabilities."""

    weights: tuple[float, ...]
    biases: tuple[float, ...]
    temperature: float
    floor: float


def _grams(words: str) -> str:
    """Numbers of the word n-grams of an array of words."""
    parts = []
    for n in ORDERS:
        gram = ", ".join([f"{n}", *(f"{words}[i + {k}]" for k in range(n))])
        parts.append(
            f"if(size({words}) < {n}, array(), transform(sequence(0, size({words}) - {n}), i -> cast(pmod(xxhash64({gram}), {SIZE}) as int)))"
        )
    return f"array_distinct(concat({', '.join(parts)}))"


def _examples(spark: SparkSession) -> DataFrame:
    """(paragraph words, label): every template alone, within others' words, clipped, and its longer runs."""
    rows = [(text, i) for i, family in enumerate(TEMPLATES) for text in TEMPLATES[family]]
    rows += [(text, len(TEMPLATES)) for text in OTHERWISE]
    listed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(i).alias("label")) for t, i in rows])).alias("r"))
    words = listed.select(F.expr(_WORDS.format("lower(r.text)")).alias("words"), F.col("r.label").alias("label"))
    starts = words.withColumn("from", F.explode(F.expr("sequence(0, greatest(size(words) - 8, 0), 2)")))
    spans = starts.withColumn("take", F.explode(F.expr("array_distinct(array(8, 14, 24, 60))")))
    runs = spans.select(F.expr("slice(words, from + 1, take)").alias("words"), "label")
    around = (
        "words", "concat(array('notice'), words)", "concat(words, array('see', 'file'))", "concat(array('the', 'text', 'is'), words)",
        "concat(array('code'), words, array('and', 'more'))", "slice(words, 2, size(words))", "slice(words, 1, size(words) - 1)",
    )
    varied = words.select(F.explode(F.array(*map(F.expr, around))).alias("words"), "label")
    return varied.union(runs)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    """A model from the templates and from paragraphs of at most `SAMPLE` documents."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    lines = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "id", "left_semi")
        .select(F.explode(F.expr("filter(split(text, '\\n'), x -> length(x) > 20)")).alias("paragraph"))
        .distinct()
        .orderBy(F.xxhash64("paragraph"), "paragraph")
        .limit(LINES)
        .select(F.expr(_WORDS.format("lower(paragraph)")).alias("words"))
        .withColumn("pairs", F.expr(_PAIRS.format("words")))
    )
    likeness = F.array_max(F.transform(_templates(), lambda t: _alike(t, F.col("pairs"))))
    unknown = lines.filter(likeness < UNLIKE).select("words", F.lit(len(TEMPLATES)).alias("label"))
    # Stored on its own: the examples then fit one partition without the table passing through it.
    unknown = stored(unknown, "licence-unknown")
    rows = _examples(spark).union(unknown).select(F.expr(_grams("words")).alias("grams"), "label", F.expr("pmod(xxhash64(words), 4) = 0").alias("check"))
    rows = stored(rows.coalesce(1), "licence-examples")
    numbered = rows.filter("not check").select(F.col("grams").cast("array<string>").alias("grams"), F.col("label").cast("double").alias("label"))
    marks = CountVectorizerModel.from_vocabulary([str(g) for g in range(SIZE)], "grams", "features").setBinary(True)
    learner = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=40, standardization=False)
    fitted = learner.fit(marks.transform(numbered).select("features", "label"))
    classes = fitted.coefficientMatrix.toArray()
    flat = [0.0] * (SIZE * len(FAMILIES))
    for c in range(fitted.numClasses):
        for g in classes[c].nonzero()[0].tolist():
            flat[g * len(FAMILIES) + c] = float(classes[c][g])
    biases = [float(x) for x in fitted.interceptVector.toArray()] + [-9.0] * (len(FAMILIES) - fitted.numClasses)
    margins = rows.filter("check").select("label", _margins(flat, biases, F.col("grams")).alias("m"))
    tried = margins.select("label", "m", F.explode(F.array(*map(F.lit, TEMPERATURES))).alias("t"))
    tempered = tried.withColumn("p", F.expr(_softmax("m", "t")))
    judged = tempered.select(
        "t", (-F.log(F.greatest(F.expr("p[label]"), F.lit(1e-12)))).alias("loss"), F.expr("array_max(p)").alias("top"),
        (F.expr("array_position(p, array_max(p))") - 1).alias("guess"), "label",
    )
    right = F.when(F.col("guess") < len(TEMPLATES), (F.col("guess") == F.col("label")).cast("double"))
    precisions = [F.avg(F.when(F.col("top") >= floor, right)).alias(f"floor{k}") for k, floor in enumerate(FLOORS)]
    losses = judged.groupBy("t").agg(F.avg("loss").alias("loss"), *precisions).collect()
    chosen_row = min(losses, key=lambda r: (r.loss, r.t)) if losses else None
    best = chosen_row.t if chosen_row else 1.0
    precise = [f for k, f in enumerate(FLOORS) if chosen_row and (chosen_row[f"floor{k}"] or 0.0) >= PRECISION]
    floor = min(precise, default=None)
    return Model(tuple(flat), tuple(biases), best, floor if floor is not None else FLOORS[-1])


def _numbers(values: list[float] | tuple[float, ...]) -> Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join("0" if not x else repr(x) for x in values)), ",").cast("array<double>")


def _margins(weights: list[float] | tuple[float, ...], biases: list[float] | tuple[float, ...], grams: Column) -> Column:
    """Log-odds of each family up to a constant, for an array of gram numbers."""
    n = len(FAMILIES)

    def margin(flat: Column, c: int) -> Column:
        return F.aggregate(grams, F.lit(float(biases[c])), lambda total, gram: total + F.element_at(flat, gram * n + c + 1))

    # The constant is bound once, or the plan would repeat it for every family.
    bound = F.transform(F.array(_numbers(weights)), lambda flat: F.array(*[margin(flat, c) for c in range(n)]))
    return F.element_at(bound, 1)


def _softmax(margins: str, temperature: str) -> str:
    raised = f"transform({margins}, x -> exp((x - array_max({margins})) / {temperature}))"
    return let(raised, "e", "transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))")


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` and `notices`, one entry for each candidate paragraph.

    Paragraphs are lines. Candidates have one of the `CUES`, or are similar enough to a
    template of any family; so are two neighbouring lines together, as in hard-wrapped
    notices, unless both are by themselves. An entry has paragraph (its number from 0), lines (1
    or 2), family, probability, similarity and confirmed. A family whose probability is below
    the model's floor is `unknown`; `similarity` is with the named family's templates, 0 for
    unknown: the share of the template's word pairs in the paragraph or, from `CLEAR` common
    pairs or a `PART` of the template on, of the paragraph's in the template. A part that is as
    much like another family's template confirms neither. NULL and empty texts have no notices. Rows
    are independent, so those that repeat an id or are equal have notices each; a column
    named `notices` is replaced, `__lines` is kept for own use. An empty table gives no rows.
    """
    known, telling = _bitmaps(docs.sparkSession)
    # Most texts have no cue at all, which is found once a text.
    cued = "(" + " or ".join(f"contains({{0}}, '{cue}')" for cue in CUES) + ")"
    entry = f"struct(i as paragraph, 1 as lines, c and {cued.format('x')} as cued, {_WORDS.format('x')} as words)"
    lines = let(f"lower({text})", "t", let(cued.format("t"), "c", f"transform(split(t, '\\n'), (x, i) -> {entry})"))
    marked = docs.withColumn("__lines", F.expr(f"if({text} is not null, {lines}, array())"))
    alone = _weighed(marked, "__lines", known, telling)
    beside = (
        "if(size(__lines) < 2, array(), transform(filter(sequence(1, size(__lines) - 1), i ->"
        " not (__lines[i - 1].sure and __lines[i].sure) and __lines[i - 1].met > 0 and __lines[i].met > 0),"
        " i -> struct(__lines[i - 1].paragraph as paragraph, 2 as lines, false as cued,"
        " concat(__lines[i - 1].words, __lines[i].words) as words)))"
    )
    both = _weighed(alone.withColumn("__beside", F.expr(beside)), "__beside", known, telling)
    candidates = both.withColumn(
        "__lines", F.expr("concat(filter(__lines, l -> l.cued or l.sure), filter(__beside, l -> l.sure))")
    ).drop("__beside")
    candidates = candidates.withColumn(
        "__lines",
        F.expr(f"transform(__lines, l -> struct(l.paragraph as paragraph, l.lines as lines, l.words as words, {_PAIRS.format('l.words')} as pairs))"),
    )
    grams = candidates.withColumn(
        "__lines", F.expr(f"transform(__lines, l -> {let('l.words', 'w', f'struct(l.paragraph as paragraph, l.lines as lines, l.pairs as pairs, {_grams("w")} as grams)')})")
    )
    scored = grams.withColumn(
        "__lines",
        F.transform("__lines", lambda l: F.struct(l.paragraph.alias("paragraph"), l.lines.alias("lines"), l.pairs.alias("pairs"), _margins(model.weights, model.biases, l.grams).alias("m"))),
    )
    judged = scored.withColumn(
        "__lines",
        F.expr(f"transform(__lines, l -> struct(l.paragraph as paragraph, l.lines as lines, l.pairs as pairs, {_softmax('l.m', str(model.temperature) + 'D')} as p))"),
    ).withColumn(
        "__lines",
        F.expr(
            "transform(__lines, l -> struct(l.paragraph as paragraph, l.lines as lines, l.pairs as pairs, array_max(l.p) as p,"
            f" if(array_max(l.p) >= {model.floor}D, cast(array_position(l.p, array_max(l.p)) as int) - 1, {len(TEMPLATES)}) as family))"
        ),
    )

    def notice(l: Column) -> Column:
        def most(likeness, of):
            return F.coalesce(F.array_max(F.transform(F.filter(_templates(), of), lambda t: likeness(t, l.pairs))), F.lit(0.0))

        best = most(_alike, lambda t: t.family == l.family)
        sure = (most(_held, lambda t: t.family == l.family) >= SIMILAR) | (best > most(_alike, lambda t: t.family != l.family))
        return F.struct(
            l.paragraph.alias("paragraph"),
            l.lines.alias("lines"),
            F.element_at(F.array(*map(F.lit, FAMILIES)), l.family + 1).alias("family"),
            l.p.alias("probability"),
            best.alias("similarity"),
            ((best >= SIMILAR) & sure).alias("confirmed"),
        )

    return judged.withColumn("notices", F.transform("__lines", notice)).drop("__lines")


def _templates() -> Column:
    return F.from_json(F.lit(json.dumps(_template_pairs())), "array<struct<family: int, pairs: array<string>>>")


def _held(template: Column, pairs: Column) -> Column:
    return F.size(F.array_intersect(template.pairs, pairs)) / F.size(template.pairs)


def _alike(template: Column, pairs: Column) -> Column:
    shared = F.size(F.array_intersect(template.pairs, pairs))
    held = shared / F.size(template.pairs)
    part = F.when((shared >= CLEAR) | (held >= PART), shared / F.size(pairs)).otherwise(0.0)
    return F.greatest(held, part)


def _bitmaps(spark: SparkSession) -> tuple[str, str]:
    """Slots of all pairs of templates, and of their telling pairs, as SQL constants.

    A text that holds `SIMILAR` of a template's pairs lacks few of them, so it has at least
    one of any set of that many and one more; the telling pairs are the longest so many.
    """
    known = _template_pairs()
    every = sorted({pair for t in known for pair in t["pairs"]})
    telling = set()
    for t in known:
        lacking = len(t["pairs"]) - math.ceil(SIMILAR * len(t["pairs"]) - 1e-9)
        telling.update(sorted(t["pairs"], key=lambda pair: (-len(pair), pair))[: lacking + 1])
    slots = spark.range(1).select(F.array(*[F.xxhash64(*map(F.lit, pair.split(" "))) for pair in every])).first()[0]

    def bitmap(pairs: set[str]) -> str:
        words = [0] * (SLOTS >> 6)
        for pair, key in zip(every, slots):
            if pair in pairs:
                words[key % SLOTS >> 6] |= 1 << (key % 64)
        signed = (w - (1 << 64) if w >> 63 else w for w in words)
        return f"cast(split('{','.join(map(str, signed))}', ',') as array<bigint>)"

    return bitmap(set(every)), bitmap(telling)


def _weighed(docs: DataFrame, column: str, known: str, telling: str) -> DataFrame:
    """Paragraphs with `met` (their pairs that are some template's) and `sure`: whether they are similar enough to one.

    Pairs are compared as words only where the bitmaps leave it open.
    """
    keys = "if(size(l.words) < 2, array(), transform(sequence(1, size(l.words) - 1), i -> xxhash64(l.words[i - 1], l.words[i])))"

    def among(bits: str, key: str) -> str:
        return f"getbit(element_at({bits}, cast(shiftright({key} & {SLOTS - 1}, 6) as int) + 1), cast({key} & 63 as int)) = 1"

    least = min(CLEAR, *(math.ceil(PART * len(t["pairs"]) - 1e-9) for t in _template_pairs()))
    near = (
        f"exists(m, x -> {among(telling, 'x')})"
        f" or (size(m) >= {least} and size(array_distinct(m)) >= {SIMILAR}D * size(array_distinct(k)))"
    )
    entry = f"struct(l.paragraph as paragraph, l.lines as lines, l.cued as cued, l.words as words, size(m) as met, {near} as near)"
    met = let(keys, "k", let(f"filter(k, x -> {among(known, 'x')})", "m", entry))
    weighed = docs.withColumn(column, F.expr(f"transform({column}, l -> {met})"))
    paired = weighed.withColumn(
        column,
        F.expr(
            f"transform({column}, l -> struct(l.paragraph as paragraph, l.lines as lines, l.cued as cued, l.words as words, l.met as met,"
            f" if(l.near, {_PAIRS.format('l.words')}, array()) as pairs))"
        ),
    )
    return paired.withColumn(
        column,
        F.transform(
            column,
            lambda l: F.struct(
                *[l[name].alias(name) for name in ("paragraph", "lines", "cued", "words", "met")],
                ((F.size(l.pairs) > 0) & F.exists(_templates(), lambda t: _alike(t, l.pairs) >= SIMILAR)).alias("sure"),
            ),
        ),
    )


def _template_pairs() -> list[dict]:
    """Word pairs of every template, made as `_PAIRS` makes them."""
    found = []
    for i, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            words = re.findall(r"[^\W_]+", text.lower())
            pairs = sorted({" ".join(pair) for pair in zip(words, words[1:])}) or words
            found.append({"family": i, "pairs": pairs})
    return found
