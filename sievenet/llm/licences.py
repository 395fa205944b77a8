"""Licence scans: a trained paragraph classifier whose predictions templates must confirm.  DataFrame functions only.

Paragraphs are lines.  Binary word 1- and 2-gram features feed a multinomial logistic regression over
licence families and an unknown class; its known classes' probability must pass a limit that is
calibrated on labelled rows kept out of the fit.  A prediction counts if the family's templates
agree, so paragraphs that no template of any family agrees with need no score; all of those teach the
unknown class and set its limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.llm.tables import parts_for, saved, small_enough

UNKNOWN = "unknown"
PLAIN = 500  # rows that all corpus paragraphs of the unknown class weigh as much as, however many they are
AGREE = 0.6  # share of a template's words that a paragraph must hold, or of the paragraph's that the template must
FALSE_SHARE = 0.01  # of kept-out unknown rows that may pass the limit
ROW_BYTES, PART_BYTES = 400, 16 << 20  # of a row of features in memory, about, and of the rows a task of the fit holds

# Short notices by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "Public domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
        "Released under the Unlicense license.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    UNKNOWN: (
        "You need a driving license to rent this car.",
        "The license of the restaurant was withdrawn last year.",
        "A licensed electrician must check the wiring before use.",
        "Poets take license with grammar and with history.",
        "All rights reserved.",
        "Copyright by the author, reproduction is not permitted without written permission.",
        "Ask for permission before you enter the building.",
        "He was granted permission to leave the hospital.",
        "The software license agreement is between you and the vendor.",
        "License fees are due on the first day of each month.",
        "The general public may visit the garden free of charge.",
        "The public library is open to any person from Monday to Friday.",
        "The Apache are a people of the American Southwest.",
        "She studied at MIT and then in Berkeley.",
        "The Mozilla foundation published its yearly report.",
        "This warranty is void if the seal is broken.",
        "Terms and conditions apply to the redistribution of tickets.",
        "The creative common room is free for use.",
    ),
}

WORD = r"[a-z]+|[0-9]+"
LETTERS = "[a-z]+"  # words that count for agreement: numbers don't
MODELS = sorted({tuple(sorted(set(re.findall(LETTERS, text.lower())))) for family, texts in TEMPLATES.items() if family != UNKNOWN for text in texts})


class Classifier(NamedTuple):
    """weights: gram and one column per class (c0, c1, ...); bias and names of the classes; limit of the known probability."""

    weights: DataFrame
    bias: list[float]
    names: list[str]
    limit: float
    templates: DataFrame


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams(own: str) -> Column:
    """Distinct words and pairs of words of an array column."""
    n = F.size(own) - 1
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat_ws(" ", F.get(own, i), F.get(own, i + 1)))).otherwise(F.array())
    return F.array_distinct(F.concat(F.col(own), pairs))


def _agreement(own: Column, both: Column, model_size: Column) -> Column:
    """Share of a template's words that own (distinct words) holds, or if larger of own's that the template holds; both: how many are common."""
    return F.greatest(both / model_size, F.when(F.size(own) >= 4, both / F.size(own)).otherwise(0.0))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def may_agree(paragraph: Column) -> Column:
    """Whether the template of any family agrees with a paragraph; false only where none can."""
    return _bound(words(paragraph), _words_agree)


def _words_agree(own: Column) -> Column:
    """may_agree of a paragraph's words.

    Few paragraphs hold as many template words as the smallest template asks for, or consist of
    them for the most part; only those are compared with each template.
    """
    every = sorted({w for model in MODELS for w in model})
    least = next(k for k in range(1, 1 + min(map(len, MODELS))) if k / min(map(len, MODELS)) >= AGREE)
    letters = F.array_distinct(F.filter(own, lambda w: w >= "a"))
    models = F.array(*(F.array(*map(F.lit, model)) for model in MODELS))

    def among(own: Column, shared: Column) -> Column:
        enough = (F.size(shared) >= least) | ((F.size(own) >= 4) & (F.size(shared) / F.size(own) >= AGREE))
        agrees = F.exists(models, lambda model: _agreement(own, F.size(F.array_intersect(shared, model)), F.size(model)) >= AGREE)
        return F.when(enough, agrees).otherwise(False)

    return _bound(letters, lambda own: _bound(F.filter(own, lambda w: w.isin(every)), lambda shared: among(own, shared)))


def _fold(own: Column) -> Column:
    """0 to 4, by a row's words; rows of fold 0 are kept out of the fit."""
    return F.pmod(F.xxhash64(own, F.lit(3)), F.lit(5))


def _cuts(spark: SparkSession) -> DataFrame:
    """family, grams and fold of cuts of the templates."""
    whole = spark.createDataFrame([(family, text) for family, texts in TEMPLATES.items() for text in texts], "family string, text string").withColumn("words", words("text"))
    n = F.size("words")
    sizes = F.array_distinct(F.array(n, F.greatest(F.lit(3), F.ceil(n * 0.8).cast("int")), F.greatest(F.lit(3), F.ceil(n * 0.6).cast("int"))))
    cut = whole.withColumn("size", F.explode(sizes)).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(n - F.col("size"), F.lit(0)))))
    cuts = cut.select("family", F.slice("words", F.col("at") + 1, "size").alias("words"))
    return cuts.where(F.size("words") > 0).select("family", grams("words").alias("grams"), _fold(F.col("words")).alias("fold"))


def _among(vocabulary: list[str], own: Column) -> Column:
    """Those of grams(own) that are in the vocabulary, sorted; its pairs must be of words that are in it too."""
    single, pairs = [g for g in vocabulary if " " not in g], [g for g in vocabulary if " " in g]
    assert {w for g in pairs for w in g.split(" ")} <= {*single}

    def held(own: Column) -> Column:
        both = F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_sort(F.array_distinct(F.concat(F.filter(own, lambda w: w.isNotNull()), F.filter(both, lambda g: g.isin(pairs)))))

    return _bound(F.transform(own, lambda w: F.when(w.isin(single), w)), held)


def judged(paragraphs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Rows whose paragraph a template of any family agrees with as they are; of others, in place of all columns, what teaches.

    Those have a null paragraph, and grams (those in the vocabulary), fold and print (hashes that tell paragraphs apart).
    Paragraphs without a word teach nothing: all of their columns are null.
    """
    facts = lambda own: F.struct(_words_agree(own).alias("agrees"), _among(vocabulary, own).alias("grams"), _fold(own).alias("fold"), F.size(own).alias("n"))
    each = paragraphs.withColumn("facts", _bound(words("paragraph"), facts))
    agrees, plain = F.col("facts.agrees"), ~F.col("facts.agrees") & (F.col("facts.n") > 0)
    own = [F.when(agrees, F.col(c)).alias(c) for c in paragraphs.columns]
    prints = F.struct(F.xxhash64("paragraph"), F.xxhash64("paragraph", F.lit(1)))
    return each.select(*own, F.when(plain, F.col("facts.grams")).alias("grams"), F.when(plain, F.col("facts.fold")).alias("fold"), F.when(plain, prints).alias("print"))


def vocabulary_of(spark: SparkSession) -> CountVectorizerModel:
    """The grams that count: those of two cuts of notices at least."""
    return CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(_cuts(spark).where(F.col("family") != UNKNOWN))


def train(spark: SparkSession, vector: CountVectorizerModel, read: DataFrame) -> Classifier:
    """A classifier taught by the templates and by every distinct paragraph of the corpus that none agrees with (read: judged, stored).

    Paragraphs with equal grams are one row that weighs as much as they do.  All rows of the corpus together weigh
    as much as PLAIN rows, so that a large corpus doesn't outweigh the notices.
    """
    alike = read.where("grams IS NOT NULL").groupBy("grams", "fold").agg(F.count_distinct("print").alias("n"))
    alike = saved(alike, "alike")
    size, total = alike.agg(F.count(F.lit(1)), F.sum("n")).first()
    weight = min(1.0, PLAIN / total) if total else 1.0
    cuts = _cuts(spark).select("family", "grams", "fold", F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("weight")).coalesce(1)
    plain = alike.coalesce(parts_for(size * ROW_BYTES, PART_BYTES)).select(F.lit(UNKNOWN).alias("family"), "grams", "fold", "n", (F.col("n") * weight).alias("weight"))
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(cuts)
    ready = index.transform(vector.transform(cuts.unionByName(plain)))
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, weightCol="weight").fit(ready.where("fold != 0"))
    names, table = index.labels, model.coefficientMatrix.toArray()
    columns = [f"c{k}" for k in range(len(names))]
    weights = spark.createDataFrame([(gram, *map(float, table[:, j])) for j, gram in enumerate(vector.vocabulary)], "gram string, " + ", ".join(f"{c} double" for c in columns))
    templates = spark.createDataFrame([(family, text) for family, texts in TEMPLATES.items() if family != UNKNOWN for text in texts], "family string, template string").withColumn("model", F.array_distinct(words("template")))
    kept_out = model.transform(ready.where(f"fold = 0 and family = '{UNKNOWN}'"))
    known = F.round(1 - F.get(vector_to_array("probability"), F.lit(names.index(UNKNOWN))), 4)  # few values, however many rows
    highest = kept_out.groupBy(known.alias("known")).agg(F.sum("n").alias("n")).agg(F.percentile("known", 1 - FALSE_SHARE, F.col("n"))).first()[0]
    return Classifier(weights, [float(b) for b in model.interceptVector], names, min(0.9, max(0.5, highest or 0.0)), templates)


def scored(paragraphs: DataFrame, by: Classifier) -> DataFrame:
    """paragraph, family (the best known class) and known (the probability that any known class is right) of distinct paragraphs."""
    columns = [f"c{k}" for k in range(len(by.names))]
    each = paragraphs.withColumn("words", words("paragraph")).select("paragraph", F.explode_outer(grams("words")).alias("gram"))
    sums = each.join(F.broadcast(by.weights), "gram", "left").groupBy("paragraph").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
    # arrays keep the plan small: a filter on known is pushed below, with its whole expression in place of the name
    logits = sums.select("paragraph", F.array(*[F.col(c) + b for c, b in zip(columns, by.bias, strict=True)]).alias("logits"))
    powers = logits.select("paragraph", F.transform("logits", lambda x: F.exp(x - F.array_max("logits"))).alias("powers"))
    unknown, names = by.names.index(UNKNOWN), F.array(*map(F.lit, by.names))
    total = lambda own: F.aggregate(own, F.lit(0.0), lambda a, p: a + p)
    known = F.filter("powers", lambda p, k: k != unknown)
    named = F.filter(F.transform("powers", lambda p, k: F.struct(p.alias("p"), F.get(names, k).alias("name"))), lambda s: s["name"] != UNKNOWN)
    return powers.select("paragraph", F.array_max(named)["name"].alias("family"), (total(known) / total(F.col("powers"))).alias("known"))


def confirmed(predicted: DataFrame, by: Classifier) -> DataFrame:
    """Predictions over the limit that a template of their family confirms."""
    own = F.array_distinct(F.regexp_extract_all(F.lower("paragraph"), F.lit(LETTERS), F.lit(0)))
    near = predicted.where(F.col("known") >= by.limit).withColumn("own", own).join(F.broadcast(by.templates.withColumn("model", F.filter("model", lambda w: ~w.rlike("^[0-9]+$")))), "family")
    both = F.size(F.array_intersect("own", "model"))
    return near.groupBy("paragraph", "family", "known").agg(F.max(_agreement(F.col("own"), both, F.size("model"))).alias("agreement")).where(F.col("agreement") >= AGREE)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families and score of each row of docs.

    n_licences counts the paragraphs (lines that aren't blank) with a confirmed licence, families names
    theirs in order, comma-joined (empty without any), score is the largest probability (0 without any).
    A null or empty text has no paragraph.  Rows that repeat a doc_id give a row each; those with equal
    doc_id and text are judged alike.  Only doc_id and text are used.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("paragraphs"))
    vector = vocabulary_of(docs.sparkSession)
    read = saved(judged(own.select("doc_id", "mark", F.explode("paragraphs").alias("paragraph")), vector.vocabulary), "judged")
    by = train(docs.sparkSession, vector, read)
    near = read.where("paragraph IS NOT NULL")
    counted = saved(near.groupBy("doc_id", "mark", "paragraph").agg(F.count(F.lit(1)).alias("n")), "near")
    good = saved(confirmed(scored(counted.select("paragraph").distinct(), by), by), "confirmed")
    found = counted.join(good, "paragraph").groupBy("doc_id", "mark").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("family")).alias("families"), F.max("known").alias("score"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_paragraphs"))
    # a repeated row's paragraphs were counted for all of its repeats together
    times = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    found = found.join(times, found.doc_id.eqNullSafe(times.doc_id) & (found.mark == times.mark), "left").select(found.doc_id.alias("d"), found.mark.alias("m"), (F.col("n") / F.coalesce("times", F.lit(1))).cast("long").alias("n_licences"), "families", "score")
    found = saved(found, "licences")
    out = rows.join(F.broadcast(found) if small_enough(found, 96) else found, rows.doc_id.eqNullSafe(F.col("d")) & (rows.mark == F.col("m")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"), F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), F.coalesce("score", F.lit(0.0)).alias("score"))
