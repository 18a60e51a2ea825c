"""Licence paragraphs: a sparse word n-gram logistic regression, confirmed by comparison with templates.

Training paragraphs are made from public licence notices by leaving out and adding words; lines of the corpus
are the class ``none``, statements of other licences the class ``unknown``. Scanning applies the fitted model to every
paragraph, in place; the n-grams of those that aren't of class ``none`` are joined with a table of the weights. All of it
runs as SQL functions and Spark ML.
"""

from __future__ import annotations

import itertools

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# At most so many lines of the corpus, picked by hash, teach the class ``none``.
BACKGROUND_LINES = 4000
# Weights up to this size are not in the table.
LEAST_WEIGHT = 1e-4
KNOWN_SHARE = 0.99
CONFIRMED = 0.5
NONE, UNKNOWN = "none", "unknown"
NO_GRAM = ""

# Short public notices by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License.",
        "Distributed under the Apache 2.0 license",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "Licensed under the GPL v2 or later",
        "Released under GPLv3",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "Released under the LGPL",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPLv3",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ],
    UNKNOWN: [
        "This software is licensed under the terms of the agreement that comes with it.",
        "Use of this text is subject to the conditions of the publisher's licence.",
        "Licensed under the Example Community License, version 1.",
        "Released under a custom license, see the license file.",
        "You may copy this document under the terms of the author's license.",
        "Licensed under the Elastic License 2.0.",
    ],
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` made once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(words: Column) -> Column:
    """The distinct one-, two- and three-word runs; none goes over a null."""

    def joined(runs: Column, skipped: int) -> Column:
        following = F.slice(words, skipped + 1, F.size(words))
        return F.zip_with(runs, following, lambda run, word: F.concat(run, F.lit(" "), word))

    # Past the end a following word is null.
    return _let(joined(words, 1), lambda pairs: F.array_distinct(F.array_compact(F.concat(words, pairs, joined(pairs, 2)))))


def grams_of(words: Column) -> Column:
    """The distinct one-, two- and three-word runs."""
    return _let(words, _runs)


def _known_grams(text: Column, anchors: list[str]) -> Column:
    """The part of ``grams_of(words_of(text))`` whose words are all among ``anchors``."""
    return _let(F.transform(words_of(text), lambda word: F.when(word.isin(anchors), word)), _runs)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, place, paragraph``: the lines of each document that aren't blank, numbered from 0."""
    lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("place", "paragraph"))
    return lines.filter(F.length(F.trim("paragraph")) > 0)


def _variants() -> list[tuple[str, str, int]]:
    """Family, text and a running number: the templates, each also with words left out at one place."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            kept = [words, *(words[:i] + words[i + 1 :] for i in range(len(words))), *(words[i:] for i in (1, 2) if len(words) > 5)]
            rows += [(family, " ".join(w)) for w in kept if w]
    return [(family, text, number) for number, (family, text) in enumerate(rows)]


class LicenseModel:
    """Tables of bounded size: n-gram weights and biases by family, template n-grams, the cutoff; the fitted stages, and
    ``slack``, by which a difference of their scores and one of the tables' can disagree. ``anchors`` are all words of
    n-grams with a weight and of templates: no other word changes a score."""

    def __init__(self, weights, biases, templates, anchors, cutoff, temperature, stages, slack):
        self.weights, self.biases, self.templates = weights, biases, templates
        self.anchors, self.cutoff, self.temperature = anchors, cutoff, temperature
        self.stages, self.slack = stages, slack


def _background(docs: DataFrame, text: str) -> DataFrame:
    """A bounded sample of lines that don't speak of licences."""
    whole = F.xxhash64(text)
    lines = docs.select(whole.alias("whole"), F.posexplode(F.split(text, "\n")).alias("place", "paragraph")).filter(
        F.length("paragraph").between(1, 2000) & ~F.lower("paragraph").rlike("licen[sc]|copyright|rights reserved|public domain")
    )
    draw = F.xxhash64("whole", "place", F.lit(3))
    # Every task keeps its first lines by hash; nothing else is shuffled.
    return lines.select(draw.alias("draw"), "paragraph").orderBy("draw").limit(BACKGROUND_LINES).select("paragraph").distinct()


def train(docs: DataFrame, text: str = "text") -> LicenseModel:
    """Fit weights on two of three variants; the rest calibrates the cutoff below which a paragraph is unknown."""
    spark = docs.sparkSession
    background = written(_background(docs, text), "background")
    made = spark.createDataFrame(_variants(), "family string, paragraph string, number int")
    # Each variant also between lines of other words, as notices stand inside paragraphs.
    noise = background.select(F.array_join(F.slice(F.split("paragraph", " "), 1, 12), " ").alias("noise")).limit(40)
    noise = noise.withColumn("turn", F.row_number().over(_any_order()) - 1)
    inside = made.withColumn("turn", F.pmod("number", F.lit(40))).join(F.broadcast(noise), "turn").select(
        "family", F.concat_ws(" ", "noise", "paragraph").alias("paragraph"), "number"
    )
    none = background.select(F.lit(NONE).alias("family"), "paragraph", F.pmod(F.xxhash64("paragraph"), F.lit(1 << 20)).cast("int").alias("number"))
    rows = made.unionByName(inside).unionByName(none).withColumn("grams", grams_of(words_of(F.col("paragraph"))))
    rows = written(rows, "licence-training")
    families = [*TEMPLATES, NONE]
    label = F.element_at(F.create_map(*itertools.chain(*((F.lit(f), F.lit(float(i))) for i, f in enumerate(families)))), F.col("family"))
    rows = rows.withColumn("label", label)
    vectorizer = CountVectorizer(inputCol="grams", outputCol="x", binary=True, minDF=2, vocabSize=20_000)
    fit = rows.filter(F.pmod("number", F.lit(3)) != 0)
    counted = vectorizer.fit(fit.filter(F.col("family") != NONE))
    regression = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.002, maxIter=60)
    fitted = regression.fit(counted.transform(fit))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    table = [
        (gram, families[k], float(matrix[k, j]))
        for j, gram in enumerate(counted.vocabulary)
        for k in range(len(families))
        if abs(matrix[k, j]) > LEAST_WEIGHT
    ]
    # Every paragraph has this gram, so that one without any other gets a score.
    table.append((NO_GRAM, NONE, 0.0))
    left_out = (abs(matrix) * (abs(matrix) <= LEAST_WEIGHT)).sum(axis=1)
    slack = float(left_out[:-1].max() + left_out[-1]) + 1e-6
    weights = written(spark.createDataFrame(table, "gram string, family string, weight double"), "licence-weights")
    biases = {f: float(bias[k]) for k, f in enumerate(families)}
    templates = [(f, n, t) for f, texts in TEMPLATES.items() if f != UNKNOWN for n, t in enumerate(texts)]
    templates = spark.createDataFrame(templates, "family string, template int, paragraph string")
    templates = templates.withColumn("grams", grams_of(words_of(F.col("paragraph")))).select(
        "family", "template", F.size("grams").alias("size"), F.explode("grams").alias("gram")
    )
    templates = written(templates, "licence-templates")
    single = {r["gram"] for r in templates.filter(~F.col("gram").contains(" ")).select("gram").distinct().collect()}
    anchors = sorted(single.union(*(gram.split(" ") for gram in counted.vocabulary)))
    stages = [counted, fitted.setProbabilityCol("").setPredictionCol("").setRawPredictionCol("scores")]
    model = LicenseModel(weights, biases, templates, anchors, 0.0, 1.0, stages, slack)
    held = rows.filter((F.pmod("number", F.lit(3)) == 0) & (F.col("family") != NONE)).select(
        F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("place"), "paragraph", "family", "grams"
    )
    held = written(held, "licence-held-out")
    sure = _probabilities(held.drop("family"), model).join(held.select("doc_id", F.col("family").alias("truth")), "doc_id")
    right = sure.filter((F.col("family") == F.col("truth")) & (F.col("truth") != UNKNOWN))
    model.cutoff = float(right.agg(F.percentile("probability", 1 - KNOWN_SHARE)).first()[0] or 0.0)
    return model


def _any_order():
    from pyspark.sql import Window

    # Over the 40 noise lines only.
    return Window.orderBy("noise")


def _probabilities(candidates: DataFrame, model: LicenseModel) -> DataFrame:
    """The likeliest family of each candidate paragraph, with its probability."""
    grams = F.explode(F.concat("grams", F.array(F.lit(NO_GRAM))))
    grams = candidates.select("doc_id", "place", "paragraph", grams.alias("gram"))
    known = grams.join(model.weights, "gram").groupBy("doc_id", "place", "paragraph", "family")
    sums = known.agg(F.sum("weight").alias("weight")).groupBy("doc_id", "place", "paragraph")
    sums = sums.agg(F.map_from_entries(F.collect_list(F.struct("family", "weight"))).alias("by_family"))
    scores = F.array(
        *[
            F.struct((F.coalesce(F.element_at(F.col("by_family"), f), F.lit(0.0)) + bias).alias("score"), F.lit(f).alias("family"))
            for f, bias in model.biases.items()
        ]
    )
    best = sums.withColumn("scores", scores).withColumn("best", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda sum_, s: sum_ + F.exp(s["score"] - F.col("best.score")))
    return best.select("doc_id", "place", "paragraph", F.col("best.family").alias("family"), (1 / total).alias("probability"))


def _not_none(lines: DataFrame, model: LicenseModel) -> DataFrame:
    """The lines for which some family scores at least as high as ``none``, or ``model.slack`` less, by all their n-grams."""
    scored = lines.withColumn("grams", _known_grams(F.col("paragraph"), model.anchors))
    for stage in model.stages:
        scored = stage.transform(scored)
    # The last score is the one of ``none``.
    best = _let(vector_to_array("scores"), lambda s: F.array_max(F.slice(s, 1, F.size(s) - 1)) + model.slack >= F.element_at(s, -1))
    return scored.filter(best).select(*lines.columns)


def scan(docs: DataFrame, model: LicenseModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, place, family, probability, template_overlap, confirmed`` for every licence paragraph.

    ``place`` is the line's number from 0. A family below the calibrated probability, or whose templates share less
    than half of any one's n-grams with the paragraph, is ``unknown``; ``confirmed`` says whether a template agrees.
    Paragraphs of class ``none``, null and empty texts give no row. Repeated rows give the same findings each;
    other columns are not read.
    """
    model = model or train(docs, text)
    found = _not_none(paragraphs(docs, key, text), model)
    # Equal rows of a table are told apart; equal paragraphs are scored once.
    found = written(found, "licence-candidates")
    distinct = found.select(F.lit(0).alias("doc_id"), F.lit(0).alias("place"), "paragraph").distinct()
    distinct = written(distinct.withColumn("grams", _known_grams(F.col("paragraph"), model.anchors)), "licence-grams")
    scored = _probabilities(distinct, model).filter(F.col("family") != NONE).select("paragraph", "family", "probability")
    shared = (
        distinct.select("paragraph", F.explode("grams").alias("gram"))
        .join(model.templates, "gram")
        .groupBy("paragraph", "family", "template", "size")
        .agg(F.count(F.lit(1)).alias("common"))
        .groupBy("paragraph", "family")
        .agg(F.max(F.col("common") / F.col("size")).alias("overlap"))
    )
    judged = scored.join(shared, ["paragraph", "family"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    confirmed = (F.col("probability") >= model.cutoff) & (F.col("overlap") >= CONFIRMED) & (F.col("family") != UNKNOWN)
    judged = written(judged.withColumn("confirmed", confirmed), "licence-judged")
    return found.join(judged, "paragraph").select(
        "doc_id",
        "place",
        F.when(F.col("confirmed"), F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round("overlap", 6).alias("template_overlap"),
        "confirmed",
    )
