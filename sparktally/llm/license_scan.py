"""Licence scans with DataFrame functions alone.

A paragraph is a line. Its words and pairs of words are features of a sparse multinomial
logistic regression over licence families and a class for everything else. It is fitted
on parts of the licence templates and on a bounded sample of the corpus's own
paragraphs. The least probability that counts is calibrated on all paragraphs, each
distinct one once, so that ordinary paragraphs stay unknown. A prediction is confirmed by comparing the paragraph
with the family's templates.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktally.llm.arrow import plain, stored

# fixed values: families and the notices by which they are known
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "all-rights-reserved": [
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or distributed without written permission.",
    ],
}
OTHER = "other"
UNKNOWN = "unknown"
#: Distinct corpus paragraphs to fit on.
SAMPLE = 4000
#: Share of a template's word triples that a confirmed paragraph holds.
CONFIRMED = 0.6
#: Share of ordinary paragraphs that the calibrated threshold lets pass, and its least value.
FALSE_ALARMS = 0.0005
LEAST_PROBABILITY = 0.5
_BINS = 10_000

_WORDS = r"regexp_extract_all(lower(paragraph), '[a-z0-9]+(?:[.+-][a-z0-9]+)*', 0)"


def _grams(words: str, n: int) -> str:
    """SQL: the distinct runs of n words, joined by blanks."""
    return (f"array_distinct(transform(sequence(1, greatest(size({words}) - {n - 1}, 0), 1), "
            f"i -> array_join(slice({words}, i, {n}), ' ')))") if n > 1 else f"array_distinct({words})"


def _with_features(paragraphs: DataFrame, vocabulary: Column | None = None) -> DataFrame:
    """Adds ``features``: distinct words and pairs, only those of the vocabulary if given."""
    words = paragraphs.withColumn("words", F.expr(_WORDS))
    pairs = F.expr(f"IF(size(words) > 1, {_grams('words', 2)}, array())")
    grams = F.concat(F.array_distinct("words"), pairs)
    return words.withColumn("features", grams if vocabulary is None else F.array_intersect(grams, vocabulary))


def _triples(words: str) -> Column:
    """Distinct word triples; of fewer words, all of them as one."""
    return F.expr(f"IF(size({words}) >= 3, {_grams(words, 3)}, array(array_join({words}, ' ')))")


def templates(spark: SparkSession) -> DataFrame:
    """family, template (its number), paragraph: the fixed notices."""
    rows = [F.struct(F.lit(family).alias("family"), F.lit(i).alias("template"), F.lit(notice).alias("paragraph"))
            for family, notices in TEMPLATES.items() for i, notice in enumerate(notices)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def _examples(known: DataFrame) -> DataFrame:
    """Every template and its parts of at least half of the words, at least four."""
    words = known.withColumn("words", F.expr(_WORDS))
    return words.select(
        "family",
        F.expr("explode(flatten(transform(sequence(0, size(words) div 2), lead -> transform(sequence(0, size(words) div 2), "
               "tail -> array_join(slice(words, lead + 1, greatest(size(words) - lead - tail, 0)), ' ')))))").alias("paragraph"),
        F.size("words").alias("whole"),
    ).where("size(split(paragraph, ' ')) >= greatest(4, whole div 2)").select("family", "paragraph").distinct()


def paragraphs_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, number, paragraph: the lines with a word; null and empty texts have none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, r"[\r\n]+")).alias("number", "paragraph")).where(
        F.col("paragraph").rlike("[A-Za-z0-9]"))


def _sample(paragraphs: DataFrame, size: int, salt: int) -> tuple[DataFrame, int]:
    """The ``size`` distinct paragraphs of least hash, and how many distinct ones there are; copies count once."""
    order = F.xxhash64("paragraph", F.lit(salt))
    hashes = stored(paragraphs.select(order.alias("order")).distinct(), "hashes")
    last = hashes.orderBy("order").limit(size).agg(F.max("order")).first()[0]
    return paragraphs.where(order <= F.lit(last)).select("paragraph").distinct(), hashes.count()


def _own_triples(known: DataFrame) -> Column:
    """The word triples of all templates, as a constant."""
    return _literals(r[0] for r in known.withColumn("words", F.expr(_WORDS)).select(F.explode(_triples("words"))).distinct().collect())


def train(paragraphs: DataFrame, sample: int = SAMPLE, seed: int = 1) -> tuple[dict[str, list[float]], int]:
    """(weights of all classes by feature, the bias at '', and the number of distinct paragraphs).

    ``paragraphs`` needs a column paragraph. Sampled paragraphs that share a word triple with a
    template are not used as ordinary ones.
    """
    spark = paragraphs.sparkSession
    known = templates(spark)
    rows, total = _sample(paragraphs, sample, seed)
    ordinary = rows.withColumn("words", F.expr(_WORDS)).where(~F.arrays_overlap(_triples("words"), _own_triples(known))).select(
        F.lit(OTHER).alias("family"), "paragraph")

    classes = [*TEMPLATES, OTHER]
    code = F.element_at(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))]), F.col("family"))
    examples = _with_features(stored(_examples(known).union(ordinary), "examples"))
    vocabulary = sorted(r[0] for r in _with_features(known).select(F.explode("features")).distinct().collect())
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="features", outputCol="vector")
    rows = vector.transform(examples.withColumn("label", code)).select("label", "vector")
    fitted = LogisticRegression(
        featuresCol="vector", labelCol="label", family="multinomial", regParam=0.0005,
        elasticNetParam=0.5, maxIter=40, standardization=False).fit(stored(rows.coalesce(1), "vectors"))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    matrix = [[*row] for row in matrix] + [[0.0] * len(vocabulary)] * (len(classes) - len(matrix))
    bias = [*bias] + [-50.0] * (len(classes) - len(bias))
    used = [(f, [float(row[j]) for row in matrix]) for j, f in enumerate(vocabulary) if any(abs(row[j]) > 1e-9 for row in matrix)]
    return {"": [float(b) for b in bias], **dict(used)}, total


def _calibrated(likely: DataFrame, total: int) -> float:
    """The least probability that counts: at most FALSE_ALARMS of all distinct paragraphs pass without being like a template.

    ``likely`` holds all paragraphs of at least LEAST_PROBABILITY with their words; what shares a word triple
    with a template is no false alarm. The histogram is of the whole table.
    """
    strange = likely.where(~F.arrays_overlap(_triples("words"), _own_triples(templates(likely.sparkSession))))
    bins = strange.select(F.xxhash64("paragraph"), F.floor(F.col("probability") * _BINS).alias("bin")).distinct().groupBy("bin").count()
    passed, allowed = 0, int(total * FALSE_ALARMS) + 1
    for at, n in sorted(bins.collect(), reverse=True):
        passed += n
        if passed > allowed:
            return max(LEAST_PROBABILITY, min(0.99, (at + 1) / _BINS))
    return LEAST_PROBABILITY


def scan(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that is a licence notice: doc_id, number, paragraph, family, probability, likeness, confirmed.

    ``number`` counts the lines of the text from 0, ``likeness`` is the share of the best template's word
    triples in the paragraph, ``confirmed`` that it reaches 0.6. A notice that is not confirmed has
    family ``unknown``. Null, empty and blank texts have no paragraphs. Repeated rows are found
    each time, a null doc_id stays null, ties between families go to the last by name, an
    empty table gives no rows, extra columns are ignored, long texts are read whole. Fits the
    classifier, scores all lines and writes the likely ones to the shared folder while it is being planned.
    """
    src = plain(docs, doc_id, text)
    lines = paragraphs_of(src, doc_id, text)
    weights, total = train(lines.select("paragraph"), sample)
    # a paragraph is scored where it stands: no exchange is needed to bring its features together
    # rows are dropped by generators: a filter would be pushed below and repeat the work of all it reads
    found = _with_features(lines, _literals(f for f in weights if f)).select(
        "doc_id", "number", "paragraph", "words", F.explode(F.expr("IF(size(features) > 0, array(features), array())")).alias("features"))
    scored = _scored(found, weights)
    scored = scored.select(*found.columns, F.explode(F.filter(F.array(F.struct("family", "probability")),
                                                              lambda b: b["probability"] >= LEAST_PROBABILITY)).alias("best"))
    likely = stored(scored.select("doc_id", "number", "paragraph", "words", "best.family", "best.probability"), "likely")
    scored = likely.where(F.col("probability") >= _calibrated(likely, total))
    compared = templates(docs.sparkSession).withColumn("words", F.expr(_WORDS)).select(
        F.col("family").alias("of"), _triples("words").alias("triples"))
    lists = compared.groupBy("of").agg(F.collect_list("triples").alias("templates"))
    both = scored.withColumn("mine", _triples("words")).join(F.broadcast(lists), F.col("family") == F.col("of"))
    likeness = F.expr("array_max(transform(templates, t -> size(array_intersect(t, mine)) / size(t)))")
    return both.withColumn("likeness", likeness).select(
        "doc_id", "number", "paragraph",
        F.when(F.col("likeness") >= CONFIRMED, F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"),
        "probability", "likeness", (F.col("likeness") >= CONFIRMED).alias("confirmed"))


def _literals(values) -> Column:
    """Constant array of features, which hold no quotes; written as SQL, so that it costs one call."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")").cast("array<string>")


def _numbers(values) -> Column:
    return F.expr("array(" + ", ".join(f"{v:.9e}D" for v in values) + ")").cast("array<double>")


def _adder(weights: Column):
    return lambda total, place: total + F.element_at(weights, place.cast("int"))


def _scored(found: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """``found`` with the likeliest licence family and its probability; the weights are literals of the plan."""
    classes = [*TEMPLATES, OTHER]
    names = sorted(f for f in weights if f)
    places = F.transform("features", lambda f: F.array_position(_literals(names), f))
    z = []
    for i in range(len(classes)):
        column = _numbers(weights[n][i] for n in names)
        z.append(F.aggregate("at", F.lit(weights[""][i]), _adder(column)))
    out = found.withColumn("at", places).withColumn("z", F.array(*z)).withColumn("top", F.array_max("z"))
    out = out.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
    total = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    best = F.array_max(F.array(*[F.struct((F.element_at("e", i + 1) / total).alias("p"), F.lit(c).alias("family"))
                                 for i, c in enumerate(classes[:-1])]))
    return out.withColumn("best", best).select(
        *found.columns, F.col("best.family").alias("family"), F.col("best.p").alias("probability"))
