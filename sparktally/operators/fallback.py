"""Last-resort scorer over category names, and the contract of its verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktally import constants as K
from sparktally.functions import similarity
from sparktally.functions.text import BLANKS_TO_ONE, bind, strip, tokenize

#: Value columns that the scorers add.
CATEGORY, CONFIDENCE, REASON = "fb_category", "fb_confidence", "fb_reason"

#: Fixed weights: keyword share, temperature, contained label name.
KEYWORD_WEIGHT = 0.6
TEMPERATURE = 0.3
CONTAINED_NAME = 0.05

#: Texts whose scores a task remembers, so that a text of many rows is scored once per task.
MOST_REMEMBERED = 200_000


def _label_similarity(labels: list[str]):
    """Arrow function: text -> per label the best partial ratio of name and hints, 0..1."""
    terms = [[label.lower(), *K.CATEGORY_HINTS.get(label, [])] for label in labels]

    @F.pandas_udf("array<struct<value:double,shown:string>>")
    def fuzzy(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found: dict[str, list[tuple]] = {}
        for texts in parts:
            if len(found) > MOST_REMEMBERED:
                found.clear()
            fresh = [t for t in texts.dropna().unique() if t not in found]
            best = 0.01 * similarity.best_partial_ratio(fresh, terms)
            found.update({text: [(float(v), f"{v:.3f}") for v in line] for text, line in zip(fresh, best)})
            yield texts.map(lambda t: found.get(t))

    return fuzzy


def fallback_score(df: DataFrame, labels: list[str], text: str = "normalized", fuzzy: str = "similarity") -> DataFrame:
    """Add category, confidence and reason of the likeliest label.

    Every label scores its hint words and, as ``fuzzy`` says, the similarity of
    name and hints to the text, or a small bonus if the name is contained.
    Labels and hints are part of the expression: no row leaves its task. Rows
    with a null text get nulls.
    """
    if fuzzy not in ("similarity", "contains"):
        raise ValueError("fuzzy is 'similarity' or 'contains'")
    if not labels:
        known = F.col(text).isNotNull()
        return df.withColumns({
            CATEGORY: F.when(known, F.lit("")), CONFIDENCE: F.when(known, F.lit(0.0)),
            REASON: F.when(known, F.lit("no-labels")),
        })
    prepared = df.withColumn("_t", strip(F.regexp_replace(F.lower(text), BLANKS_TO_ONE, " ")))
    if fuzzy == "similarity":
        prepared = prepared.withColumn("_fuzzy", _label_similarity(labels)(F.col("_t")))
    else:
        prepared = prepared.withColumn("_fuzzy", F.array(*[
            F.struct(
                F.when(F.col("_t").contains(label.lower()), CONTAINED_NAME).otherwise(0.0).alias("value"),
                F.when(F.col("_t").contains(label.lower()), f"{CONTAINED_NAME:.3f}").otherwise("0.000").alias("shown"),
            )
            for label in labels
        ]))
    hits = F.transform(
        F.array(*[F.array(*[F.lit(h) for h in K.CATEGORY_HINTS.get(label, [])]).cast("array<string>") for label in labels]),
        lambda hints: F.size(F.array_intersect(hints, F.col("_tokens"))),
    )
    scored = prepared.withColumn("_tokens", tokenize("_t")).withColumn("_hits", hits)
    scored = scored.withColumn("_score", F.zip_with(
        "_hits", "_fuzzy", lambda h, f: F.lit(KEYWORD_WEIGHT) * F.least(F.lit(1.0), h / 2.0) + f["value"]))

    def softmax(scores: Column) -> Column:
        top = F.array_max(scores)
        powers = F.transform(scores, lambda s: F.exp((s - top) / TEMPERATURE))
        return bind(powers, lambda e: bind(
            F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda z: F.transform(e, lambda x: x / z)))

    scored = scored.withColumn("_prob", softmax(F.col("_score")))
    best = F.array_position("_prob", F.array_max("_prob")).cast("int")
    scored = scored.withColumn("_best", best)
    names = F.array(*[F.lit(label) for label in labels])
    known = F.col("_t").isNotNull()
    return scored.select(
        *df.columns,
        F.when(known, F.get(names, F.col("_best") - 1)).alias(CATEGORY),
        F.when(known, F.array_max("_prob")).alias(CONFIDENCE),
        F.when(known, F.concat(
            F.lit("kw_hits="), F.get("_hits", F.col("_best") - 1).cast("string"),
            F.lit(", fuzzy="), F.get("_fuzzy", F.col("_best") - 1)["shown"])).alias(REASON),
    )


def validate_verdict(df: DataFrame, labels: list[str], category: str = CATEGORY,
                     confidence: str = CONFIDENCE, reason: str = REASON) -> DataFrame:
    """Unknown category to the first label, confidence clipped to 0..1."""
    if not labels:
        return df.withColumns({
            category: F.lit(""), confidence: F.lit(0.0), reason: F.lit("no-labels")})
    known = F.coalesce(F.col(category).isin(labels), F.lit(False))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(confidence), F.lit(0.0))))
    said = F.coalesce(F.col(reason), F.lit(""))
    return df.withColumns({
        category: F.when(known, F.col(category)).otherwise(labels[0]),
        confidence: clipped,
        reason: F.when(known, said).otherwise(F.trim(F.concat(said, F.lit(" | coerced-to-valid")))),
    })


def fallback(df: DataFrame, labels: list[str], scorer: Callable[[DataFrame], DataFrame] | None = None,
             text: str = "normalized", fuzzy: str = "similarity") -> DataFrame:
    """Verdict of ``scorer`` where it gives one, of the built-in scorer elsewhere.

    ``scorer`` adds scorer_category, scorer_confidence and scorer_reason, and
    leaves the category null where it fails.
    """
    if scorer is None:
        return validate_verdict(fallback_score(df, labels, text, fuzzy), labels)
    judged = scorer(df)
    failed = F.col("scorer_category").isNull()
    # texts the scorer has judged are hidden from the built-in one
    own = fallback_score(judged.withColumn("_open", F.when(failed, F.col(text))), labels, "_open", fuzzy)
    merged = own.withColumns({
        CATEGORY: F.coalesce("scorer_category", CATEGORY),
        CONFIDENCE: F.when(failed, F.col(CONFIDENCE)).otherwise(F.col("scorer_confidence")),
        REASON: F.when(failed, F.concat(F.lit("fallback-stub (no verdict) | "), F.col(REASON))).otherwise(F.col("scorer_reason")),
    })
    return validate_verdict(merged.select(*df.columns, CATEGORY, CONFIDENCE, REASON), labels)
