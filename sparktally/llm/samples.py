"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktally.llm.arrow import fold


def labelled(labels: DataFrame, label: str, held_out: int, folds: int = 3, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and label (0 or 1) outside the held-out fold; ids with differing labels are left out."""
    return (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id IS NOT NULL AND _label IN (0, 1)").where(fold("_id", folds) != held_out)
        .groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
        .where("_label = _other").drop("_other")
    )


def bounded(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label: those with the least hash of their id.

    Two ordered limits, so at most 2 * per_class small rows travel, and the result may be broadcast.
    """
    ordered = labels.withColumn("_order", F.xxhash64("_id", F.lit(17)))
    parts = [ordered.where(F.col("_label") == value).orderBy("_order", "_id").limit(per_class) for value in (0, 1)]
    return parts[0].union(parts[1]).select("_id", "_label")


def sampled_texts(docs: DataFrame, labels: DataFrame, per_class: int, doc_id: str, text: str) -> DataFrame:
    """(text, label) of the sampled ids; the sample has a fixed bound, so it is broadcast."""
    chosen = F.broadcast(bounded(labels, per_class))
    return docs.join(chosen, docs[doc_id] == chosen["_id"]).select(F.col(text).alias("text"), F.col("_label").alias("label"))
