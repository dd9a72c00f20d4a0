"""Corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents, extra ones included. Rows whose doc_id is null cannot be named by a
decision on groups: they pass stages two and three as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktally.llm import decontam, neardup, packing, queries, substring, toxicity
from sparktally.llm.arrow import batches, discard, few, stored


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no column of documents can clash with a result."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _parted(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id, text and all other columns as ``rest``, with the names to carry: a text goes to the Python workers once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*others).alias("rest")] if others else []
    return docs.select("doc_id", "text", *rest), ("text", "rest") if others else ("text",)


def _whole(docs: DataFrame) -> list[Column]:
    """The columns of documents from those of ``_parted``."""
    return [F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; the model is fitted on labelled documents.

    Null and empty texts are scored like any text without words, repeated rows go or stay together, rows without
    a doc_id are scored but not learnt from, very long texts are read whole, an empty table gives no rows.
    """
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    rows, carry = _parted(docs)
    return toxicity.toxicity(rows, model, carry=carry).where("predicted = 0").select(*_whole(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: its smallest doc_id, once if rows repeat.

    Null, empty and blank texts are like no other and stay, rows of one doc_id with different texts are judged each by its
    own text, rows without a doc_id stay, very long texts are compared whole, an empty table gives no rows.
    """
    queries.ship(spark)
    groups = neardup.near_duplicates(docs)
    kept = stored(groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")), "kept")
    discard(groups)
    rows = _carried(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(few(kept), ["doc_id", "text_hash"])
    again = rows.where("times > 1").withColumn("place", F.row_number().over(
        Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("row"), "row")))
    return (
        rows.where("times = 1").select("row.*").union(again.where("place = 1").select("row.*"))
        .union(docs.where("doc_id IS NULL"))
    )


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat an earlier document's; n_chars follows the text.

    Null and empty texts and rows without a doc_id stay as they are, repeated rows are cut alike, very long texts are
    searched whole, an empty table gives no rows.
    """
    queries.ship(spark)
    spans = substring.repeated_passages(docs)
    out = substring.cut_spans(docs, spans)
    discard(spans)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark windows.

    Null and empty texts have no words and stay, repeated rows and rows without a doc_id are judged each, very long
    texts are searched whole, an empty table gives no rows and an empty benchmark removes none.
    """
    rows, carry = _parted(docs)
    hits = decontam.benchmark_hits(rows, queries.table(spark, sf_dir, "benchmark"), carry=carry)
    return hits.where("NOT (n_hit > 0 AND 20 * n_hit >= n_words)").select(*_whole(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids.

    Null and empty texts are one stop id, repeated rows and rows without a doc_id are packed each, long texts are
    cut into pieces, equally good bins are taken as they come, an empty table gives no rows.
    """
    queries.ship(spark)
    return queries.digest_pieces(packing.pack(docs, queries.vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Trained scores and packing cannot be written as SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


#: Rows of an Arrow batch in the stages, some 7 MB of text; Spark's 10 000 take several times that on both sides of each task.
BATCH_ROWS = 2_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with batches(spark, BATCH_ROWS):
            before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
