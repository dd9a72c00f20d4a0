"""Term counts, TF-IDF, vocabularies, label codes, splits and OOV rates."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktally.functions.text import char_ngrams, ngram_rows, one_per_row
from sparktally.operators.frequent import attach, most_frequent, text_counts
from sparktally.session import cut_lineage

MAX_FEATURES = 200_000


def bag_of_words(df: DataFrame, doc: str, terms: str) -> DataFrame:
    """doc, term, n: one row per distinct term of a document."""
    return one_per_row(df, [doc], terms, "term").groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, terms: str, preview: int = 30) -> DataFrame:
    """Number of distinct terms and the first ones in order."""
    distinct = one_per_row(df, [], terms, "term").distinct()
    first = distinct.orderBy("term").limit(preview)
    return first.agg(F.array_sort(F.collect_list("term")).alias("preview")).select(
        distinct.agg(F.count(F.lit(1))).scalar().alias("vocabulary_size"), "preview")


def tfidf(df: DataFrame, doc: str, terms: str, weight: str | None = None,
          max_features: int | None = None) -> DataFrame:
    """doc, term, tf, tfidf with smoothed idf and unit length per document.

    idf = ln((1 + n) / (1 + df)) + 1. ``weight`` is the number of copies a
    document stands for, so equal texts need to be split only once; rows with a
    weight are expected to come from a grouping by ``doc``.

    Documents are placed by key before their terms are listed. Term counts and
    lengths then need no further shuffle. Where no key repeats, a term's documents are counted where they lie, so texts move once. The term table is written once; limited to
    ``MAX_FEATURES`` terms or fewer it is broadcast, else only if its file is small enough for Spark to do so.
    """
    copies = F.col(weight) if weight else F.lit(1)
    docs = df.select(doc, copies.cast("bigint").alias("_w"), terms)
    placed = docs if weight else docs.repartition(doc)
    counts = one_per_row(placed, [doc, "_w"], terms, "term").groupBy(doc, "_w", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    if max_features is None and (weight or docs.groupBy(doc).count().where("count > 1").isEmpty()):
        known = one_per_row(docs, ["_w"], F.array_distinct(F.col(terms)), "term").groupBy("term").agg(F.sum("_w").alias("_df"))
    else:
        known = counts.groupBy("term").agg(
            F.sum("_w").alias("_df"), F.sum(F.col("_w") * F.col("tf")).alias("_corpus"))
    known = cut_lineage(known, "terms")
    if max_features is not None:
        known = most_frequent(known, "_corpus", "term", max_features)
    known = known.select("term", "_df")
    if max_features is not None and max_features <= MAX_FEATURES:
        known = F.broadcast(known)  # so many rows at most; the terms of a document then stay where they are
    n = docs.agg(F.sum("_w")).scalar()
    idf = F.ln((1.0 + n) / (1.0 + F.col("_df"))) + 1.0
    weighted = counts.join(known, "term").withColumn("_x", F.col("tf") * idf)
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", "tf", (F.col("_x") / length).alias("tfidf"))


def char_tfidf(df: DataFrame, text: str, low: int = 1, high: int = 5, max_features: int = MAX_FEATURES) -> DataFrame:
    """TF-IDF of character n-grams per distinct text, counted over all rows."""
    texts = df.groupBy(text).agg(F.count(F.lit(1)).alias("_copies"))
    split = texts.withColumn("_grams", char_ngrams(text, low, high))
    return tfidf(split, text, "_grams", "_copies", max_features)


def encode_labels(df: DataFrame, label: str, code: str = "label_index") -> DataFrame:
    """Add the position of the label among the sorted distinct labels.

    The fitted class list travels with the transform: rows stay where they are.
    """
    named = df.withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit("")))
    indexer = StringIndexer(inputCol="_label", outputCol="_code", stringOrderType="alphabetAsc")
    fitted = indexer.fit(named.where(F.col(label).isNotNull())).setHandleInvalid("keep")
    coded = F.when(F.col(label).isNotNull(), F.col("_code").cast("bigint"))
    return fitted.transform(named).withColumn(code, coded).drop("_label", "_code")


def stratified_split(df: DataFrame, key: str, label: str, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part``: 'val' for the share ``val`` of every class, drawn by hash, else 'train'.

    Rows rank by md5 of the key within their class. Counts of 4096 hash slices
    locate the slice that holds the last val row of a class, and only that slice
    is ranked; every row then compares itself with that one cut. A class of
    any size is never gathered in one task. The tables of edges and cuts have
    one row per class; they are written, so their real size decides the joins.
    """
    def draw() -> Column:
        return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))

    drawn = df.select(label, F.col(key).alias("_key"), draw().alias("_h"))
    drawn = drawn.withColumn("_slice", F.substring("_h", 1, 3))
    slices = drawn.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    counted = slices.select(
        label, "_slice", "_n", F.sum("_n").over(so_far).alias("_cum"),
        F.floor(F.sum("_n").over(Window.partitionBy(label)) * F.lit(val) + 0.5).alias("_wanted"))
    edge = counted.where("_cum >= _wanted AND _cum - _n < _wanted AND _wanted > 0").select(
        F.col(label).alias("_label"), "_slice", (F.col("_wanted") - (F.col("_cum") - F.col("_n"))).alias("_take"))
    edge = cut_lineage(edge.withColumnRenamed("_slice", "_edge"), "edges")
    same_class = F.col(label).eqNullSafe(F.col("_label"))
    inside = drawn.join(edge, same_class & (F.col("_slice") == F.col("_edge")))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_key"))
    cuts = inside.withColumn("_r", rank).where("_r = _take").select(
        "_label", F.col("_h").alias("_cut_h"), F.col("_key").alias("_cut_key"))
    hashed = df.withColumn("_h", draw()).join(cut_lineage(cuts, "cuts"), same_class, "left")
    chosen = (F.col("_h") < F.col("_cut_h")) | (
        (F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_key")))
    return hashed.select(*df.columns, F.when(chosen, "val").otherwise("train").alias("part"))


def oov_rate_row(df: DataFrame, key: str, text: str, vocab: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """key, oov: share of the n-grams of a text that ``vocab(gram)`` lacks; 1.0 without n-grams.

    Distinct texts are counted, split and looked up once; texts that fill much of the table come back
    by broadcast, all others by a join.
    """
    counts = cut_lineage(text_counts(df, text), "texts")
    grams = ngram_rows(counts.where("_text IS NOT NULL").select("_text"), ["_text"], "_text", low, high)
    known = vocab.select("gram").distinct().withColumn("_known", F.lit(True))
    rates = grams.join(known, "gram", "left").groupBy("_text").agg(
        F.avg(F.when(F.col("_known"), 0.0).otherwise(1.0)).alias("oov"))
    rows = df.select(key, F.col(text).alias("_text"))
    return attach(rows, cut_lineage(rates, "rates"), "_text", counts).select(key, F.coalesce("oov", F.lit(1.0)).alias("oov"))
