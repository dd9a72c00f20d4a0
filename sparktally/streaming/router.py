"""Streaming forms: routed transactions, windowed metrics, running drift."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparktally.functions.text import ngram_rows
from sparktally.operators import drift as D
from sparktally.operators.classify import _fell_back, classify
from sparktally.operators.cumulative import is_number, weighted_count
from sparktally.operators.frequent import among_most_frequent, most_frequent
from sparktally.session import cut_lineage


def classify_stream(stream: DataFrame, gaz: DataFrame | None = None, **options) -> DataFrame:
    """The router on a stream: stateless projections, so rows leave as they come.

    A gazetteer beyond the shipping bound is looked through in blocks, row by row;
    ``classify_batches`` resolves each label of a batch once.
    """
    return classify(stream, gaz, **options)


#: Process what is there and stop; ``{"processingTime": "1 minute"}`` keeps a query up.
ONCE = {"availableNow": True}


def classify_batches(stream: DataFrame, path: str, checkpoint: str, gaz: DataFrame | None = None,
                     trigger: dict = ONCE, **options) -> StreamingQuery:
    """The router per micro-batch, for gazetteers of any size.

    Every batch has its own folder, overwritten if the batch is replayed.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        classify(batch, gaz, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(route).start()
    )


def metrics_stream(preds: DataFrame, ts: str, width: str = "1 day", delay: str = "1 hour", slide: str | None = None,
                   tau: float = 0.6) -> DataFrame:
    """Requests, fallbacks and coverage per event-time window; late rows go with the watermark."""
    event_time = preds.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return event_time.groupBy(F.window(ts, width, slide)).agg(
        F.count(F.lit(1)).alias("predict_requests_total"),
        weighted_count(_fell_back()).alias("fallback_total"),
        weighted_count(F.col("confidence") >= tau).alias("covered"),
    ).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "predict_requests_total", "fallback_total",
        (F.col("covered") / F.col("predict_requests_total")).alias("coverage"),
        (F.col("fallback_total") / F.col("predict_requests_total")).alias("fallback_rate"),
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  trigger: dict = ONCE) -> StreamingQuery:
    """Write a stream, by default what is there. ``complete`` keeps the latest full result in ``path``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()


# --------------------------------------------------------------------- drift

_COUNTS = "gram string, n_prod bigint"


def running_drift(train_counts: DataFrame, text: str, state_path: str, report_path: str, k: int = D.TOP_K,
                  psi_alert: float = 0.20) -> Callable[[DataFrame, int], None]:
    """Batch function of the drift stream.

    Keeps the running production n-gram counts as one table per batch, derived
    from the table of the batch before, and appends one report row per batch. Both
    paths carry the batch number and are overwritten, so a replayed batch
    leaves the same files.
    """

    def state_at(batch: int) -> str:
        return f"{state_path}/batch={batch}"

    def update(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        counts = D.ngram_counts(rows, text).withColumnRenamed("n", "n_prod")
        if batch_id > 0:
            before = spark.read.schema(_COUNTS).parquet(state_at(batch_id - 1))
            counts = before.unionByName(counts).groupBy("gram").agg(F.sum("n_prod").alias("n_prod"))
        counts.write.mode("overwrite").parquet(state_at(batch_id))
        running = spark.read.schema(_COUNTS).parquet(state_at(batch_id))
        report(train_counts, running, batch_id, k, psi_alert).coalesce(1).write.mode("overwrite").parquet(
            f"{report_path}/batch={batch_id}")

    return update


def report(train_counts: DataFrame, prod_counts: DataFrame, batch_id: int, k: int, psi_alert: float) -> DataFrame:
    """batch_id, n_grams, psi_topk, oov_rate, alert for the running counts."""
    profile = train_counts.select("gram", "n_train").join(prod_counts, "gram", "full_outer").select(
        "gram", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_prod", F.lit(0)).alias("n_prod"))
    psi = D.psi(D.top_ngrams(profile, k)).select("psi").scalar()
    out = profile.agg(
        F.sum("n_prod").alias("n_grams"),
        F.coalesce(
            F.sum(F.when(F.col("n_train") == 0, F.col("n_prod")).otherwise(0)) / F.nullif(F.sum("n_prod"), F.lit(0)),
            F.lit(0.0)).alias("oov_rate"),
    )
    return out.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), "n_grams", psi.alias("psi_topk"), "oov_rate",
        (psi > psi_alert).alias("alert"))


def drift_stream(stream: DataFrame, train_counts: DataFrame, text: str, state_path: str, report_path: str,
                 checkpoint: str, trigger: dict = ONCE, **options) -> StreamingQuery:
    """Running drift of a production stream against a static training profile."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(running_drift(train_counts, text, state_path, report_path, **options)).start()
    )


@dataclass
class Training:
    """The training side of windowed drift, as stored tables: gram counts, marks of the vocabulary, confidence and label counts."""

    grams: DataFrame  # gram, n_train, top
    labels: DataFrame  # class, n
    confidences: DataFrame  # v (whole number), a
    low: int
    high: int


#: Confidences are counted at so many parts of one, which bounds what a window keeps of them.
CONFIDENCE_PARTS = 10_000


def training_side(df: DataFrame, text: str, label: str, conf: str, k: int = D.TOP_K, max_features: int = D.MAX_FEATURES,
                  low: int = 1, high: int = 5) -> Training:
    """Counts of the training rows for ``drift_windows``: the vocabulary's grams, the ``k`` most frequent marked."""
    counts = cut_lineage(D.ngram_counts(df, text, low=low, high=high), "train-counts")
    known = cut_lineage(most_frequent(counts, "n", "gram", max_features), "train-vocabulary")
    top = F.coalesce(among_most_frequent(known, "n", "gram", k), F.lit(False))
    return Training(
        cut_lineage(known.select("gram", F.col("n").alias("n_train"), top.alias("top")), "train-grams"),
        cut_lineage(df.groupBy(_class(label).alias("class")).agg(F.count(F.lit(1)).alias("n")), "train-labels"),
        cut_lineage(df.where(is_number(conf)).groupBy(_part(conf).alias("v")).agg(F.count(F.lit(1)).alias("a")), "train-confidences"),
        low, high)


def _class(label: str) -> Column:
    return F.coalesce(F.col(label).cast("string"), F.lit("nan"))


def _part(conf: str) -> Column:
    return F.round(F.col(conf).cast("double") * CONFIDENCE_PARTS).cast("bigint")


def window_counts(stream: DataFrame, train: Training, ts: str, text: str, label: str, conf: str, width: str, delay: str) -> DataFrame:
    """window_start, kind (text, label, conf), key, n of every window that the watermark has closed.

    Spark's state store keeps the counts of open windows only; a window's leave it when it closes, and rows that come
    later than ``delay`` are dropped. So the state is bounded by the open windows, however long the stream runs. Texts are
    counted whole: a row puts three entries at most into it, and ``window_grams`` cuts each distinct text of a closed window once.
    """
    event_time = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    entries = F.array(
        entry("label", _class(label)), F.when(is_number(conf), entry("conf", _part(conf).cast("string"))),
        F.when(F.col(text).isNotNull(), entry("text", F.col(text))))
    each = event_time.select(ts, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return each.groupBy(F.window(ts, width), F.col("e.kind").alias("kind"), F.col("e.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "kind", "key", "n")


def window_grams(closed: DataFrame, train: Training) -> DataFrame:
    """The counts of closed windows with the n-grams of their texts (kind gram) in place of the texts."""
    texts = closed.where("kind = 'text'").select("window_start", "n", F.col("key").alias("_text"))
    grams = ngram_rows(texts, ["window_start", "n"], "_text", train.low, train.high).groupBy("window_start", "gram").agg(F.sum("n").alias("n"))
    return closed.where("kind <> 'text'").unionByName(grams.select("window_start", F.lit("gram").alias("kind"), F.col("gram").alias("key"), "n"))


def window_reports(counts: DataFrame, train: Training, psi_alert: float = 0.20, shift_alert: float = 0.15,
                   digits: int | None = 4) -> DataFrame:
    """window_start and the drift report of each window from its counts, which should be a stored table."""
    grams = counts.where("kind = 'gram'").join(train.grams.withColumnRenamed("gram", "key"), "key", "left")
    sizes = grams.groupBy("window_start").agg(
        F.sum("n").alias("grams"), F.sum(F.when(F.col("n_train").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)).cast("double").alias("q_total"))
    p_total = train.grams.where("top").agg(F.sum("n_train").cast("double")).scalar()

    def term(n: Column) -> Column:
        return D._psi_term(F.col("n_train"), n, p_total, F.col("q_total"))

    # top grams that a window lacks count with 0: all of them as if lacking, then the difference of those it has
    lacking = train.grams.where("top").agg(F.sum(D._psi_term(F.col("n_train"), F.lit(0.0), p_total, F.lit(1.0)))).scalar()
    held = grams.where("top").join(sizes.select("window_start", "q_total"), "window_start").groupBy("window_start").agg(
        F.sum(term(F.col("n")) - term(F.lit(0.0))).alias("held"))
    text = sizes.join(held, "window_start", "left").select(
        "window_start", (lacking + F.coalesce("held", F.lit(0.0))).alias("psi_topk"),
        F.coalesce(F.col("missing") / F.nullif("grams", F.lit(0)), F.lit(0.0)).alias("oov_rate"))

    labels = counts.where("kind = 'label'")
    windows = labels.groupBy("window_start").agg(F.sum("n").alias("rows"))
    total = train.labels.agg(F.sum("n")).scalar()
    classes = train.labels.agg(F.collect_list(F.struct("class", (F.col("n") / total).alias("share")))).scalar()  # the categories
    expected = windows.select("window_start", "rows", F.explode_outer(classes).alias("t")).select(
        "window_start", "rows", F.col("t.class").alias("class"), F.col("t.share").alias("train"))
    both = expected.join(labels.select("window_start", F.col("key").alias("class"), "n"), ["window_start", "class"], "full_outer")
    both = both.drop("rows").join(windows, "window_start").select(
        "window_start", "class", F.coalesce("train", F.lit(0.0)).alias("train"), F.coalesce(F.col("n") / F.col("rows"), F.lit(0.0)).alias("prod"))
    moved = both.where("class IS NOT NULL").withColumn("abs_delta", F.abs(F.col("prod") - F.col("train")))
    # of equal shifts the first class by name
    first = moved.groupBy("window_start").agg(F.max("abs_delta").alias("most")).join(moved, "window_start").where("abs_delta = most")
    shift = first.groupBy("window_start").agg(F.min(F.struct("class", "train", "prod", "abs_delta")).alias("_shift"))

    mine = counts.where("kind = 'conf'").select("window_start", F.col("key").cast("bigint").alias("v"), F.col("n").alias("b"))
    spread = mine.groupBy("window_start").agg(F.sum("b").alias("m"))
    values = train.confidences.agg(F.collect_list(F.struct("v", "a"))).scalar()  # CONFIDENCE_PARTS + 1 at most
    theirs = spread.select("window_start", F.explode(values).alias("t")).select("window_start", F.col("t.v").alias("v"), F.col("t.a").alias("a"), F.lit(0).cast("bigint").alias("b"))
    together = theirs.union(mine.select("window_start", "v", F.lit(0).cast("bigint"), "b")).groupBy("window_start", "v").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = Window.partitionBy("window_start").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("window_start")
    steps = together.select(
        "window_start", F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"), F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"))
    ks = steps.groupBy("window_start").agg(
        F.max(F.abs(F.col("ca") / F.nullif("na", F.lit(0)) - F.col("cb") / F.nullif("nb", F.lit(0)))).alias("stat"),
        F.max("na").alias("na"), F.max("nb").alias("nb")).select(
        "window_start", F.struct(F.col("stat").alias("ks_stat"), D._ks_pvalue(F.col("stat"), F.col("na"), F.col("nb")).alias("ks_pvalue")).alias("_ks"))
    parts = windows.select("window_start").join(text, "window_start", "left").join(shift, "window_start", "left").join(ks, "window_start", "left")
    filled = parts.withColumns({"psi_topk": F.coalesce("psi_topk", F.lit(0.0)), "oov_rate": F.coalesce("oov_rate", F.lit(0.0))})
    return filled.select("window_start", *D.report_columns(psi_alert, shift_alert, digits))


def drift_windows(stream: DataFrame, train: Training, report_path: str, checkpoint: str, ts: str, text: str = "model_text",
                  label: str = "category_label", conf: str = "conf", width: str = "1 day", delay: str = "1 hour",
                  trigger: dict = ONCE, **options) -> StreamingQuery:
    """A drift report per event-time window, written when the watermark closes it; every batch has its own folder, overwritten if replayed.

    A batch that closes no window writes nothing, but for the first, so that there always is a table.
    """

    def report(closed: DataFrame, batch_id: int) -> None:
        closed = cut_lineage(closed, "closed")
        if batch_id > 0 and closed.isEmpty():
            return
        counts = cut_lineage(window_grams(closed, train), "window-counts")
        window_reports(counts, train, **options).write.mode("overwrite").parquet(f"{report_path}/batch={batch_id}")

    counts = window_counts(stream, train, ts, text, label, conf, width, delay)
    return (
        counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(report).start()
    )


def event_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
