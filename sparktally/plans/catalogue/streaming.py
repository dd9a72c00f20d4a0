"""Streaming forms, run over what is there and compared with the batch result."""

from pyspark.sql import functions as F

from sparktally import constants as K
from sparktally.operators import drift as D
from sparktally.plans import sqltext as S
from sparktally.plans.catalogue.drift import PROFILE, prepared, train
from sparktally.plans.catalogue.routing import _CLASSIFY, _CLASSIFY_LABELS
from sparktally.plans.catalogue.text import PREPARED
from sparktally.plans.fixtures import LABEL_SEED_SQL, TX_SQL, gazetteer, table
from sparktally.plans.registry import query
from sparktally.session import cut_lineage, scratch_path
from sparktally.streaming import router as ST


def transaction_stream(spark, sf, max_files=None):
    """The orders table as a stream of transactions."""
    schema = table(spark, sf, "orders").schema
    orders = ST.event_stream(spark, f"{sf.rstrip('/')}/orders.parque[t]", schema, max_files)
    return spark.sql(TX_SQL, orders=orders, label_seed=spark.sql(LABEL_SEED_SQL))


@query("classify_stream", f"{_CLASSIFY} SELECT * FROM routed")
def classify_stream(spark, sf):
    path = scratch_path(spark, "classified")
    routed = ST.classify_stream(transaction_stream(spark, sf), gazetteer(spark))
    ST.run_available(routed, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(routed.schema).parquet(path)


@query("classify_batches", f"{_CLASSIFY} SELECT * FROM routed")
def classify_batches(spark, sf):
    """Per micro-batch, with the blocked join in place of the shipped gazetteer."""
    path = scratch_path(spark, "classified")
    ST.classify_batches(
        transaction_stream(spark, sf), path, scratch_path(spark, "checkpoint"), gazetteer(spark), max_shipped=0,
    ).awaitTermination()
    return spark.read.parquet(path).drop("batch")


@query("metrics_stream", f"""{_CLASSIFY_LABELS.replace("SELECT tx_id, operation_type, gaz_display", "SELECT tx_id, tx_date, operation_type, gaz_display")}
SELECT CAST(CAST(tx_date AS TIMESTAMP) AS VARCHAR) AS window_start, COUNT(*) AS predict_requests_total,
  COUNT(*) FILTER (WHERE contains(router, 'llm')) AS fallback_total,
  COUNT(*) FILTER (WHERE confidence >= 0.6) / CAST(COUNT(*) AS DOUBLE) AS coverage FROM routed GROUP BY 1""")
def metrics_stream(spark, sf):
    path = scratch_path(spark, "metrics")
    routed = ST.classify_stream(
        transaction_stream(spark, sf), gazetteer(spark), labels=K.CATEGORIES, keys=("tx_id", "tx_date"))
    windows = ST.metrics_stream(routed, "tx_date", "1 day")
    ST.run_available(windows, path, scratch_path(spark, "checkpoint"), "complete").awaitTermination()
    return spark.read.parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "predict_requests_total", "fallback_total", "coverage")


@query("metrics_stream_events", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS predict_requests_total,
  COUNT(*) FILTER (WHERE event_type = 'error') AS fallback_total,
  COUNT(*) FILTER (WHERE value >= 0.6) / CAST(COUNT(*) AS DOUBLE) AS coverage FROM events GROUP BY 1""")
def metrics_stream_events(spark, sf):
    events = ST.event_stream(spark, f"{sf.rstrip('/')}/events.parque[t]", table(spark, sf, "events").schema)
    preds = events.select(
        "ts", F.col("value").alias("confidence"),
        F.when(F.col("event_type") == "error", "model>llm").otherwise("rules").alias("router"))
    path = scratch_path(spark, "metrics")
    windows = ST.metrics_stream(preds, "ts", "1 hour", "10 minutes")
    ST.run_available(windows, path, scratch_path(spark, "checkpoint"), "complete").awaitTermination()
    return spark.read.parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "predict_requests_total", "fallback_total", "coverage")


@query("drift_stream", f"""{PROFILE}
SELECT 1::BIGINT AS batch_id, CAST(SUM(n_prod) AS BIGINT) AS n_grams, ROUND((SELECT psi FROM psi), 6) AS psi_topk,
  ROUND(CAST(SUM(CASE WHEN n_train = 0 THEN n_prod ELSE 0 END) AS DOUBLE) / SUM(n_prod), 6) AS oov_rate,
  (SELECT psi FROM psi) > 0.2 AS alert FROM profile""")
def drift_stream(spark, sf):
    """Two batches, one per half of the production rows; the last report covers both."""
    landing, state, reports = (scratch_path(spark, n) for n in ("landing", "state", "reports"))
    prod = prepared(spark, sf).where(~train()).select("tx_id", "model_text")
    half = F.pmod(F.xxhash64("tx_id"), F.lit(2)) == 0
    for part in (half, ~half):
        prod.where(part).coalesce(1).write.mode("append").parquet(landing)
    train_counts = D.ngram_counts(prepared(spark, sf).where(train()), "model_text").withColumnRenamed("n", "n_train")
    counts_path = scratch_path(spark, "train-counts")
    train_counts.write.parquet(counts_path)
    stream = ST.event_stream(spark, landing, prod.schema, max_files=1)
    ST.drift_stream(
        stream, spark.read.schema(train_counts.schema).parquet(counts_path), "model_text", state, reports,
        scratch_path(spark, "checkpoint")).awaitTermination()
    report = spark.read.parquet(f"{reports}/batch=1")
    return report.select("batch_id", "n_grams", F.round("psi_topk", 6).alias("psi_topk"),
                         F.round("oov_rate", 6).alias("oov_rate"), "alert")


@query("metrics_stream_late_rows", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS predict_requests_total,
  COUNT(*) FILTER (WHERE event_type = 'error') AS fallback_total,
  COUNT(*) FILTER (WHERE value >= 0.6) / CAST(COUNT(*) AS DOUBLE) AS coverage FROM events GROUP BY 1""")
def metrics_stream_late_rows(spark, sf):
    """Append mode: the third file repeats rows of the first days, whose windows the watermark has closed, so they change nothing.

    Spark drops late rows by the watermark of the batch before the last. A row far ahead in the fourth file closes
    all windows but its own.
    """
    events = table(spark, sf, "events").select(
        "ts", F.col("value").alias("confidence"),
        F.when(F.col("event_type") == "error", "model>llm").otherwise("rules").alias("router"))
    last = events.agg(F.max("ts")).first()[0]
    cut = F.date_trunc("day", F.lit(last)) - F.expr("INTERVAL 1 DAY")
    early, rest = events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)
    late = early.where(F.col("ts") < F.lit(last) - F.expr("INTERVAL 5 DAYS")).sample(0.2, seed=1)
    marker = events.limit(1).select((F.lit(last) + F.expr("INTERVAL 3 DAYS")).alias("ts"), "confidence", "router")
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "metrics")
    for part in (early, rest, late, marker):  # one file each, read in this order
        part.coalesce(1).write.mode("append").parquet(landing)
    stream = ST.event_stream(spark, landing, events.schema, max_files=1)
    windows = ST.metrics_stream(stream, "ts", "1 hour", "10 minutes")
    ST.run_available(windows, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(windows.schema).parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "predict_requests_total", "fallback_total", "coverage")


@query("drift_stream_windows", f"""{PREPARED},
p AS (SELECT *, CAST(floor(date_diff('day', DATE '1970-01-01', tx_date) / 365) AS BIGINT) AS w FROM prepared WHERE split = 'prod'),
tg AS (SELECT gram, COUNT(*) AS n_train FROM (SELECT unnest({S.ngrams("model_text")}) AS gram FROM prepared WHERE split = 'train') GROUP BY 1),
vocab AS (SELECT * FROM tg ORDER BY n_train DESC, gram LIMIT 200000),
top AS (SELECT * FROM tg ORDER BY n_train DESC, gram LIMIT 500),
wg AS (SELECT w, gram, COUNT(*) AS n FROM (SELECT w, unnest({S.ngrams("model_text")}) AS gram FROM p) GROUP BY 1, 2),
ws AS (SELECT DISTINCT w FROM p),
tw AS (SELECT w, gram, n_train, coalesce(n, 0) AS n FROM ws CROSS JOIN top LEFT JOIN wg USING (w, gram)),
sh AS (SELECT w, n_train / (SUM(n_train) OVER (PARTITION BY w) + 1e-12) AS a, n / (SUM(n) OVER (PARTITION BY w) + 1e-12) AS b FROM tw),
psi AS (SELECT w, SUM((b - a) * ln((b + 1e-12) / (a + 1e-12))) AS psi FROM sh GROUP BY w),
oov AS (SELECT w, SUM(CASE WHEN v.gram IS NULL THEN n ELSE 0 END) / CAST(SUM(n) AS DOUBLE) AS oov FROM wg LEFT JOIN vocab v USING (gram) GROUP BY w),
tm AS (SELECT category_label AS class, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS train FROM prepared WHERE split = 'train' GROUP BY 1),
wm AS (SELECT w, category_label AS class, COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY w) AS DOUBLE) AS prod FROM p GROUP BY 1, 2),
mv AS (SELECT w, class, abs(coalesce(prod, 0) - coalesce(train, 0)) AS d FROM (SELECT w, class, train FROM ws CROSS JOIN tm) FULL OUTER JOIN wm USING (w, class)),
sf AS (SELECT w, class, d FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY d DESC, class) AS r FROM mv) WHERE r = 1),
vs AS (SELECT DISTINCT conf AS v FROM prepared),
tc AS (SELECT v, (SELECT COUNT(*) FROM prepared WHERE split = 'train' AND conf <= v) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM prepared WHERE split = 'train') AS f FROM vs),
wc AS (SELECT w, v, COUNT(*) FILTER (WHERE conf <= v) / CAST(COUNT(*) AS DOUBLE) AS g FROM p CROSS JOIN vs GROUP BY 1, 2),
ks AS (SELECT w, MAX(abs(f - g)) AS ks FROM wc JOIN tc USING (v) GROUP BY w)
SELECT strftime(DATE '1970-01-01' + CAST(w * 365 AS INTEGER), '%Y-%m-%d') AS window_start, ROUND(psi, 4) AS psi_topk, ROUND(oov, 4) AS oov_rate,
  ROUND(ks, 4) AS ks_confidence_stat, class AS shift_class, ROUND(d, 4) AS shift_abs_delta, psi > 0.2 OR d > 0.15 AS alert
FROM psi JOIN oov USING (w) JOIN ks USING (w) JOIN sf USING (w)""")
def drift_stream_windows(spark, sf):
    """A drift report per 365 days of the production rows, which come in order of time in four parts; a row far ahead closes the last window.

    The stream runs again from its checkpoint for each part, so a part may be any number of files.
    """
    rows = prepared(spark, sf).select("tx_date", "model_text", "category_label", "conf", "split")
    known = ST.training_side(rows.where(train()), "model_text", "category_label", "conf")
    prod = cut_lineage(rows.where(~train()).select(F.col("tx_date").cast("timestamp").alias("ts"), "model_text", "category_label", "conf"), "prod")
    first, last = prod.agg(F.min("ts"), F.max("ts")).first()
    landing, reports, checkpoint = (scratch_path(spark, n) for n in ("landing", "reports", "checkpoint"))
    step = (last - first) / 4

    def arrive(part):
        part.write.mode("append").parquet(landing)
        ST.drift_windows(ST.event_stream(spark, landing, prod.schema), known, reports, checkpoint, "ts", width="365 days", delay="1 day").awaitTermination()

    for i in range(4):
        part = prod.where(F.col("ts") >= F.lit(first + i * step))
        arrive(part if i == 3 else part.where(F.col("ts") < F.lit(first + (i + 1) * step)))
    arrive(prod.limit(1).withColumn("ts", F.lit(last) + F.expr("INTERVAL 800 DAYS")))
    found = spark.read.parquet(reports)
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "psi_topk", "oov_rate", "ks_confidence_stat",
        F.col("largest_label_shift.class").alias("shift_class"), F.col("largest_label_shift.abs_delta").alias("shift_abs_delta"),
        D.any_alert().alias("alert"))
