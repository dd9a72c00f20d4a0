"""Offline evaluation."""

from pyspark.sql import functions as F

from sparktally.operators import evaluate as E
from sparktally.plans.fixtures import WITH_TX, table, transactions
from sparktally.plans.registry import query

_CLASSES = """cells AS (SELECT category_label AS truth, pred, COUNT(*) AS n FROM tx GROUP BY 1, 2),
classes AS (SELECT truth AS class FROM cells UNION SELECT pred FROM cells),
scores AS (SELECT class,
  coalesce((SELECT SUM(n) FROM cells WHERE truth = class AND pred = class), 0) AS tp,
  coalesce((SELECT SUM(n) FROM cells WHERE truth <> class AND pred = class), 0) AS fp,
  coalesce((SELECT SUM(n) FROM cells WHERE truth = class AND pred <> class), 0) AS fn FROM classes),
f1 AS (SELECT AVG(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2.0*tp/(2*tp+fp+fn) END) AS macro_f1 FROM scores)"""

_GRID = ", ".join(f"({tau!r}::DOUBLE)" for tau in E.TAU_GRID)
_SWEEP = f"""{WITH_TX}, {_CLASSES},
grid AS (SELECT * FROM (VALUES {_GRID}) AS g(tau)),
sweep AS (SELECT tau, CAST(SUM(CASE WHEN conf >= tau THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS coverage
  FROM grid, tx GROUP BY tau)"""


@query("accuracy", f"""{WITH_TX}
SELECT AVG(CASE WHEN pred = category_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM tx""")
def accuracy(spark, sf):
    return E.accuracy(transactions(spark, sf), "category_label", "pred")


@query("macro_f1", f"{WITH_TX}, {_CLASSES} SELECT ROUND(macro_f1, 6) AS macro_f1 FROM f1")
def macro_f1(spark, sf):
    return E.macro_f1(transactions(spark, sf), "category_label", "pred").select(
        F.round("macro_f1", 6).alias("macro_f1"))


@query("class_scores", f"""{WITH_TX}, {_CLASSES}
SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM scores""")
def class_scores(spark, sf):
    return E.class_scores(E.pair_counts(transactions(spark, sf), "category_label", "pred")).drop("f1")


@query("confusion_matrix", f"""{WITH_TX}, {_CLASSES}
SELECT a.class AS truth, b.class AS pred, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN cells ON truth = a.class AND pred = b.class""")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(transactions(spark, sf), "category_label", "pred")


@query("confusion_quality_toxic", """
WITH c AS (SELECT DISTINCT v FROM (SELECT quality AS v FROM labels UNION ALL SELECT toxic FROM labels))
SELECT a.v AS truth, b.v AS pred, COUNT(doc_id) AS n
FROM c a CROSS JOIN c b LEFT JOIN labels ON quality = a.v AND toxic = b.v GROUP BY 1, 2""")
def confusion_quality_toxic(spark, sf):
    return E.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic")


@query("coverage_at", f"""{WITH_TX},
c AS (SELECT CAST(SUM(CASE WHEN conf >= 0.6 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS coverage FROM tx)
SELECT coverage, 1.0 - coverage AS fallback_rate FROM c""")
def coverage_at(spark, sf):
    return E.coverage_at(transactions(spark, sf), "conf", 0.6)


@query("eval_summary", f"""{WITH_TX}, {_CLASSES}
SELECT ROUND((SELECT macro_f1 FROM f1), 4) AS macro_f1,
  ROUND(AVG(CASE WHEN pred = category_label THEN 1.0 ELSE 0.0 END), 4) AS accuracy_top1,
  ROUND(AVG(CASE WHEN conf >= 0.6 THEN 1.0 ELSE 0.0 END), 4) AS coverage_at_tau,
  ROUND(1.0 - AVG(CASE WHEN conf >= 0.6 THEN 1.0 ELSE 0.0 END), 4) AS fallback_rate,
  CAST(0.6 AS DOUBLE) AS tau, string_agg(DISTINCT category_label, ',' ORDER BY category_label) AS classes
FROM tx""")
def eval_summary(spark, sf):
    out = E.eval_summary(transactions(spark, sf), "category_label", "pred", "conf", 0.6)
    rounded = [F.round(c, 4).alias(c) for c in ("macro_f1", "accuracy_top1", "coverage_at_tau", "fallback_rate")]
    return out.select(*rounded, "tau", F.array_join("classes", ",").alias("classes"))


@query("tau_sweep", f"""{_SWEEP}
SELECT tau, coverage, ROUND((SELECT macro_f1 FROM f1), 6) AS macro_f1 FROM sweep""")
def tau_sweep(spark, sf):
    return E.tau_sweep(transactions(spark, sf), "category_label", "pred", "conf").withColumn(
        "macro_f1", F.round("macro_f1", 6))


@query("recommend_tau", f"""{_SWEEP},
best AS (SELECT coalesce((SELECT MAX(tau) FROM sweep WHERE coverage >= 0.5),
  (SELECT tau FROM sweep ORDER BY coverage DESC, tau LIMIT 1)) AS tau)
SELECT tau, coverage FROM sweep WHERE tau = (SELECT tau FROM best)""")
def recommend_tau(spark, sf):
    sweep = E.tau_sweep(transactions(spark, sf), "category_label", "pred", "conf")
    return E.recommend_tau(sweep, target=0.5)


@query("recommend_tau_lowest", f"""{_SWEEP},
best AS (SELECT coalesce((SELECT MIN(tau) FROM sweep WHERE coverage >= 0.9),
  (SELECT tau FROM sweep ORDER BY coverage DESC, tau LIMIT 1)) AS tau)
SELECT tau, coverage FROM sweep WHERE tau = (SELECT tau FROM best)""")
def recommend_tau_lowest(spark, sf):
    sweep = E.tau_sweep(transactions(spark, sf), "category_label", "pred", "conf")
    return E.recommend_tau(sweep, target=0.9, pick="lowest")


@query("qualitative_sample", f"""{WITH_TX}
SELECT tx_id, raw_label, category_label, pred, conf FROM tx
ORDER BY md5(concat(CAST(tx_id AS VARCHAR), '|7')), tx_id LIMIT 12""")
def qualitative_sample(spark, sf):
    return E.qualitative_sample(transactions(spark, sf), "tx_id", "conf", 12, 7).select(
        "tx_id", "raw_label", "category_label", "pred", "conf")


_PERCENTILES = """ordered AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, COUNT(*) OVER () AS n FROM events),
pct AS (SELECT COUNT(*) AS count,
  MIN(CASE WHEN k = round_even(0.50 * (n - 1), 0) THEN value END) AS p50,
  MIN(CASE WHEN k = round_even(0.95 * (n - 1), 0) THEN value END) AS p95,
  MIN(CASE WHEN k = round_even(0.99 * (n - 1), 0) THEN value END) AS p99,
  MAX(value) AS max FROM ordered)"""


@query("percentile_summary", f"WITH {_PERCENTILES} SELECT * FROM pct")
def percentile_summary(spark, sf):
    return E.percentile_summary(table(spark, sf, "events"), "value")


@query("cumulative_histogram", """
WITH b AS (SELECT * FROM (VALUES (5),(10),(20),(40),(80),(160),(320),(640),(1280)) AS t(bound)),
s AS (SELECT CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total, COUNT(value) AS n FROM events)
SELECT concat(CAST(bound AS VARCHAR), '.0') AS le,
  (SELECT COUNT(*) FROM events WHERE value <= bound) AS count, total AS sum FROM b, s
UNION ALL SELECT '+Inf', n, total FROM s""")
def cumulative_histogram(spark, sf):
    return E.cumulative_histogram(table(spark, sf, "events"), "value")


@query("quality_gates", f"""{WITH_TX}, {_CLASSES}, {_PERCENTILES},
m AS (SELECT (SELECT macro_f1 FROM f1) AS macro_f1,
  (SELECT AVG(CASE WHEN conf >= 0.6 THEN 1.0 ELSE 0.0 END) FROM tx) AS coverage, (SELECT p95 FROM pct) AS p95)
SELECT macro_f1 >= 0.82 AS macro_f1_ok, coverage >= 0.9 AS coverage_ok, p95 <= 80 AS p95_ok,
  1.0 - coverage <= 0.15 AS fallback_rate_ok,
  macro_f1 >= 0.82 AND coverage >= 0.9 AND p95 <= 80 AND 1.0 - coverage <= 0.15 AS all_ok FROM m""")
def quality_gates(spark, sf):
    summary = E.eval_summary(transactions(spark, sf), "category_label", "pred", "conf", 0.6)
    p95 = E.percentile_summary(table(spark, sf, "events"), "value").select("p95").scalar()
    metrics = summary.select(
        "macro_f1", F.col("coverage_at_tau").alias("coverage"), "fallback_rate", p95.alias("p95"))
    return E.quality_gates(metrics).select(
        "macro_f1_ok", "coverage_ok", "p95_ok", "fallback_rate_ok", "all_ok")
