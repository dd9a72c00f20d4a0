"""Readers and writers: what is written to the shared folder must come back whole."""

from pyspark.sql import functions as F

from sparktally.operators import drift as D
from sparktally.operators import evaluate as E
from sparktally.plans.catalogue.drift import _SUMMARY, flat_summary, prepared, train
from sparktally.plans.catalogue.evaluation import _CLASSES
from sparktally.plans.fixtures import WITH_TX, table, transactions
from sparktally.plans.registry import query
from sparktally.session import scratch_path
from sparktally.sources import gazetteers as G
from sparktally.sources import tables as R


@query("read_transactions", f"""{WITH_TX}
SELECT CAST(tx_id AS VARCHAR) AS tx_id, CAST(tx_date AS VARCHAR) AS date, amount, currency, raw_label, channel, mcc, category_label,
  merchant_label FROM tx""")
def read_transactions(spark, sf):
    path = scratch_path(spark, "transactions")
    R.write_csv(transactions(spark, sf).withColumnRenamed("tx_date", "date").drop("split", "pred", "conf"), path)
    back = R.read_transactions(spark, path, required=("raw_label", "category_label"))
    # an empty text and a missing one are the same in CSV
    for name in ("raw_label", "merchant_label"):
        back = back.withColumn(name, F.coalesce(name, F.lit("")))
    return back.withColumn("date", F.col("date").cast("string"))


def _customer_gazetteer(spark, sf):
    """One alias per customer; every tenth consists of signs only, some repeat."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("alias_idx"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("***"))
        .otherwise(F.concat(F.lit(" "), F.upper("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit(" "))).alias("alias"),
        F.concat(F.lit("m"), (F.col("c_custkey") % 50).cast("string")).alias("merchant_id"),
        F.col("c_name").alias("display_name"))


@query("read_gazetteer", """
SELECT c_custkey AS alias_idx, concat(' ', upper(c_name), ' ', c_mktsegment, ' ') AS alias,
  concat('m', CAST(c_custkey % 50 AS VARCHAR)) AS merchant_id, c_name AS display_name FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, '***', concat('m', CAST(c_custkey % 50 AS VARCHAR)), c_name FROM customer WHERE c_custkey % 10 = 0""")
def read_gazetteer(spark, sf):
    path = scratch_path(spark, "gazetteer")
    R.write_csv(_customer_gazetteer(spark, sf), path)
    return G.read_gazetteer(spark, path)


@query("read_gazetteer_unnumbered", """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS alias_idx, concat(upper(c_name), ' ', c_mktsegment) AS alias,
  concat('m', CAST(c_custkey % 50 AS VARCHAR)) AS merchant_id, c_name AS display_name FROM customer""")
def read_gazetteer_unnumbered(spark, sf):
    """The three columns of a curated file: lines are numbered in order."""
    path = scratch_path(spark, "gazetteer")
    ordered = table(spark, sf, "customer").orderBy("c_custkey")
    R.write_csv(ordered.select(
        F.concat(F.upper("c_name"), F.lit(" "), F.col("c_mktsegment")).alias("alias"),
        F.concat(F.lit("m"), (F.col("c_custkey") % 50).cast("string")).alias("merchant_id"),
        F.col("c_name").alias("display_name")), path)
    return G.read_gazetteer(spark, path)


@query("build_gazetteer", """
WITH p AS (SELECT p_partkey AS alias_idx, trim(lower(concat('  ', upper(p_name), ' '))) AS alias, p_brand, p_type FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY alias_idx) AS k FROM p)
SELECT alias_idx, alias, p_brand AS merchant_id, p_type AS display_name FROM r WHERE k = 1""")
def build_gazetteer(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("alias_idx"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("alias"),
        F.col("p_brand").alias("merchant_id"), F.col("p_type").alias("display_name"))
    path = scratch_path(spark, "gazetteer-table")
    G.write_gazetteer(G.build_gazetteer(parts), path)
    return spark.read.parquet(path)


@query("derive_aliases", """
WITH t AS (
  SELECT c_custkey AS o, c_name AS m, concat('CB ', upper(c_name), ' {city_code}  {city}') AS template FROM customer
  UNION ALL SELECT c_custkey, c_name, concat('PRLV ', c_mktsegment, ' ', upper(c_name), ' {month}/{year}') FROM customer),
a AS (SELECT DISTINCT o, m, alias FROM (
  SELECT o, m, trim(regexp_replace(lower(trim(replace(replace(replace(replace(replace(replace(replace(
    template, 'CB ', ''), 'PRLV ', ''), 'VIR ', ''), '{city}', ''), '{city_code}', ''), '{month}', ''), '{year}', ''))), '\\s+', ' ', 'g')) AS alias FROM t
  UNION ALL SELECT o, m, replace(lower(m), '''', '') FROM t))
SELECT o * 1048576 + row_number() OVER (PARTITION BY o, m ORDER BY alias) - 1 AS alias_idx, alias,
  replace(lower(m), '''', '') AS merchant_id, m AS display_name FROM a WHERE alias <> ''""")
def derive_aliases(spark, sf):
    customers = table(spark, sf, "customer")
    templates = customers.select(
        F.col("c_custkey").alias("merchant_order"), F.col("c_name").alias("merchant"), F.explode(F.array(
            F.concat(F.lit("CB "), F.upper("c_name"), F.lit(" {city_code}  {city}")),
            F.concat(F.lit("PRLV "), F.col("c_mktsegment"), F.lit(" "), F.upper("c_name"), F.lit(" {month}/{year}")),
        )).alias("template"))
    return G.derive_aliases(templates)


@query("taxonomy", """
WITH d AS (SELECT DISTINCT c_mktsegment AS category, n_name AS merchant FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT category, concat('["', string_agg(merchant, '","' ORDER BY merchant), '"]') AS merchants FROM d GROUP BY 1""")
def taxonomy(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = table(spark, sf, "customer").join(nation, "c_nationkey")
    return G.taxonomy(named, "c_mktsegment", "n_name")


@query("read_eval_pairs", f"{WITH_TX} SELECT raw_label, merchant_label AS merchant_id FROM tx")
def read_eval_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    pairs = transactions(spark, sf).select("raw_label", F.col("merchant_label").alias("merchant_id"))
    R.write_csv(pairs, path)
    # an empty text and a missing one are the same in CSV
    return R.read_eval_pairs(spark, path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("raw_label", "merchant_id")])


def _requests(spark, sf):
    """One document per transaction: the transaction and one without its label; some documents lack the list."""
    tx = F.struct(
        F.col("tx_id").cast("string").alias("tx_id"), "amount", "currency",
        F.concat(F.lit("x"), F.col("raw_label")).alias("raw_label"), "channel", "mcc")
    broken = F.struct(F.concat(F.lit("bad-"), F.col("tx_id").cast("string")).alias("tx_id"), F.col("currency"))
    body = F.when(F.col("tx_id") % 100 == 1, F.lit('{"foo": "bar"}')).otherwise(F.concat(
        F.lit('{"transactions": ['), F.to_json(tx), F.lit(","), F.to_json(broken), F.lit("]}")))
    return transactions(spark, sf).select(F.col("tx_id").alias("request_id"), body.alias("body"))


@query("explode_requests", f"""{WITH_TX}
SELECT tx_id AS request_id, CAST(tx_id AS VARCHAR) AS tx_id, amount, currency, concat('x', raw_label) AS raw_label, channel, mcc
FROM tx WHERE tx_id % 100 <> 1""")
def explode_requests(spark, sf):
    valid, _ = R.explode_requests(_requests(spark, sf))
    return valid.drop("date")


@query("explode_requests_invalid", f"""{WITH_TX}
SELECT tx_id AS request_id, CASE WHEN tx_id % 100 = 1 THEN 'transactions' ELSE 'raw_label' END AS missing FROM tx""")
def explode_requests_invalid(spark, sf):
    _, invalid = R.explode_requests(_requests(spark, sf))
    return invalid.drop("body")


@query("write_summary", f"""{WITH_TX}, {_CLASSES}
SELECT ROUND((SELECT macro_f1 FROM f1), 4) AS macro_f1,
  ROUND(AVG(CASE WHEN pred = category_label THEN 1.0 ELSE 0.0 END), 4) AS accuracy_top1, CAST(0.6 AS DOUBLE) AS tau FROM tx""")
def write_summary(spark, sf):
    path = scratch_path(spark, "eval-summary")
    summary = E.eval_summary(transactions(spark, sf), "category_label", "pred", "conf", 0.6)
    R.write_summary(summary.select(
        F.round("macro_f1", 4).alias("macro_f1"), F.round("accuracy_top1", 4).alias("accuracy_top1"), "tau"), path)
    return spark.read.schema("macro_f1 double, accuracy_top1 double, tau double").json(path)


@query("read_drift_summary", f"""{_SUMMARY}
SELECT 'ok' AS status, ROUND(psi, 4) AS psi_topk, ROUND(oov_rate, 4) AS oov_rate, ROUND(ks_stat, 4) AS ks_confidence_stat,
  class AS shift_class, ROUND(train, 4) AS shift_train, ROUND(prod, 4) AS shift_prod, ROUND(abs_delta, 4) AS shift_abs_delta,
  psi > 0.2 AS psi_alert, abs_delta > 0.15 AS shift_alert, psi > 0.2 OR abs_delta > 0.15 AS alert FROM psi, oov, ks, shift""")
def read_drift_summary(spark, sf):
    path = scratch_path(spark, "drift-summary")
    R.write_summary(D.drift_summary(prepared(spark, sf), train(), conf="conf"), path)
    report = R.read_drift_summary(spark, path)
    return flat_summary(report).withColumn("status", report.select("status").scalar())


@query("read_drift_summary_missing", """
SELECT 'no_report' AS status, CAST(NULL AS DOUBLE) AS psi_topk, FALSE AS alert, COUNT(*) AS transactions FROM orders""")
def read_drift_summary_missing(spark, sf):
    report = R.read_drift_summary(spark, scratch_path(spark, "no-summary"))
    n = transactions(spark, sf).agg(F.count(F.lit(1))).scalar()
    return report.select("status", "psi_topk", "alert", n.alias("transactions"))


@query("read_time_log", """
SELECT CAST(ts AS DATE) AS date, CAST(floor(value) AS BIGINT) AS minutes FROM events WHERE event_id % 10 <> 0""")
def read_time_log(spark, sf):
    path = scratch_path(spark, "time-log")
    minutes = F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.floor("value").cast("string"))
    R.write_csv(table(spark, sf, "events").select(F.to_date("ts").alias("date"), minutes.alias("minutes")), path)
    return R.read_time_log(spark, path)
