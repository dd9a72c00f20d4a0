"""Category rules."""

from pyspark.sql import functions as F

from sparktally.functions import text as T
from sparktally.operators import rules as R
from sparktally.plans import sqltext as S
from sparktally.plans.catalogue.text import PREPARED
from sparktally.plans.fixtures import WITH_TX, table, transactions
from sparktally.plans.registry import query

#: Rule outcome of every prepared transaction, as SQL.
RULED = f"""{PREPARED},
ruled AS (SELECT prepared.*, {S.mcc_category("mcc")} AS mcc_cat,
  {S.keyword_reason("normalized")} AS kw FROM prepared),
outcome AS (SELECT *, mcc_cat IS NOT NULL OR kw IS NOT NULL AS rule_hit,
  coalesce(mcc_cat, {S.keyword_category("kw")}) AS rule_category,
  CASE WHEN mcc_cat IS NOT NULL THEN concat('mcc:', CAST(mcc AS VARCHAR))
       WHEN kw IS NOT NULL THEN concat('keyword:', kw) ELSE '' END AS rule_reason
  FROM ruled)"""


@query("category_from_mcc", f"""{WITH_TX}
SELECT tx_id, {S.mcc_category("mcc")} AS category FROM tx""")
def category_from_mcc(spark, sf):
    return transactions(spark, sf).select("tx_id", R.category_from_mcc("mcc").alias("category"))


@query("keyword_category", f"""{RULED}
SELECT tx_id, {S.keyword_category("kw")} AS category, CASE WHEN kw IS NOT NULL THEN concat('keyword:', kw) END AS reason
FROM ruled""")
def keyword_category(spark, sf):
    tx = transactions(spark, sf).select("tx_id", T.normalize_label("raw_label").alias("normalized"))
    hits = tx.select("tx_id", R.keyword_category("normalized").alias("v"))
    return hits.select("tx_id", "v.category", "v.reason")


@query("pattern_category", f"""{PREPARED},
hit AS (SELECT tx_id, CASE
  WHEN regexp_matches(normalized, '\\bfacture\\b') AND regexp_matches(normalized, 'edf|engie|orange|sfr|free')
    THEN 'pattern:facture+operator'
  WHEN regexp_matches(normalized, '\\b(salaire|payroll)\\b') THEN 'pattern:salaire'
  WHEN regexp_matches(normalized, '\\bloyer\\b') THEN 'pattern:loyer' END AS reason FROM prepared)
SELECT tx_id, reason, CASE reason WHEN 'pattern:salaire' THEN 'Salary' WHEN 'pattern:loyer' THEN 'Rent'
  WHEN 'pattern:facture+operator' THEN 'Utilities' END AS category FROM hit""")
def pattern_category(spark, sf):
    tx = transactions(spark, sf).select("tx_id", T.normalize_label("raw_label").alias("normalized"))
    hits = tx.select("tx_id", R.pattern_category("normalized").alias("v"))
    return hits.select("tx_id", "v.reason", "v.category")


@query("apply_rules", f"{RULED} SELECT tx_id, rule_hit, rule_category, rule_reason FROM outcome")
def apply_rules(spark, sf):
    ruled = R.apply_rules(T.preprocess(transactions(spark, sf)))
    return ruled.select("tx_id", "rule_hit", "rule_category", "rule_reason")


@query("rule_category_totals", f"""{RULED}
SELECT coalesce(rule_category, '') AS category, operation_type, COUNT(*) AS n,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM outcome GROUP BY 1, 2""")
def rule_category_totals(spark, sf):
    ruled = R.apply_rules(T.preprocess(transactions(spark, sf)))
    return ruled.groupBy(F.coalesce("rule_category", F.lit("")).alias("category"), "operation_type").agg(
        F.count("*").alias("n"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


#: One keyword per part, a piece of its number; texts that hold several of them.
_LARGE_RULES = """
WITH rules AS (SELECT p_partkey AS priority, CAST(p_partkey * 7 % 100003 AS VARCHAR) AS keyword, p_brand AS category FROM part),
texts AS (SELECT o_orderkey AS tx_id, concat('n', CAST(o_orderkey * 13 % 1000003 AS VARCHAR), ' c', CAST(o_custkey AS VARCHAR)) AS t FROM orders)"""


@query("keyword_category_large", f"""{_LARGE_RULES}
SELECT tx_id, r.category AS kw_category, CASE WHEN r.keyword IS NOT NULL THEN concat('keyword:', r.keyword) END AS kw_reason
FROM texts LEFT JOIN (SELECT t, min(priority) AS priority FROM (SELECT DISTINCT t FROM texts) JOIN rules ON contains(t, keyword) GROUP BY t) b USING (t)
LEFT JOIN rules r ON r.priority = b.priority""")
def keyword_category_large(spark, sf):
    """As many keywords as there are parts, which no list of literals could hold."""
    rules = table(spark, sf, "part").select(
        F.col("p_partkey").alias("priority"), (F.col("p_partkey") * 7 % 100003).cast("string").alias("keyword"), F.col("p_brand").alias("category"))
    texts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tx_id"), F.concat(
        F.lit("n"), (F.col("o_orderkey") * 13 % 1000003).cast("string"), F.lit(" c"), F.col("o_custkey").cast("string")).alias("t"))
    return R.keyword_category_table(texts, rules, "t").drop("t")
