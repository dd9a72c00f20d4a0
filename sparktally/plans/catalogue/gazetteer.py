"""Merchant resolution."""

from pyspark.sql import functions as F

from sparktally.functions import similarity
from sparktally.functions import text as T
from sparktally.operators import gazetteer as G
from sparktally.plans import sqltext as S
from sparktally.plans.catalogue.text import PREPARED
from sparktally.plans.fixtures import WITH_TX, gazetteer, table, transactions
from sparktally.plans.registry import query

#: Token set score of every distinct merchant text and alias, as SQL.
TOKEN_SET = f"""{WITH_TX},
queried AS (SELECT tx_id, merchant_label, {S.merchant_text("raw_label")} AS q FROM tx),
aliases AS (SELECT alias_idx, merchant_id, display_name, {S.merchant_text("alias")} AS a FROM gaz),
token_pairs AS (SELECT q, alias_idx, a FROM (SELECT DISTINCT q FROM queried), aliases),
{S.token_set_steps("token_pairs", "q", "a", "q, alias_idx")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, alias_idx) AS rank FROM token_set),
top AS (SELECT ranked.q, rank, merchant_id, display_name, a AS alias_norm, CAST(trunc(score) AS BIGINT) AS score
  FROM ranked JOIN aliases ON ranked.alias_idx = aliases.alias_idx WHERE rank <= 5),
best AS (SELECT tx_id, merchant_label, merchant_id, display_name, alias_norm, score
  FROM queried LEFT JOIN (SELECT * FROM top WHERE rank = 1 AND score >= 86) t ON queried.q = t.q)"""


@query("merchant_candidates", f"""{TOKEN_SET}
SELECT tx_id, rank, merchant_id, display_name, alias_norm, score FROM queried JOIN top ON queried.q = top.q""")
def merchant_candidates(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "raw_label")
    return G.merchant_candidates(tx, gazetteer(spark), k=5).drop("raw_label")


@query("best_merchant", f"{TOKEN_SET} SELECT tx_id, merchant_id, display_name, alias_norm, score FROM best")
def best_merchant(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "raw_label")
    return G.best_merchant(tx, gazetteer(spark)).drop("raw_label")


@query("best_merchant_blocked", f"{TOKEN_SET} SELECT tx_id, merchant_id, display_name, alias_norm, score FROM best")
def best_merchant_blocked(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "raw_label")
    return G.best_merchant(tx, gazetteer(spark), max_shipped=0).drop("raw_label")


@query("normalize_merchant", f"{TOKEN_SET} SELECT tx_id, display_name, merchant_id, score FROM best")
def normalize_merchant(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "raw_label")
    return G.normalize_merchant(tx, gazetteer(spark)).drop("raw_label")


@query("merchant_accuracy", f"""{TOKEN_SET}
SELECT AVG(CASE WHEN merchant_id = merchant_label THEN 1.0 ELSE 0.0 END) AS accuracy,
  COUNT(*) FILTER (WHERE merchant_id = merchant_label) AS correct, COUNT(*) AS total FROM best""")
def merchant_accuracy(spark, sf):
    pairs = transactions(spark, sf).select("raw_label", F.col("merchant_label").alias("merchant_id"))
    return G.merchant_accuracy(pairs, gazetteer(spark))


#: A gazetteer of one shop per part: beyond the shipping bound at scale factor 0.1 and more.
#: The label of a shop holds all tokens of its alias and of no other; every seventh names none.
_SHOPS = """
WITH shops AS (SELECT p_partkey AS tx_id, concat(p_name, ' shop', CAST(p_partkey AS VARCHAR)) AS alias, p_brand, p_type FROM part)
SELECT tx_id, CASE WHEN tx_id % 7 <> 0 THEN p_brand END AS merchant_id, CASE WHEN tx_id % 7 <> 0 THEN p_type END AS display_name,
  CASE WHEN tx_id % 7 <> 0 THEN alias END AS {alias}, CASE WHEN tx_id % 7 <> 0 THEN {score} END AS score FROM shops"""


def _shops(spark, sf):
    shop = F.concat(F.col("p_name"), F.lit(" shop"), F.col("p_partkey").cast("string"))
    parts = table(spark, sf, "part")
    gaz = parts.select(F.col("p_partkey").alias("alias_idx"), shop.alias("alias"), F.col("p_brand").alias("merchant_id"),
                       F.col("p_type").alias("display_name"))
    label = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("CB "), F.upper(shop), F.lit(" PARIS"))).otherwise("?? ZXQ 9")
    return parts.select(F.col("p_partkey").alias("tx_id"), label.alias("raw_label")), gaz


@query("best_merchant_of_parts", _SHOPS.format(alias="alias_norm", score="CAST(100 AS BIGINT)"))
def best_merchant_of_parts(spark, sf):
    return G.best_merchant(*_shops(spark, sf), threshold=86, max_shipped=0).drop("raw_label")


@query("best_merchant_of_parts_low", _SHOPS.format(alias="alias_norm", score="CAST(100 AS BIGINT)"))
def best_merchant_of_parts_low(spark, sf):
    return G.best_merchant(*_shops(spark, sf), threshold=70, max_shipped=0).drop("raw_label")


_RESOLVED_SHOPS = """
SELECT p_partkey AS tx_id, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS gaz_merchant_id,
  CASE WHEN p_partkey % 7 <> 0 THEN 1.0::DOUBLE END AS gaz_score FROM part"""


def _resolved_shops(spark, sf, cut):
    labels, gaz = _shops(spark, sf)
    text = F.when(F.col("raw_label").startswith("CB "), F.expr("lower(substring(raw_label, 4, length(raw_label) - 9))")).otherwise("zxq")
    found = G.resolve_merchant(labels.withColumn("normalized", text), gaz, cut=cut, max_shipped=0)
    return found.select("tx_id", "gaz_merchant_id", "gaz_score")


@query("resolve_merchant_of_parts", _RESOLVED_SHOPS)
def resolve_merchant_of_parts(spark, sf):
    return _resolved_shops(spark, sf, 0.90)


@query("resolve_merchant_of_parts_low", _RESOLVED_SHOPS)
def resolve_merchant_of_parts_low(spark, sf):
    return _resolved_shops(spark, sf, 0.80)


#: Accepted alias of every distinct normalized label at the cut 0.90, as SQL.
RESOLVED = f"""wr_texts AS (SELECT DISTINCT normalized AS t FROM prepared),
wr_pairs AS (SELECT t, alias_idx, trim(lower(alias)) AS a, CAST(greatest(length(t), length(trim(alias))) AS DOUBLE)
  / nullif(least(length(t), length(trim(alias))), 0) AS q FROM wr_texts, gaz),
wr_near AS (SELECT t, alias_idx, a, array_to_string(list_sort(string_split(t, ' ')), ' ') AS ts,
  array_to_string(list_sort(string_split(a, ' ')), ' ') AS as_ FROM wr_pairs WHERE q < 1.5),
{S.token_set_steps("wr_near", "t", "a", "t, alias_idx", "wr_set")},
wr_scores AS (
  SELECT t, alias_idx, CAST(90 AS DOUBLE) AS score FROM wr_pairs
  WHERE q >= 1.5 AND q <= 8 AND (contains(t, a) OR contains(a, t))
  UNION ALL
  SELECT n.t, n.alias_idx, greatest({S.ratio("n.t", "n.a")}, 0.95::DOUBLE * {S.ratio("n.ts", "n.as_")}, 0.95::DOUBLE * s.score)
  FROM wr_near n JOIN wr_set s ON n.t = s.t AND n.alias_idx = s.alias_idx),
wr_best AS (SELECT t, arg_max(alias_idx, score * 1000000 - alias_idx) AS alias_idx, max(score) / 100 AS score
  FROM wr_scores WHERE score / 100 >= 0.9::DOUBLE GROUP BY t),
resolved AS (SELECT b.t, b.score AS gaz_score, g.merchant_id AS gaz_merchant_id, g.display_name AS gaz_display,
  concat('alias:', trim(lower(g.alias)), '|score:', printf('%.2f', b.score)) AS gaz_reason
  FROM wr_best b JOIN gaz g ON b.alias_idx = g.alias_idx)"""

_RESOLVE_SQL = f"""{PREPARED}, {RESOLVED}
SELECT tx_id, gaz_merchant_id, gaz_display, gaz_score, gaz_reason
FROM prepared LEFT JOIN resolved ON normalized = t"""
_RESOLVE_COLUMNS = ["tx_id", "gaz_merchant_id", "gaz_display", "gaz_score", "gaz_reason"]


def _normalized(spark, sf):
    return transactions(spark, sf).select("tx_id", T.normalize_label("raw_label").alias("normalized"))


@query("resolve_merchant", _RESOLVE_SQL)
def resolve_merchant(spark, sf):
    return G.resolve_merchant(_normalized(spark, sf), gazetteer(spark)).select(*_RESOLVE_COLUMNS)


@query("resolve_merchant_blocked", _RESOLVE_SQL)
def resolve_merchant_blocked(spark, sf):
    return G.resolve_merchant(_normalized(spark, sf), gazetteer(spark), max_shipped=0).select(*_RESOLVE_COLUMNS)


#: Weighted ratio of every distinct normalized label and alias, best first, as SQL.
EXPLAINED = f"""ex_texts AS (SELECT DISTINCT normalized AS t FROM prepared),
ex_pairs AS (SELECT t, alias_idx, trim(lower(alias)) AS a, list_sort(string_split(t, ' ')) AS tt,
  list_sort(string_split(trim(lower(alias)), ' ')) AS ta FROM ex_texts, gaz),
ex_all AS (SELECT *, CAST(greatest(length(t), length(a)) AS DOUBLE) / nullif(least(length(t), length(a)), 0) AS q,
  array_to_string(tt, ' ') AS ts, array_to_string(ta, ' ') AS as_,
  array_to_string(list_sort(list_distinct(tt)), ' ') AS dt, array_to_string(list_sort(list_distinct(ta)), ' ') AS da,
  len(list_intersect(tt, ta)) > 0 AS sharing FROM ex_pairs WHERE t <> '' AND a <> ''),
ex_near AS (SELECT * FROM ex_all WHERE q < 1.5),
ex_far AS (SELECT * FROM ex_all WHERE q >= 1.5),
{S.token_set_steps("ex_near", "t", "a", "t, alias_idx", "ex_set")},
{S.partial_steps("ex_far", "t, alias_idx", "t", "a", "ex_plain")},
{S.partial_steps("ex_far", "t, alias_idx", "ts", "as_", "ex_sorted")},
{S.partial_steps("ex_far", "t, alias_idx", "dt", "da", "ex_distinct")},
ex_scores AS (
  SELECT t, alias_idx, 0::DOUBLE AS score FROM ex_pairs WHERE t = '' OR a = ''
  UNION ALL SELECT n.t, n.alias_idx, greatest({S.ratio("n.t", "n.a")}, 0.95::DOUBLE * greatest({S.ratio("n.ts", "n.as_")}, s.score))
  FROM ex_near n JOIN ex_set s ON n.t = s.t AND n.alias_idx = s.alias_idx
  UNION ALL SELECT f.t, f.alias_idx, greatest({S.ratio("f.t", "f.a")}, p.score * CASE WHEN q <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END,
    CASE WHEN sharing THEN 100::DOUBLE ELSE greatest(o.score, d.score) END * 0.95::DOUBLE * CASE WHEN q <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END)
  FROM ex_far f JOIN ex_plain p ON f.t = p.t AND f.alias_idx = p.alias_idx JOIN ex_sorted o ON f.t = o.t AND f.alias_idx = o.alias_idx
  JOIN ex_distinct d ON f.t = d.t AND f.alias_idx = d.alias_idx),
ex_ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, alias_idx) AS r FROM ex_scores),
explained AS (SELECT e.t, score / 100 AS gaz_score, trim(lower(alias)) AS alias, merchant_id, display_name
  FROM ex_ranked e JOIN gaz ON e.alias_idx = gaz.alias_idx WHERE r = 1)"""


@query("resolve_merchant_explained", f"""{PREPARED}, {EXPLAINED}
SELECT tx_id, CASE WHEN gaz_score >= 0.9::DOUBLE THEN merchant_id END AS gaz_merchant_id,
  CASE WHEN gaz_score >= 0.9::DOUBLE THEN display_name END AS gaz_display, ROUND(gaz_score, 9) AS gaz_score,
  concat(CASE WHEN gaz_score >= 0.9::DOUBLE THEN 'alias:' ELSE 'weak-alias:' END, alias, '|score:', printf('%.2f', gaz_score)) AS gaz_reason
FROM prepared JOIN explained ON normalized = t""")
def resolve_merchant_explained(spark, sf):
    resolved = G.resolve_merchant(_normalized(spark, sf), gazetteer(spark), explain_weak=True)
    return resolved.withColumn("gaz_score", F.round("gaz_score", 9)).select(*_RESOLVE_COLUMNS)


@query("score_pairs", f"""{PREPARED},
sp_texts AS (SELECT DISTINCT normalized AS t, merchant_label AS m FROM prepared WHERE normalized <> '' AND merchant_label <> ''),
sp_sorted AS (SELECT t, m, array_to_string(list_sort(string_split(t, ' ')), ' ') AS ts,
  array_to_string(list_sort(string_split(m, ' ')), ' ') AS ms FROM sp_texts),
{S.token_set_steps("sp_texts", "t", "m", "t, m")}
SELECT s.t AS label, s.m AS alias, ROUND({S.ratio("s.t", "s.m")}, 9) AS ratio,
  ROUND({S.ratio("s.ts", "s.ms")}, 9) AS token_sort, ROUND(score, 9) AS token_set
FROM sp_sorted s JOIN token_set k ON s.t = k.t AND s.m = k.m""")
def score_pairs(spark, sf):
    pairs = transactions(spark, sf).select(
        T.normalize_label("raw_label").alias("label"), F.col("merchant_label").alias("alias")
    ).where("label <> '' AND alias <> ''").distinct()
    names = ["ratio", "token_sort", "token_set"]
    return similarity.score_pairs(pairs, "label", "alias", names).select(
        "label", "alias", *[F.round(n, 9).alias(n) for n in names])
