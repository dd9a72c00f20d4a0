"""Fallback scorer, router and its aggregates."""

from pyspark.sql import functions as F

from sparktally import constants as K
from sparktally.functions import text as T
from sparktally.operators import classify as C
from sparktally.operators import fallback as B
from sparktally.plans import sqltext as S
from sparktally.plans.catalogue.gazetteer import RESOLVED
from sparktally.plans.catalogue.rules import RULED
from sparktally.plans.catalogue.text import PREPARED
from sparktally.plans.fixtures import gazetteer, transactions
from sparktally.plans.registry import query

_LABELS = K.CATEGORIES
_LABEL_ROWS = ", ".join(f"({i}, '{c}', {S.words(K.CATEGORY_HINTS[c])})" for i, c in enumerate(_LABELS))
_TERM_ROWS = ", ".join(
    f"({i}, '{term}')" for i, c in enumerate(_LABELS) for term in [c.lower(), *K.CATEGORY_HINTS[c]])


def _verdict_sql(fuzzy_cte: str) -> str:
    """CTEs ending in ``verdicts``: one row per distinct text t."""
    return f"""fb_labels AS (SELECT * FROM (VALUES {_LABEL_ROWS}) AS l(pos, label, hints)),
fb_texts AS (SELECT DISTINCT normalized AS t FROM prepared),
{fuzzy_cte},
fb_hits AS (SELECT t, pos, label, len(list_intersect(hints, regexp_extract_all(t, '[a-z0-9]+'))) AS hit FROM fb_texts, fb_labels),
fb_scores AS (SELECT h.t, h.pos, label, hit, fuzzy, 0.6::DOUBLE * least(1::DOUBLE, hit / 2::DOUBLE) + fuzzy AS s
  FROM fb_hits h JOIN fb_fuzzy f ON h.t = f.t AND h.pos = f.pos),
fb_exp AS (SELECT *, exp((s - max(s) OVER (PARTITION BY t)) / 0.3::DOUBLE) AS e FROM fb_scores),
fb_prob AS (SELECT *, e / sum(e) OVER (PARTITION BY t) AS p, row_number() OVER (PARTITION BY t ORDER BY s DESC, pos) AS r FROM fb_exp),
verdicts AS (SELECT t, label AS fb_category, p AS fb_confidence,
  concat('kw_hits=', hit, ', fuzzy=', printf('%.3f', fuzzy)) AS fb_reason FROM fb_prob WHERE r = 1)"""


#: 0.05 where the label name is contained.
_CONTAINS = "fb_fuzzy AS (SELECT t, pos, CASE WHEN contains(t, lower(label)) THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS fuzzy FROM fb_texts, fb_labels)"

#: Best partial ratio of the label name and its hints.
_SIMILARITY = f"""fb_terms AS (SELECT DISTINCT term FROM (VALUES {_TERM_ROWS}) AS x(pos, term)),
fb_pairs AS (SELECT t, term FROM fb_texts, fb_terms),
{S.partial_steps("fb_pairs", "t, term", "t", "term", "fb_partial")},
fb_fuzzy AS (SELECT a.t, x.pos, 0.01::DOUBLE * coalesce(max(score), 0) AS fuzzy
  FROM fb_texts a CROSS JOIN (VALUES {_TERM_ROWS}) AS x(pos, term)
  LEFT JOIN fb_partial f ON f.t = a.t AND f.term = x.term GROUP BY 1, 2)"""


def _normalized(spark, sf):
    return transactions(spark, sf).select("tx_id", T.normalize_label("raw_label").alias("normalized"))


def _shown(df):
    return df.select("tx_id", "fb_category", F.round("fb_confidence", 6).alias("fb_confidence"), "fb_reason")


@query("fallback_score", f"""{PREPARED}, {_verdict_sql(_SIMILARITY)}
SELECT tx_id, fb_category, ROUND(fb_confidence, 6) AS fb_confidence, fb_reason FROM prepared JOIN verdicts ON normalized = t""")
def fallback_score(spark, sf):
    return _shown(B.fallback_score(_normalized(spark, sf), _LABELS))


@query("fallback_score_contains", f"""{PREPARED}, {_verdict_sql(_CONTAINS)}
SELECT tx_id, fb_category, ROUND(fb_confidence, 6) AS fb_confidence, fb_reason FROM prepared JOIN verdicts ON normalized = t""")
def fallback_score_contains(spark, sf):
    return _shown(B.fallback_score(_normalized(spark, sf), _LABELS, fuzzy="contains"))


_KNOWN = ["Groceries", "Rent", "Salary"]


@query("validate_verdict", f"""{PREPARED}
SELECT tx_id, CASE WHEN pred IN ('Groceries', 'Rent', 'Salary') THEN pred ELSE 'Groceries' END AS fb_category,
  greatest(0::DOUBLE, least(1::DOUBLE, conf * 1.5 - 0.2)) AS fb_confidence,
  CASE WHEN pred IN ('Groceries', 'Rent', 'Salary') THEN 'given' ELSE 'given | coerced-to-valid' END AS fb_reason FROM prepared""")
def validate_verdict(spark, sf):
    given = transactions(spark, sf).select(
        "tx_id", F.col("pred").alias("fb_category"), (F.col("conf") * 1.5 - 0.2).alias("fb_confidence"),
        F.lit("given").alias("fb_reason"))
    return B.validate_verdict(given, _KNOWN)


@query("fallback", f"""{PREPARED}, {_verdict_sql(_CONTAINS)}
SELECT tx_id,
  CASE WHEN conf >= 0.5 THEN pred ELSE fb_category END AS fb_category,
  ROUND(CASE WHEN conf >= 0.5 THEN conf ELSE fb_confidence END, 6) AS fb_confidence,
  CASE WHEN conf >= 0.5 THEN 'scorer' ELSE concat('fallback-stub (no verdict) | ', fb_reason) END AS fb_reason
FROM prepared JOIN verdicts ON normalized = t""")
def fallback(spark, sf):
    tx = transactions(spark, sf).select(
        "tx_id", "pred", "conf", T.normalize_label("raw_label").alias("normalized"))

    def scorer(df):
        sure = F.col("conf") >= 0.5
        return df.withColumns({
            "scorer_category": F.when(sure, F.col("pred")),
            "scorer_confidence": F.when(sure, F.col("conf")),
            "scorer_reason": F.when(sure, F.lit("scorer")),
        })

    return _shown(B.fallback(tx, _LABELS, scorer, fuzzy="contains"))


_EXPLAINED = "CASE WHEN gaz_reason IS NOT NULL THEN concat('gazetteer:', gaz_reason) END"

#: Router output without a model, with and without labels, as SQL.
def _no_model(category: str, confidence: str, reason: str, extra: str = "", join: str = "") -> str:
    return f"""{RULED}, {RESOLVED}{extra},
routed AS (SELECT tx_id, operation_type, gaz_display AS normalized_merchant,
  CASE WHEN rule_hit THEN rule_category ELSE {category} END AS budget_category,
  CASE WHEN rule_hit THEN 0.8::DOUBLE ELSE {confidence} END AS confidence,
  CASE WHEN rule_hit THEN concat_ws(' | ', concat('rules:', rule_reason), {_EXPLAINED})
       ELSE concat_ws(' | ', {_EXPLAINED}, 'model:unavailable', concat('llm:', {reason})) END AS explanation,
  CASE WHEN rule_hit AND gaz_display IS NOT NULL THEN 'rules>gazetteer' WHEN rule_hit THEN 'rules' ELSE 'model>llm' END AS router
  FROM outcome LEFT JOIN resolved ON normalized = resolved.t {join})"""


_CLASSIFY = _no_model("''", "0::DOUBLE", "'no-labels'")
_CLASSIFY_LABELS = _no_model(
    "fb_category", "ROUND(fb_confidence, 4)", "fb_reason", f", {_verdict_sql(_SIMILARITY)}",
    "LEFT JOIN verdicts v ON normalized = v.t")


def classified(spark, sf, **options):
    return C.classify(transactions(spark, sf), gazetteer(spark), **options)


@query("classify", f"{_CLASSIFY} SELECT * FROM routed")
def classify(spark, sf):
    return classified(spark, sf)


@query("classify_with_labels", f"{_CLASSIFY_LABELS} SELECT * FROM routed")
def classify_with_labels(spark, sf):
    return classified(spark, sf, labels=_LABELS)


def stand_in_model(df):
    """Deterministic columns in place of a trained model, so that routing can be compared."""
    return df.withColumns({
        "model_category": F.col("pred"), "model_pmax": F.col("conf"),
        "model_oov": (F.col("tx_id") % 9).cast("double") / 10,
    })


@query("classify_with_model", f"""{RULED}, {RESOLVED}, {_verdict_sql(_CONTAINS)},
m AS (SELECT *, conf >= 0.6 AND (tx_id % 9)::DOUBLE / 10 <= 0.55::DOUBLE AS ok,
  CASE WHEN gaz_display IS NOT NULL THEN 'gazetteer>model' ELSE 'model' END AS route,
  concat('model:pmax=', printf('%.3f', conf), ' | oov=', printf('%.2f', (tx_id % 9)::DOUBLE / 10)) AS part
  FROM outcome LEFT JOIN resolved ON normalized = resolved.t LEFT JOIN verdicts v ON normalized = v.t)
SELECT tx_id, operation_type, gaz_display AS normalized_merchant,
  CASE WHEN rule_hit THEN rule_category WHEN ok THEN pred ELSE fb_category END AS budget_category,
  CASE WHEN rule_hit THEN 0.8::DOUBLE WHEN ok THEN conf ELSE ROUND(greatest(conf, fb_confidence), 4) END AS confidence,
  CASE WHEN rule_hit THEN concat_ws(' | ', concat('rules:', rule_reason), {_EXPLAINED})
       WHEN ok THEN concat_ws(' | ', {_EXPLAINED}, part)
       ELSE concat_ws(' | ', {_EXPLAINED}, part, concat('llm:', fb_reason)) END AS explanation,
  CASE WHEN rule_hit AND gaz_display IS NOT NULL THEN 'rules>gazetteer' WHEN rule_hit THEN 'rules'
       WHEN ok THEN route ELSE concat(route, '>llm') END AS router
FROM m""")
def classify_with_model(spark, sf):
    return classified(spark, sf, model=stand_in_model, labels=_LABELS, fuzzy="contains")


@query("batch_metrics", f"""{_CLASSIFY_LABELS}
SELECT ROUND(AVG(CASE WHEN confidence >= 0.6 THEN 1.0 ELSE 0.0 END), 4) AS coverage,
  ROUND(AVG(CASE WHEN contains(router, 'llm') THEN 1.0 ELSE 0.0 END), 4) AS fallback_rate FROM routed""")
def batch_metrics(spark, sf):
    return C.batch_metrics(classified(spark, sf, labels=_LABELS))


@query("prediction_counters", f"""{_CLASSIFY}
SELECT COUNT(*) AS predict_requests_total, COUNT(*) FILTER (WHERE contains(router, 'llm')) AS fallback_total,
  AVG(CASE WHEN confidence >= 0.6 THEN 1.0 ELSE 0.0 END) AS coverage_ratio FROM routed""")
def prediction_counters(spark, sf):
    return C.prediction_counters(classified(spark, sf))


@query("edge_case_summary", f"""{_CLASSIFY}
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE contains(router, 'llm')) AS fallback,
  ROUND(AVG(CASE WHEN confidence >= 0.6 THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM routed""")
def edge_case_summary(spark, sf):
    return C.edge_case_summary(classified(spark, sf))
