"""The router: rules, gazetteer, model, fallback; and aggregates over its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktally.functions.text import fixed_point, model_text, preprocess
from sparktally.operators import fallback as fb
from sparktally.operators.cumulative import weighted_count
from sparktally.operators.gazetteer import MAX_SHIPPED, resolve_merchant
from sparktally.operators.rules import apply_rules

#: Confidence of a rule hit.
RULE_CONFIDENCE = 0.80
#: Output columns after the keys.
OUTPUT = ["operation_type", "normalized_merchant", "budget_category", "confidence", "explanation", "router"]

Model = Callable[[DataFrame], DataFrame]


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def prepare(df: DataFrame, gaz: DataFrame | None = None, gaz_cut: float = 0.90,
            max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """Preprocessed rows with the rule outcome and the accepted merchant."""
    ruled = apply_rules(preprocess(df))
    if gaz is None:
        return ruled.withColumns({
            "gaz_display": F.lit(None).cast("string"), "gaz_reason": F.lit(None).cast("string")})
    found = resolve_merchant(ruled, gaz, gaz_cut, max_shipped=max_shipped)
    return found.withColumn("gaz_reason", F.when(F.col("gaz_display").isNotNull(), F.col("gaz_reason")))


def classify(df: DataFrame, gaz: DataFrame | None = None, model: Model | None = None, labels: list[str] | None = None,
             tau: float = 0.6, gaz_cut: float = 0.90, oov_tau: float = 0.55, fuzzy: str = "similarity",
             scorer: Callable[[DataFrame], DataFrame] | None = None, keys: tuple[str, ...] = ("tx_id",),
             max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """Route every transaction and explain the outcome.

    ``model`` adds model_category, model_pmax and model_oov to rows that have
    ``masked`` and ``model_text``. ``labels`` are the categories open to the
    fallback; none reproduces a service without a trained model.

    Without a model the rows stay in one projection chain: the fallback sees
    a null text for rule hits and skips them. With one, hits and misses part
    into two branches, since a model transform cannot skip rows.
    """
    rows = prepare(df, gaz, gaz_cut, max_shipped)
    merchant = F.col("gaz_display")
    gaz_part = F.concat(F.lit("gazetteer:"), F.col("gaz_reason"))
    hit = F.col("rule_hit")

    def by_rules() -> dict[str, Column]:
        return {
            "budget_category": F.col("rule_category"),
            "confidence": F.lit(RULE_CONFIDENCE),
            "explanation": _joined(F.concat(F.lit("rules:"), F.col("rule_reason")), gaz_part),
            "router": F.when(merchant.isNotNull(), "rules>gazetteer").otherwise("rules"),
        }

    def output(scored: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return scored.select(
            *keys, "operation_type", merchant.alias("normalized_merchant"),
            *[columns[c].alias(c) for c in OUTPUT[2:]],
        )

    if model is None:
        opened = rows.withColumn("_open", F.when(~hit, F.col("normalized")))
        judged = fb.fallback(opened, labels or [], scorer, "_open", fuzzy)
        rules = by_rules()
        missed = {
            "budget_category": F.col(fb.CATEGORY),
            "confidence": F.round(fb.CONFIDENCE, 4),
            "explanation": _joined(
                gaz_part, F.lit("model:unavailable"), F.concat(F.lit("llm:"), F.col(fb.REASON))),
            "router": F.lit("model>llm"),
        }
        return output(judged, {c: F.when(hit, rules[c]).otherwise(missed[c]) for c in rules})

    hits = output(rows.where(hit), by_rules())
    modelled = model(rows.where(~hit).withColumn("model_text", model_text()))
    accepted = (F.col("model_pmax") >= tau) & (F.col("model_oov") <= oov_tau)
    opened = modelled.withColumn("_ok", F.coalesce(accepted, F.lit(False))).withColumn(
        "_open", F.when(~F.col("_ok"), F.col("normalized")))
    judged = fb.fallback(opened, labels or [], scorer, "_open", fuzzy)
    ok = F.col("_ok")
    model_part = F.concat(
        F.lit("model:pmax="), fixed_point(F.col("model_pmax"), 3),
        F.lit(" | oov="), fixed_point(F.col("model_oov"), 2))
    route = F.when(merchant.isNotNull(), "gazetteer>model").otherwise("model")
    best = F.greatest(F.col("model_pmax"), F.col(fb.CONFIDENCE))
    misses = output(judged, {
        "budget_category": F.when(ok, F.col("model_category")).otherwise(F.col(fb.CATEGORY)),
        "confidence": F.round(F.when(ok, F.col("model_pmax")).otherwise(best), 4),
        "explanation": _joined(gaz_part, model_part, F.when(~ok, F.concat(F.lit("llm:"), F.col(fb.REASON)))),
        "router": F.when(ok, route).otherwise(F.concat(route, F.lit(">llm"))),
    })
    return hits.unionByName(misses)


def _fell_back() -> Column:
    return F.coalesce(F.col("router").contains("llm"), F.lit(False))


def _share(part: Column) -> Column:
    return F.coalesce(part / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def batch_metrics(preds: DataFrame, tau: float = 0.6) -> DataFrame:
    """coverage and fallback_rate, rounded to four digits, 0.0 on no rows."""
    return preds.agg(
        F.round(_share(weighted_count(F.col("confidence") >= tau)), 4).alias("coverage"),
        F.round(_share(weighted_count(_fell_back())), 4).alias("fallback_rate"),
    )


def prediction_counters(preds: DataFrame, tau: float = 0.6) -> DataFrame:
    """Requests, fallbacks and covered share, counted per transaction."""
    return preds.agg(
        F.count(F.lit(1)).alias("predict_requests_total"),
        weighted_count(_fell_back()).alias("fallback_total"),
        _share(weighted_count(F.col("confidence") >= tau)).alias("coverage_ratio"),
    )


def edge_case_summary(preds: DataFrame, tau: float = 0.6) -> DataFrame:
    return preds.agg(
        F.count(F.lit(1)).alias("n"),
        weighted_count(_fell_back()).alias("fallback"),
        F.round(_share(weighted_count(F.col("confidence") >= tau)), 4).alias("coverage"),
    )
