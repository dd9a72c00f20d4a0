import math

import pytest
from pyspark.sql import functions as F

from sparktally import constants as K
from sparktally.operators import classify as C
from sparktally.operators import fallback as B

TX = "tx_id string, raw_label string, channel string, mcc int"


def verdict(spark, text, labels, fuzzy="contains"):
    df = spark.createDataFrame([(text,)], "normalized string")
    return B.fallback_score(df, labels, fuzzy=fuzzy).first()


def test_fallback_by_hand(spark):
    row = verdict(spark, "carrefour market rent", ["Groceries", "Rent"])
    scores = [0.6 * 1.0 + 0.0, 0.0 + 0.05]
    powers = [math.exp((s - max(scores)) / 0.3) for s in scores]
    assert row.fb_category == "Groceries" and row.fb_reason == "kw_hits=2, fuzzy=0.000"
    assert row.fb_confidence == pytest.approx(powers[0] / sum(powers))


def test_fallback_first_label_on_ties(spark):
    row = verdict(spark, "zzz", ["Rent", "Salary", "Other"])
    assert row.fb_category == "Rent" and row.fb_confidence == pytest.approx(1 / 3)


def test_fallback_with_similarity(spark):
    row = verdict(spark, "pret salary", ["Rent", "Salary"], "similarity")
    assert row.fb_category == "Salary" and row.fb_reason == "kw_hits=1, fuzzy=1.000"


def test_no_labels(spark):
    row = verdict(spark, "x", [])
    assert (row.fb_category, row.fb_confidence, row.fb_reason) == ("", 0.0, "no-labels")


def test_validate(spark):
    df = spark.createDataFrame([("A", 1.7, "r"), ("Z", -1.0, ""), (None, None, None)],
                               "fb_category string, fb_confidence double, fb_reason string")
    rows = [tuple(r) for r in B.validate_verdict(df, ["A", "B"]).collect()]
    assert rows == [("A", 1.0, "r"), ("A", 0.0, "| coerced-to-valid"), ("A", 0.0, "| coerced-to-valid")]
    assert tuple(B.validate_verdict(df, []).first()) == ("", 0.0, "no-labels")


def route(spark, rows, **options):
    return {r.tx_id: r for r in C.classify(spark.createDataFrame(rows, TX), **options).collect()}


def gaz(spark):
    from sparktally.plans.fixtures import gazetteer

    return gazetteer(spark)


def test_rules_and_gazetteer(spark):
    out = route(spark, [("t1", "CB CARREFOUR 75 PARIS TPE1245", "CB", 5411), ("t2", "PRLV EDF FACTURE 07/2025", "PRLV", None)],
                gaz=gaz(spark))
    assert out["t1"].router == "rules>gazetteer" and out["t1"].normalized_merchant == "Carrefour"
    assert out["t1"].explanation == "rules:mcc:5411 | gazetteer:alias:carrefour|score:0.90"
    assert out["t1"].confidence == 0.80 and out["t2"].budget_category == "Utilities"


def test_no_model_contract(spark):
    noisy = [("t3", "CB ZXQW PLORP STORE 9999 XJ-REF88", "CB", None)]
    row = route(spark, noisy)["t3"]
    assert (row.budget_category, row.confidence, row.router) == ("", 0.0, "model>llm")
    assert row.explanation == "model:unavailable | llm:no-labels"
    row = route(spark, noisy, labels=K.CATEGORIES)["t3"]
    assert row.budget_category in K.CATEGORIES and row.router == "model>llm" and row.confidence > 0


def test_model_contract(spark):
    def model(p, oov):
        return lambda df: df.withColumns({
            "model_category": F.lit("Rent"), "model_pmax": F.lit(p), "model_oov": F.lit(oov)})

    rows = [("t", "bk strasbourg", None, None)]
    sure = route(spark, rows, gaz=gaz(spark), model=model(0.91, 0.125), labels=K.CATEGORIES)["t"]
    assert sure.router == "gazetteer>model" and sure.budget_category == "Rent" and sure.confidence == 0.91
    assert sure.explanation == "gazetteer:alias:bk|score:0.90 | model:pmax=0.910 | oov=0.12"
    strange = route(spark, rows, model=model(0.91, 0.9), labels=K.CATEGORIES)["t"]
    assert strange.router == "model>llm" and strange.confidence >= 0.91
    unsure = route(spark, rows, gaz=gaz(spark), model=model(0.91, 0.0), labels=K.CATEGORIES, tau=0.99)["t"]
    assert unsure.router == "gazetteer>model>llm" and " | llm:kw_hits=" in unsure.explanation


def test_metrics_of_no_rows(spark):
    preds = route_frame(spark).limit(0)
    assert tuple(C.batch_metrics(preds).first()) == (0.0, 0.0)
    assert tuple(C.prediction_counters(preds).first()) == (0, 0, 0.0)


def route_frame(spark):
    return C.classify(spark.createDataFrame([("t", "x", None, None)], TX))


def test_request_to_answer(spark):
    from sparktally.sources.tables import explode_requests

    body = '{"transactions": [{"tx_id": "t1", "raw_label": "CB CARREFOUR", "mcc": 5411}, {"tx_id": "t2"}]}'
    docs = spark.createDataFrame([(1, body), (2, '{"foo": "bar"}')], "request_id int, body string")
    valid, invalid = explode_requests(docs)
    assert [r.tx_id for r in C.classify(valid).collect()] == ["t1"]
    assert sorted((r.request_id, r.missing) for r in invalid.collect()) == [(1, "raw_label"), (2, "transactions")]
