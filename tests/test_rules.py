import pytest

from sparktally import constants as K
from sparktally.functions.text import preprocess
from sparktally.operators import rules as R


def outcome(spark, label, channel=None, mcc=None):
    df = spark.createDataFrame([(label, channel, mcc)], "raw_label string, channel string, mcc int")
    row = R.apply_rules(preprocess(df)).first()
    return row.rule_hit, row.rule_category, row.rule_reason


@pytest.mark.parametrize("label,mcc,want", [
    ("CB CARREFOUR 75 PARIS TPE1245", 5411, (True, "Groceries", "mcc:5411")),
    ("PRLV EDF FACTURE 07/2025", 4900, (True, "Utilities", "mcc:4900")),
    ("PRLV EDF FACTURE 07/2025", 9999, (True, "Utilities", "keyword:edf")),
    ("PRLV LOYER APPARTEMENT SEPT", None, (True, "Rent", "keyword:loyer")),
    ("freelance", None, (True, "Utilities", "keyword:free")),
    ("totalenergies mcdonald", None, (True, "Transport", "keyword:total")),
    ("ACHAT ?????", None, (False, None, "")),
    (None, None, (False, None, "")),
])
def test_apply_rules(spark, label, mcc, want):
    assert outcome(spark, label, mcc=mcc) == want


def test_first_keyword_wins_in_order(spark):
    words = [w for w, _ in K.KEYWORD_CATEGORIES]
    rows = [(f"{later} {earlier}",) for i, earlier in enumerate(words) for later in words[i + 1 :]]
    hits = spark.createDataFrame(rows, "t string").select("t", R.keyword_category("t").alias("v")).collect()
    for row in hits:
        first = next(w for w in words if w in row.t)
        assert row.v.reason == f"keyword:{first}" and row.v.category == dict(K.KEYWORD_CATEGORIES)[first]


@pytest.mark.parametrize("text,reason", [
    ("facture de mon free mobile", "pattern:facture+operator"), ("facture gaz", None), ("salaire mars", "pattern:salaire"),
    ("payroll", "pattern:salaire"), ("mon loyer", "pattern:loyer"), ("loyers", None), ("factures edf", None),
])
def test_pattern_category(spark, text, reason):
    v = spark.createDataFrame([(text,)], "t string").select(R.pattern_category("t").alias("v")).first().v
    assert (v.reason if v else None) == reason
