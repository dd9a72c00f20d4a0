import pytest
from pyspark.sql import functions as F

from sparktally.functions import text as T


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "s string").select(expression("s").alias("x")).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("  Café   ÉTÉ  ", "cafe ete"), (None, ""), ("", ""), (" Œuvre\tde l’été ", "oeuvre de l'ete"),
    ("Straße 5€", "strasse 5EUR"), ("été", "ete"), ("ŁÓDŹ Ørsted", "lodz orsted"),
])
def test_normalize_label(spark, raw, want):
    assert one(spark, raw, T.normalize_label) == want


@pytest.mark.parametrize("raw,want", [
    ("CB CARREFOUR 75 PARIS TPE1245", "carrefour 75 paris tpe1245"), ("CB TPE", "cb tpe"),
    ("Œuvre Straße", "uvre stra e"), ("UBER *TRIP", "uber trip"), ("***", ""), (None, ""),
    ("VIR  Café  visa CAFÉ", "cafe cafe"), ("ﬁnance", "finance"),
])
def test_normalize_merchant_text(spark, raw, want):
    assert one(spark, raw, T.normalize_merchant_text) == want


def test_mask_pii(spark):
    raw = "PRLV EDF RUM12345678-4321 IBAN FR7612345678901234567890123"
    assert one(spark, raw, T.mask_pii) == "PRLV EDF RUM_TOKEN IBAN IBAN_TOKEN"
    assert one(spark, raw, lambda c: T.mask_pii(c, "reference")) == "PRLV EDF RUM_TOKEN IBAN IBAN_TOKEN"
    # lower-cased text: hidden by default, left alone the other way
    assert one(spark, raw.lower(), T.mask_pii) == "prlv edf RUM_TOKEN iban IBAN_TOKEN"
    assert "fr76" in one(spark, raw.lower(), lambda c: T.mask_pii(c, "reference"))
    with pytest.raises(ValueError):
        T.mask_pii(F.lit("x"), "other")


def test_masked_text_has_no_match_left(spark, sf_dir):
    from sparktally.plans.fixtures import transactions

    left = T.preprocess(transactions(spark, sf_dir)).select(T.pii_matches("masked").alias("m"))
    assert left.where("size(m.iban) > 0 OR size(m.rum) > 0").count() == 0


@pytest.mark.parametrize("label,channel,want", [
    ("CB CARREFOUR", None, "card"), ("PRLV EDF", "", "direct_debit"), ("vir salaire", None, "transfer"),
    ("CB X", " vir ", "transfer"), ("CBX", None, "unknown"), ("CB X", "WEB", "card"), (None, None, "unknown"),
    ("CB ", None, "unknown"),
])
def test_operation_type(spark, label, channel, want):
    df = spark.createDataFrame([(label, channel)], "l string, c string")
    assert df.select(T.operation_type("l", "c")).first()[0] == want


def test_preprocess_record(spark):
    df = spark.createDataFrame(
        [("PRLV EDF FACTURE 07/2025 RUM FR12-ABC", "PRLV", 4900)], "raw_label string, channel string, mcc int")
    row = T.preprocess(df).withColumn("t", T.model_text()).first()
    assert row.operation_type == "direct_debit"
    assert "edf" in row.normalized and "rum" in row.masked and "FR12" not in row.masked
    assert row.t == "prlv edf facture 07/2025 rum fr12-abc op:direct_debit mcc:4900"
    assert row.tokens == ["prlv", "edf", "facture", "07", "2025", "rum", "fr12", "abc"]
    assert not row.has_iban and not row.has_rum


def test_model_text_without_code(spark):
    df = spark.createDataFrame([("a", "card", None), ("a", None, -1)], "masked string, operation_type string, mcc int")
    assert [r[0] for r in df.select(T.model_text()).collect()] == ["a op:card mcc:none", "a op:unknown mcc:none"]


def brute_ngrams(text, low=1, high=5):
    return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]


@pytest.mark.parametrize("text", ["", "a", "abc", "a  b c", "hello world"])
def test_char_ngrams(spark, text):
    want = brute_ngrams(" ".join(text.split()))
    assert one(spark, text, T.char_ngrams) == want
    df = spark.createDataFrame([(1, text)], "k int, s string")
    assert sorted(r.gram for r in T.ngram_rows(df, ["k"], "s").collect()) == sorted(want)


def test_document_words(spark):
    text = "The quick-brown foxes, 2 of them: jumped OVER it! Été à Paris_1"
    assert one(spark, text, T.clean_tokens) == ["quickbrown", "foxes", "jumped", "été", "paris"]
    assert one(spark, text, T.word_tokens) == ["quick", "brown", "foxes", "jumped", "été", "paris_1"]


@pytest.mark.parametrize("digits", [2, 3])
def test_fixed_point_equals_exact_rounding(spark, digits):
    import random

    r = random.Random(digits)
    values = [i / 10 ** (digits + 1) for i in range(10 ** (digits + 1) + 1)] + [r.random() for _ in range(500)]
    values += [0.125, 0.375, 0.0625, 0.3125, 1 / 3, 0.1 + 0.2, 1.0, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.fixed_point(F.col("v"), digits).alias("s"))
    assert all(row.s == f"{row.v:.{digits}f}" for row in rows.collect())
    assert spark.range(1).select(T.fixed_point(F.lit(None).cast("double"), 2)).first()[0] is None
