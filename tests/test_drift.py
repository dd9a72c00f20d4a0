import math
import random

import pytest
from pyspark.sql import functions as F

from sparktally.operators import drift as D
from sparktally.operators import timelog as L


def rows(spark, texts, split):
    return spark.createDataFrame([(t, split) for t in texts], "t string, split string")


def both(spark, train, prod):
    return rows(spark, train, "train").unionByName(rows(spark, prod, "prod"))


def is_train():
    return F.col("split") == "train"


def test_no_drift_between_equal_halves(spark):
    texts = ["cb carrefour", "loyer", "edf facture"] * 5
    profile = D.ngram_profile(both(spark, texts, texts), "t", is_train())
    assert D.psi(profile).first().psi == pytest.approx(0.0, abs=1e-9)
    assert D.oov_rate(profile, D.vocabulary(profile)).first().oov_rate == 0.0


def test_psi_by_hand(spark):
    df = spark.createDataFrame([(8, 2), (2, 8)], "n_train long, n_prod long")
    assert D.psi(df).first().psi == pytest.approx(2 * 0.6 * math.log(4), abs=1e-6)


def test_oov_of_unseen_text(spark):
    profile = D.ngram_profile(both(spark, ["aaaa"], ["bb", "a"]), "t", is_train())
    # b, b, bb are unknown, a is known
    assert D.oov_rate(profile, D.vocabulary(profile)).first().oov_rate == pytest.approx(3 / 4)
    capped = D.vocabulary(profile, 1)
    assert [r.gram for r in capped.collect()] == ["a"]
    empty = D.ngram_profile(both(spark, ["aaaa"], []), "t", is_train())
    assert D.oov_rate(empty, D.vocabulary(empty)).first().oov_rate == 0.0


def test_ks_by_definition(spark):
    r = random.Random(3)
    a = [round(r.random(), 2) for _ in range(150)]
    b = [round(r.random() ** 1.5, 2) for _ in range(90)]
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b] + [(None, True)], "v double, first boolean")
    row = D.ks_two_sample(df, "v", F.col("first")).first()
    want = max(abs(sum(x <= v for x in a) / 150 - sum(x <= v for x in b) / 90) for v in a + b)
    assert row.ks_stat == pytest.approx(want) and 0 <= row.ks_pvalue <= 1
    same = D.ks_two_sample(df.select("v", F.lit(True).alias("first")).unionByName(df.select("v", F.lit(False).alias("first"))),
                           "v", F.col("first")).first()
    assert same.ks_stat == 0 and same.ks_pvalue == 1.0


def test_missing_label_is_a_class(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "label string")
    assert {r["class"]: r.share for r in D.category_mix(df, "label").collect()} == {"a": 0.5, "nan": 0.25, "b": 0.25}


def test_largest_shift_first_by_name_on_ties(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "class string, share double")
    b = spark.createDataFrame([("x", 0.25), ("z", 0.25), ("y", 0.5)], "class string, share double")
    row = D.largest_shift(a, b).first()
    assert (row["class"], row.train, row.prod) == ("x", 0.5, 0.25)


def test_summary_alerts_both_ways(spark):
    calm = both(spark, ["abc", "abd"], ["abc", "abd"]).withColumn("label", F.lit("x"))
    row = D.drift_summary(calm, is_train(), "t", "label").first()
    assert row.psi_topk == 0.0 and row.largest_label_shift is None and row.ks_confidence_stat is None
    assert not row.alerts.psi_topk_gt_threshold and not row.alerts.label_shift_gt_threshold
    moved = both(spark, ["abc"] * 3 + ["xyz"], ["abc", "xyz", "xyz", "qrs"]).withColumn("label", F.substring("t", 1, 1))
    row = D.drift_summary(moved, is_train(), "t", "label").first()
    assert row.alerts.psi_topk_gt_threshold and row.alerts.label_shift_gt_threshold
    assert row.largest_label_shift["class"] == "a" and row.oov_rate == 0.25
    assert row.thresholds.psi_alert == 0.2


def test_burndown_and_daily(spark):
    import datetime

    log = spark.createDataFrame(
        [("2025-01-01", 60), ("2025-01-01", 60), ("2025-01-03", 600), ("2024-12-31", 999)], "date string, minutes long"
    ).withColumn("date", F.to_date("date"))
    got = L.burndown(log, datetime.date(2025, 1, 1), datetime.date(2025, 1, 3), 10.0).orderBy("day").collect()
    assert [r.ideal for r in got] == [10.0, 5.0, 0.0] and [r.actual for r in got] == [8.0, 8.0, 0.0]
    assert L.avg_daily(log).first()[0] == pytest.approx(1719 / 3)
    assert L.avg_daily(log.limit(0)).first()[0] == 0.0


def test_completion(spark):
    df = spark.createDataFrame([(8.0, True, 9.9), (4.0, False, None), (4.0, False, 1.2)], "w double, done boolean, spent double")
    row = L.weighted_completion(df, F.col("w"), F.col("done"), F.col("spent")).first()
    assert tuple(row) == (50, 16.0, 6.0)
    assert tuple(L.weighted_completion(df.limit(0), F.col("w"), F.col("done"), F.col("spent")).first()) == (0, 0.0, 0.0)
