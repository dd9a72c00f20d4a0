import random

import pytest
from pyspark.sql import functions as F

from sparktally.operators import evaluate as E
from sparktally.operators.cumulative import running_totals
from sparktally.operators.features import stratified_split


def frame(spark, rows):
    return spark.createDataFrame(rows, "truth string, pred string, conf double")


ROWS = [("a", "a", 0.9), ("a", "b", 0.7), ("b", "b", 0.61), ("c", "a", 0.41), ("c", "d", 0.2)]


def test_scores_by_hand(spark):
    df = frame(spark, ROWS)
    assert E.accuracy(df, "truth", "pred").first()[0] == pytest.approx(2 / 5)
    # a: tp 1 fp 1 fn 1, b: tp 1 fp 1 fn 0, c: fn 2, d: fp 1
    want = (2 / 4 + 2 / 3 + 0 + 0) / 4
    assert E.macro_f1(df, "truth", "pred").first()[0] == pytest.approx(want)
    row = E.eval_summary(df, "truth", "pred", "conf", 0.6).first()
    assert row.macro_f1 == pytest.approx(want) and row.coverage_at_tau == pytest.approx(3 / 5)
    assert row.classes == ["a", "b", "c"] and row.accuracy_top1 == pytest.approx(2 / 5)


def test_confusion_includes_empty_cells(spark):
    cells = {(r.truth, r.pred): r.n for r in E.confusion_matrix(frame(spark, ROWS), "truth", "pred").collect()}
    assert len(cells) == 16 and cells["c", "d"] == 1 and cells["d", "d"] == 0 and sum(cells.values()) == 5


def test_coverage_never_rises(spark):
    sweep = E.tau_sweep(frame(spark, ROWS), "truth", "pred", "conf").orderBy("tau").collect()
    assert len(sweep) == 26 and [r.coverage for r in sweep] == sorted((r.coverage for r in sweep), reverse=True)
    assert len({r.macro_f1 for r in sweep}) == 1


@pytest.mark.parametrize("target,pick,want", [
    (0.6, "highest", 0.6), (0.6, "lowest", 0.4), (0.99, "highest", 0.4), (0.99, "lowest", 0.4)])
def test_recommend_tau(spark, target, pick, want):
    sweep = E.tau_sweep(frame(spark, ROWS), "truth", "pred", "conf")
    assert E.recommend_tau(sweep, target, pick).first().tau == pytest.approx(want)


def test_empty_input(spark):
    df = frame(spark, []).limit(0)
    assert E.accuracy(df, "truth", "pred").first()[0] == 0.0
    assert E.coverage_at(df).first().coverage == 0.0
    assert E.macro_f1(df, "truth", "pred").first()[0] == 0.0


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_percentiles(spark, n):
    r = random.Random(n)
    values = [round(r.expovariate(0.1), 1) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = E.percentile_summary(df, "v").first()
    ranked = sorted(values)
    want = [ranked[int(round(x * (n - 1)))] for x in (0.5, 0.95, 0.99)]
    assert [row["count"], row.p50, row.p95, row.p99, row["max"]] == [n, *want, ranked[-1]]


def test_running_totals_with_one_hot_value(spark):
    rows = [(1.0, 1_000_000)] + [(float(i), 1) for i in range(2, 900)]
    got = running_totals(spark.createDataFrame(rows, "v double, n long"), "v", ["n"], slices=16)
    total = 0
    for r, (v, n) in zip(got.orderBy("v").collect(), rows):
        total += n
        assert (r.v, r.cum_n, r.all_n) == (v, total, 1_000_898)


@pytest.mark.parametrize("val", [0.0, 0.2, 0.5, 1.0])
def test_split_takes_the_share_of_every_class(spark, val):
    rows = [(i, "big" if i % 3 else ("none" if i % 2 else None)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = stratified_split(df, "id", "label", val, seed=3)
    counts = {(r.label, r.part): r["count"] for r in out.groupBy("label", "part").count().collect()}
    for label in ("big", "none", None):
        size = sum(1 for _, x in rows if x == label)
        assert counts.get((label, "val"), 0) == int(size * val + 0.5)
        assert counts.get((label, "val"), 0) + counts.get((label, "train"), 0) == size


def test_gates(spark):
    row = E.quality_gates(spark.createDataFrame([(0.9, 0.95, 0.3)], "macro_f1 double, coverage double, psi double")).first()
    assert row.macro_f1_ok and row.coverage_ok and not row.psi_ok and not row.all_ok


def test_histogram_counts_rise(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("double").alias("v"))
    rows = E.cumulative_histogram(df, "v").collect()
    assert [r["count"] for r in rows] == [6, 11, 21, 41, 81, 161, 321, 641, 1281, 2000] and rows[-1].le == "+Inf"
