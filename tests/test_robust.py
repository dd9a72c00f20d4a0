"""Input off the usual path: wrong types, missing columns, nulls, NaN; workers without the driver's path."""

import os
import subprocess
import sys

import pytest

from sparktally import constants as K
from sparktally.functions import text as T
from sparktally.operators import drift as D
from sparktally.operators import evaluate as E
from sparktally.operators import rules as R
from sparktally.operators.classify import classify
from sparktally.sources import gazetteers as G
from sparktally.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("code,category", [("5411", "Groceries"), ("abc", None), ("", None), (None, None), ("99999999999", None)])
def test_merchant_codes_as_text(spark, code, category):
    df = spark.createDataFrame([("x", code, "cb x", "unknown")], "normalized string, mcc string, masked string, operation_type string")
    row = df.select(R.category_from_mcc("mcc").alias("c"), T.model_text().alias("t")).first()
    assert row.c == category and row.t.endswith("mcc:5411" if category else "mcc:none")
    assert R.apply_rules(df).first().rule_category == category


def test_only_a_label_is_needed(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("CB CARREFOUR 75 PARIS",), ("PRLV LOYER",)], "raw_label string"), str(tmp_path / "t"))
    tx = tables.read_transactions(spark, str(tmp_path / "t"))
    assert tx.schema["mcc"].dataType.simpleString() == "int" and tx.schema["channel"].dataType.simpleString() == "string"
    bare = spark.createDataFrame([("1", "CB CARREFOUR 75 PARIS")], "tx_id string, raw_label string")
    assert T.preprocess(bare).select(T.model_text()).first()[0].endswith("mcc:none")
    assert classify(bare).count() == 1


def test_out_of_range_numbers_become_null(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("a", "1e12", "x")], "raw_label string, mcc string, amount string"), str(tmp_path / "t"))
    row = tables.read_transactions(spark, str(tmp_path / "t")).first()
    assert row.mcc is None and row.amount is None


def test_loosely_typed_requests(spark):
    body = ('{"transactions": [{"raw_label": "a", "mcc": "5411", "amount": 3}, {"raw_label": "b", "amount": "x"}, '
            '{"raw_label": "c", "mcc": 5411.5}, {"raw_label": null}, {"raw_label": 7, "amount": "2.5"}]}')
    valid, invalid = tables.explode_requests(spark.createDataFrame([(1, body), (2, "no json")], "id long, body string"))
    assert [(r.raw_label, r.mcc, r.amount) for r in valid.orderBy("raw_label").collect()] == [("7", None, 2.5), ("a", 5411, 3.0)]
    assert sorted(r.missing for r in invalid.collect()) == ["amount", "mcc", "raw_label", "transactions"]


def test_confusion_cells_add_up_with_missing_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), (None, None)], "t string, p string")
    cells = E.confusion_matrix(df, "t", "p").collect()
    assert sum(r.n for r in cells) == 4 and len(cells) == 9
    assert {(r.truth, r.pred) for r in cells if r.n} == {("a", "a"), ("a", None), (None, "b"), (None, None)}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, True), (float("nan"), True), (3.0, False), (None, False), (2.0, True)], "v double, t boolean")
    row = E.percentile_summary(df, "v").first()
    assert (row["count"], row.p50, row.max) == (3, 2.0, 3.0)
    assert D.ks_two_sample(df, "v", df.t).first().n_first == 2
    bins = D.histogram(df, "v", df.t).collect()
    assert len(bins) == 60 and sum(r.n for r in bins) == 3


def test_folded_away_aliases_stay_in_the_table(spark, tmp_path):
    rows = spark.createDataFrame([("***", "m", "M"), ("edf", "e", "E")], "alias string, merchant_id string, display_name string")
    tables.write_csv(rows.coalesce(1), str(tmp_path / "g"))
    assert [(r.alias_idx, r.alias) for r in G.read_gazetteer(spark, str(tmp_path / "g")).orderBy("alias_idx").collect()] == [
        (0, "***"), (1, "edf")]


def test_constants_are_the_published_values():
    assert K.MCC_CATEGORIES == {
        5411: "Groceries", 5814: "Restaurants", 4111: "Transport", 4900: "Utilities", 6513: "Rent", 6011: "Salary"}


def test_a_query_runs_from_another_folder(tmp_path, sf_dir):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from sparktally.session import local_session\nimport __spark_entry__ as e\n"
            f"print('ROWS', e.queries()['classify'](local_session(2), {sf_dir!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_DRIVER_MEMORY": "2g"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 1500" in out.stdout, out.stderr[-1500:]
