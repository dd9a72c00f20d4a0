import pytest

from sparktally.operators.gazetteer import merchant_aliases
from sparktally.sources import gazetteers as G
from sparktally.sources import tables as R


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_transactions_by_name(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'mcc,raw_label,date,amount\n5411.0,"CB ""X"", Y",2025-01-02,-3.5\n,ACHAT,bad,x\n')
    first, second = R.read_transactions(spark, path).collect()
    assert (first.mcc, first.raw_label, str(first.date), first.amount) == (5411, 'CB "X", Y', "2025-01-02", -3.5)
    assert (second.mcc, second.date, second.amount) == (None, None, None)
    with pytest.raises(ValueError, match="category_label"):
        R.read_transactions(spark, path, required=("raw_label", "category_label"))


def test_gazetteer_in_file_order(spark, tmp_path):
    path = write(tmp_path / "g.csv", "alias,merchant_id,display_name\nmcdo,a,A\n***,b,B\nEDF,c,C\n")
    rows = G.read_gazetteer(spark, path).orderBy("alias_idx").collect()
    assert [r.merchant_id for r in rows] == ["a", "b", "c"] and rows[0].alias_idx < rows[1].alias_idx < rows[2].alias_idx
    # aliases that come out empty are dropped where aliases are folded
    assert [r.alias for r in merchant_aliases(G.read_gazetteer(spark, path)).orderBy("alias_idx").collect()] == ["mcdo", "edf"]
    bad = write(tmp_path / "b.csv", "alias,merchant_id\nx,y\n")
    with pytest.raises(ValueError):
        G.read_gazetteer(spark, bad)


def test_first_alias_wins(spark):
    df = spark.createDataFrame(
        [(1, " CASINO ", "late", "L"), (0, "casino", "early", "E")], "alias_idx long, alias string, merchant_id string, display_name string")
    assert [tuple(r) for r in G.build_gazetteer(df).collect()] == [(0, "casino", "early", "E")]


def test_aliases_of_templates(spark):
    rows = [
        (0, "McDonald's", "CB MCDO {city}"), (0, "McDonald's", "MCDONALD {city}"), (1, "TotalEnergies", "CB TOTAL {city_code}"),
        (2, "EDF", "PRLV EDF FACTURE {month}/{year}"), (2, "EDF", "EDF FACTURE {month}/{year}"), (3, "RATP", "PRLV RATP {month}"),
    ]
    got = G.derive_aliases(spark.createDataFrame(rows, "merchant_order long, merchant string, template string"))
    by_merchant = {}
    for r in got.orderBy("alias_idx").collect():
        by_merchant.setdefault((r.merchant_id, r.display_name), []).append(r.alias)
    assert by_merchant == {
        ("mcdonalds", "McDonald's"): ["mcdo", "mcdonald", "mcdonalds"],
        ("totalenergies", "TotalEnergies"): ["total", "totalenergies"],
        ("edf", "EDF"): ["edf", "edf facture /"], ("ratp", "RATP"): ["ratp"],
    }


def test_missing_report(spark, tmp_path):
    row = R.read_drift_summary(spark, str(tmp_path / "none")).collect()
    assert [r.status for r in row] == ["no_report"] and row[0].psi_topk is None


def test_time_log_skips_bad_minutes(spark, tmp_path):
    path = write(tmp_path / "l.csv", "date,minutes\n2025-01-01,30\n2025-01-02,abc\n2025-01-03,1.5\n2025-01-04, 45 \n2025-01-05,\n")
    assert [(str(r.date), r.minutes) for r in R.read_time_log(spark, path).collect()] == [("2025-01-01", 30), ("2025-01-04", 45)]


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class _Session:
    """Just enough of a session to ask it for its folder."""

    def __init__(self, conf, master):
        self.conf = _Conf(conf)
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getConf(self):
        return _Conf()

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_scratch_folder_is_the_one_the_session_names():
    from sparktally.session import CHECKPOINT_KEY, scratch_path

    named = _Session({CHECKPOINT_KEY: "hdfs://shared/x"}, "yarn")
    assert scratch_path(named, "t").startswith("hdfs://shared/x/t-")
    with pytest.raises(RuntimeError):
        scratch_path(_Session({}, "yarn"), "t")
    local = _Session({}, "local[2]")
    assert scratch_path(local, "t").startswith(local.folder) and scratch_path(local, "t") != scratch_path(local, "t")
