import random

import pytest
from pyspark.sql import functions as F

from sparktally.operators import frequent as Q
from sparktally.operators import images as I
from sparktally.operators import models as M
from sparktally.operators import rules as R


@pytest.mark.parametrize("seed", range(4))
def test_threshold_picks_what_an_order_would(spark, seed, monkeypatch):
    """Many ties, keys that begin alike, keys of letters beyond ASCII and the empty key."""
    rng = random.Random(seed)
    keys = sorted({"".join(rng.choice("abé日\U0001F600") for _ in range(rng.randint(0, 4))) for _ in range(400)})
    rows = [(k, rng.choice([1, 1, 1, 2, 3, 50, 10**9 + 7 * i])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "term string, n long").cache()
    monkeypatch.setattr(Q, "SLICES", 7)
    monkeypatch.setattr(Q, "FEW", 3)
    ordered = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    for k in (0, 1, 2, 17, len(rows) // 2, len(rows) - 1, len(rows), 10**6):
        got = {tuple(r) for r in Q.most_frequent(df, "n", "term", k).collect()}
        assert got == set(ordered[:k]), k
    assert Q.most_frequent(df.limit(0), "n", "term", 5).collect() == []


def test_rows_of_one_text_come_back_evenly(spark):
    """A third of the rows share a text: no task gets it all."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"t{i % 997}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, t string")
    results = spark.createDataFrame([(f"t{i}", i) for i in range(900)] + [("hot", -1)], "t string, v long")
    out = Q.attach(df, results, "t", Q.text_counts(df, "t").cache())
    want = {i: None if t is None or (t != "hot" and int(t[1:]) >= 900) else -1 if t == "hot" else int(t[1:]) for i, t in rows}
    assert {r.id: r.v for r in out.collect()} == want and out.columns == ["id", "t", "v"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in Q.attach(df, results, "t", Q.text_counts(df, "t").cache()).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_large_rule_tables(spark):
    rng = random.Random(5)
    rules = [(rng.randint(0, 40), "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), f"c{i}") for i in range(120)]
    rules += [(99, "", "any"), (None, "a", "none"), (3, None, "none")]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    table = spark.createDataFrame(rules, "priority long, keyword string, category string")
    kept = sorted((r for r in rules if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2]))
    want = {i: next(((c, f"keyword:{k}") for _, k, c in kept if t is not None and k in t), (None, None)) for i, t in enumerate(texts)}
    for block in (10**6, 50):
        got = R.keyword_category_table(df, table, "t", block)
        assert {r.id: (r.kw_category, r.kw_reason) for r in got.collect()} == want
    assert {r.kw_category for r in R.keyword_category_table(df, table.limit(0), "t").collect()} == {None}


def test_chi_square_equals_the_definition(spark):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(6)
    rows = [(float(i % 3), Vectors.sparse(6, {j: float(rng.randint(1, 4)) for j in range(6) if rng.random() < (0.9 if j == i % 3 else 0.3)})) for i in range(60)]
    df = spark.createDataFrame(rows, ["label", "features"])
    got = {r.feature: r.chi2 for r in M.chi_square(df).collect()}
    for j in range(6):
        whole = sum(v[j] for _, v in rows)
        want = sum((sum(v[j] for c, v in rows if c == k) - whole / 3) ** 2 / (whole / 3) for k in range(3))
        assert got[j] == pytest.approx(want)
    assert M.best_features(df, 3) == sorted(sorted(got, key=lambda j: (-round(got[j] * 1e6), j))[:3])


def test_binned_isotonic_is_monotone_and_pools_violators(spark):
    rng = random.Random(7)
    scores = [rng.randint(0, 200) / 200 for _ in range(600)]
    rows = [(float(rng.random() < s * s), [1 - s, s]) for s in scores]
    model = M._fit_one(spark.createDataFrame(rows, "label double, proba array<double>"), 1, "isotonic")
    blocks = []  # pool adjacent violators over all distinct scores
    for s in sorted(set(scores)):
        ys = [y for y, (_, p) in rows if p == s]
        blocks.append([sum(ys), len(ys), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y, n, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + at]
    want = {s: y / n for y, n, at in blocks for s in at}
    for s, v in want.items():
        assert model.predict(s) == pytest.approx(v, abs=1e-9)


def test_only_origins_are_drawn(spark):
    rows = [(f"o{i}", 1, 1, 3, 16, bytes([i % 256, 0, 9])) for i in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    out = I.dataset_mean_std(df, 10)
    assert out.first().images == 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan and "data" not in plan.split("TakeOrderedAndProject")[1].split("\n")[0]
