import math

import pytest
from pyspark.sql import functions as F

from sparktally.functions import text as T
from sparktally.functions import vectors as V
from sparktally.operators import features as X
from sparktally.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    texts = [("cb carrefour paris", "Groceries"), ("prlv edf facture", "Utilities"), ("loyer foncia", "Rent")]
    data = [(i, f"{t} {i % 7}", label) for i, (t, label) in enumerate(texts * 20)]
    return spark.createDataFrame(data, "tx_id long, model_text string, category_label string").withColumn(
        "masked", F.col("model_text"))


@pytest.fixture(scope="module")
def model(rows):
    return M.train(rows, M.forest(trees=5, depth=5), high=3, max_features=300)


def test_vectors_equal_the_relational_weights(spark, rows):
    features = M.fit_text_features(rows, high=2, max_features=10_000)
    counter = features.stages[1]
    words = F.array(*[F.lit(w) for w in counter.vocabulary])
    unpacked = features.transform(rows).select("model_text", F.unwrap_udt("features").alias("v")).distinct()
    pairs = unpacked.select("model_text", F.explode(F.arrays_zip("v.indices", "v.values")).alias("p")).select(
        "model_text", F.element_at(words, F.col("p.indices") + 1).alias("term"), F.col("p.values").alias("w"))
    got = {(r.model_text, r.term): r.w for r in pairs.collect()}
    want = {(r.model_text, r.term): r.tfidf for r in X.char_tfidf(rows, "model_text", 1, 2).collect()}
    assert got == pytest.approx(want)


def test_learns_and_gives_probabilities(model, rows):
    preds = model.predict(rows).collect()
    assert model.labels == ["Groceries", "Rent", "Utilities"]
    assert all(r.model_category == r.category_label for r in preds)
    assert all(math.isclose(sum(r.proba), 1.0) and r.model_pmax == max(r.proba) for r in preds)


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration(rows, spark, tmp_path, method):
    fitted = M.train(rows, M.forest(trees=5, depth=3), high=2, max_features=200, calibrate=method)
    preds = fitted.predict(rows)
    assert all(math.isclose(sum(r.proba), 1.0) for r in preds.collect())
    fitted.save(str(tmp_path / "m"))
    again = M.TextModel.load(spark, str(tmp_path / "m")).predict(rows)
    key = ["tx_id", "model_category"]
    assert sorted(map(tuple, preds.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


def test_boosted_probabilities(rows):
    fitted = M.train(rows, M.boosted(rounds=2, depth=2), high=1, max_features=50)
    preds = fitted.predict(rows).collect()
    assert all(math.isclose(sum(r.proba), 1.0) for r in preds)
    assert sum(r.model_category == r.category_label for r in preds) > 50


def test_oov_equals_the_lookup(spark, model, rows):
    from pyspark.ml.feature import CountVectorizerModel

    fresh = spark.createDataFrame([(1, "cb carrefour"), (2, "zzzz"), (3, ""), (4, "edf qx")], "tx_id long, masked string")
    counter = next(s for s in model.features.stages if isinstance(s, CountVectorizerModel))
    vocab = spark.createDataFrame([(w,) for w in counter.vocabulary], "gram string")
    got = {r.tx_id: r.model_oov for r in model.with_oov(fresh).collect()}
    want = {r.tx_id: r.oov for r in X.oov_rate_row(fresh, "tx_id", "masked", vocab, 1, 3).collect()}
    assert got == pytest.approx(want) and got[3] == 1.0


def test_forced_fallback(spark, model):
    from sparktally.operators.classify import classify

    df = spark.createDataFrame([("t3", "CB ZXQW PLORP STORE 9999 XJ-REF88", "CB", None)],
                               "tx_id string, raw_label string, channel string, mcc int")
    row = classify(df, model=model.router_model(), labels=model.labels, tau=0.99, oov_tau=0.0).first()
    assert "llm" in row.router
    easy = classify(df, model=model.router_model(), labels=model.labels, tau=0.0, oov_tau=1.0).first()
    assert easy.router == "model" and easy.explanation.startswith("model:pmax=")


def test_word_vectors_and_components(spark):
    docs = spark.createDataFrame([(["data", "spark", "table"],), (["spark", "data", "join"],)] * 10, "tokens array<string>")
    fitted = M.word2vec(docs, "tokens", size=8, epochs=2)
    words = fitted.getVectors().withColumn("v", M.vector_to_array("vector"))
    out = M.pca(words, "v", 2)
    assert out.count() == 4 and all(len(r.pca) == 2 for r in out.collect())
    centre = out.agg(*[F.avg(F.col("pca")[i]).alias(str(i)) for i in range(2)]).first()
    assert list(centre) == pytest.approx([0.0, 0.0], abs=1e-9)


def test_vector_maths(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0])], "id int, v array<double>")
    units = {r.id: r.u for r in df.select("id", V.l2_normalize("v").alias("u")).collect()}
    assert units[1] == pytest.approx([0.6, 0.8]) and units[2] == [0.0, 0.0]
    pairs = spark.createDataFrame([(1, 3), (1, 1)], "id_a int, id_b int")
    got = {(r.id_a, r.id_b): r.cosine for r in V.cosine_similarity(df, pairs, "id", "v").collect()}
    assert got == {(1, 3): 0.96, (1, 1): 1.0}
    assert tuple(df.select(V.vector_stats("v").alias("s")).first().s) == (3.0, 4.0, 3.5, 0.5)


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "label string")
    assert sorted(((r.label or "", r.label_index) for r in X.encode_labels(df, "label").collect()), key=str) == sorted(
        [("b", 1), ("a", 0), ("", None), ("b", 1)], key=str)


def test_vocabulary_and_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"]), (3, [])], "d int, t array<string>")
    row = X.vocabulary(df, "t", preview=2).first()
    assert (row.vocabulary_size, row.preview) == (3, ["a", "b"])
    assert {(r.d, r.term): r.n for r in X.bag_of_words(df, "d", "t").collect()} == {(1, "b"): 2, (1, "a"): 1, (2, "c"): 1}


def test_preprocessed_text_feeds_the_model(spark, model):
    df = spark.createDataFrame([("CB Carrefour", "CB", None)], "raw_label string, channel string, mcc int")
    row = model.predict(T.preprocess(df).withColumn("model_text", T.model_text())).first()
    assert row.model_category in model.labels


def test_equal_rows_are_trained_on_once(spark, monkeypatch):
    """The linear model sees each text and label once, and is the one that the single rows give."""
    texts = [("cb shop a", "x"), ("prlv b b", "y"), ("cb shop", "x"), ("a b", "y"), ("cb shop a", "y")]
    copies = [40, 3, 7, 1, 9]
    data = [(i * 100 + k, t, label) for i, ((t, label), n) in enumerate(zip(texts, copies)) for k in range(n)]
    df = spark.createDataFrame(data, "tx_id long, model_text string, category_label string")
    seen = []
    fit = M.LogisticRegression._fit
    monkeypatch.setattr(M.LogisticRegression, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    model = M.train(df, M.linear(strength=0.1), high=2)
    assert seen == [5]
    single = model.features.transform(df).withColumn("label", (F.col("category_label") == "y").cast("double"))
    want = M.linear(strength=0.1).fit(single).transform(single).select("tx_id", M.vector_to_array("probability").alias("p"))
    got = {r.tx_id: r.proba for r in model.predict(df).collect()}
    for r in want.collect():
        assert got[r.tx_id] == pytest.approx(r.p, abs=2e-4)


def test_counts_of_repeated_texts(spark):
    """Weights from counts of distinct texts are those of Spark's own IDF on all rows."""
    from pyspark.ml.feature import IDF

    df = spark.createDataFrame([("aab a",)] * 5 + [("ab",)] * 2 + [("",), ("cé c",)], "model_text string")
    features = M.fit_text_features(df, high=3, max_features=6)
    counter, weights = features.stages[1], features.stages[2]
    assert counter.vocabulary[0] == "a" and len(counter.vocabulary) == 6
    counted = counter.transform(features.stages[0].transform(df))
    idf = IDF(inputCol="counts", outputCol="w").fit(counted).idf.toArray() + 1.0
    assert list(weights.getScalingVec()) == pytest.approx(list(idf))


def test_a_limited_vocabulary_moves_no_terms(spark, rows):
    """However large Spark takes the term table to be, terms of documents are not shuffled to it and back."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = X.char_tfidf(rows, "model_text", 1, 2, max_features=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan


def test_trees_get_equal_rows_in_portions(spark, monkeypatch):
    """Few copies stay single; many are PORTIONS rows whose weights are their number, dealt out over the cores."""
    df = spark.createDataFrame([(i, "cb often", "x") for i in range(1000)] + [(2000 + i, "prlv seldom", "y") for i in range(30)],
                               "tx_id long, model_text string, category_label string").coalesce(1)
    seen = []

    def fit(self, rows, real=M.RandomForestClassifier._fit):
        seen.append(({r.label: (r.n, r.w) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(M.WEIGHT).alias("w")).collect()},
                     rows.rdd.getNumPartitions(), self.getWeightCol()))
        return real(self, rows)

    monkeypatch.setattr(M.RandomForestClassifier, "_fit", fit)
    fitted = M.train(df, M.forest(trees=3, depth=3), high=2, tree_features=5)
    assert seen == [({0.0: (M.PORTIONS, pytest.approx(1000.0)), 1.0: (30, 30.0)}, 8, M.WEIGHT)]
    assert all(r.model_category == r.category_label for r in fitted.predict(df).distinct().collect())


def test_chi_square_of_weighted_rows(spark):
    single = spark.createDataFrame([(0.0, "ab")] * 6 + [(1.0, "a")] * 3 + [(1.0, "b")], "label double, model_text string")
    ready = M.fit_text_features(single, high=1).transform(single)
    weighted = ready.groupBy("label", "model_text", "features").agg(F.count("*").alias("w"))
    want = {r.feature: r.chi2 for r in M.chi_square(ready).collect()}
    assert {r.feature: r.chi2 for r in M.chi_square(weighted, weight="w").collect()} == pytest.approx(want)


def test_texts_of_single_keys_move_once(spark, monkeypatch):
    """Where no key repeats the term table needs no shuffle by document; repeated keys are counted together."""
    plans = []
    cut = X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name))
    terms = [["a", "b", "a"], ["b", None], [], ["c", "a"]]
    single = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "doc long, t array<string>")
    repeated = spark.createDataFrame([(0, ["a"]), (0, ["b", "a"]), (1, ["b"]), (3, ["c"]), (3, ["a"]), (2, [])], "doc long, t array<string>")
    got, want = ({(r.doc, r.term): (r.tf, r.tfidf) for r in X.tfidf(df, "doc", "t").collect()} for df in (single, repeated))
    assert "hashpartitioning(doc" not in plans[0] and "hashpartitioning(doc" in plans[1]
    n, df = 4, {"a": 2, "b": 2, "c": 1}
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    assert {k: v[0] for k, v in got.items()} == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 1, (3, "a"): 1, (3, "c"): 1} == {k: v[0] for k, v in want.items()}
    assert got[3, "c"][1] == pytest.approx(idf["c"] / math.hypot(idf["c"], idf["a"]))


def _trained_with(monkeypatch, name):
    """What the query ``name`` asks to be trained with."""
    from sparktally.plans.catalogue import models as Q

    asked = []
    monkeypatch.setattr(Q, "prepared", lambda *_: None)
    monkeypatch.setattr(Q, "_scores", lambda _: None)
    monkeypatch.setattr(Q.M, "train_and_validate", lambda _, **options: asked.append(options) or (None, None))
    getattr(Q, name)(None, None)
    return asked[0]


def test_the_forest_is_whole(monkeypatch):
    """All 400 trees, as deep as Spark grows them, on the library's features."""
    options = _trained_with(monkeypatch, "train_forest")
    classifier = options.pop("classifier")
    assert (classifier.getNumTrees(), classifier.getMaxDepth()) == (400, 30) and not options


def test_boosting_is_whole(monkeypatch):
    """300 rounds of depth 6 on the library's features."""
    options = _trained_with(monkeypatch, "train_boosted")
    binary = options.pop("classifier").getClassifier()
    assert (binary.getMaxIter(), binary.getMaxDepth()) == (300, 6) and not options


@pytest.mark.parametrize("low, high, features", [(1, 5, 10_000), (2, 3, 40)])
def test_linear_scores_are_those_of_the_stages(spark, low, high, features):
    """Scores of the linear model without Spark's stages equal theirs, on letters of any range, unknown, empty and missing texts."""
    texts = [("cb shop a", "x"), ("prlv b  b", "y"), ("é𝄞 shop 漢字", "z"), ("a", "y"), ("shop shop shop", "x")]
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(texts * 4)], "tx_id long, model_text string, category_label string")
    model = M.train(df, low=low, high=high, max_features=features)
    others = ["", None, "\t b \n\nshop", "ÿÿ", "\U0010ffff", "cb shop a", "漢字é", "x\x00y"] + [f"shop {i}" for i in range(50)]
    rows = spark.createDataFrame([(t,) for t in others * 3], "model_text string").coalesce(2)
    stages = model.classifier.transform(model.features.transform(rows)).select("model_text", M.vector_to_array("probability").alias("p"))
    want = {r.model_text: r.p for r in stages.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scored = model.probabilities(rows)
        got = [(r.model_text, r.proba) for r in scored.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == rows.count() and all(p == pytest.approx(want[t], abs=1e-12) for t, p in got)
    assert "UDF(counts" not in scored._jdf.queryExecution().executedPlan().toString()


def test_linear_scores_once_and_in_parts(monkeypatch):
    """Texts are cut into portions of CHARACTERS, each scored by itself."""
    import numpy as np

    from sparktally.functions import gram_scores as S

    model = S.GramModel(["a", "ab", "c"], np.array([1.0, 2.0, 3.0]), np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 0.0]]), np.zeros(2))
    texts = ["ab", "", "c" * 9, "abab", "zz"]
    whole = model.probabilities(texts)
    monkeypatch.setattr(S, "CHARACTERS", 3)
    assert model.probabilities(texts).tolist() == whole.tolist() and model.probabilities([]).shape == (0, 2)
    a, ab = 1 / math.hypot(1, 2), 2 / math.hypot(1, 2)
    assert whole[0, 0] == pytest.approx(1 / (1 + math.exp(ab - a))) and whole[1].tolist() == [0.5, 0.5]


def test_the_drift_of_a_model_scores_each_row_once(spark, sf_dir, monkeypatch):
    """The scores are written, so that the summary, which reads them several times, does not score again."""
    from sparktally.plans.catalogue import models as Q

    made = []
    monkeypatch.setattr(Q, "cut_lineage", lambda df, name, cut=Q.cut_lineage: made.append((name, df.columns)) or cut(df, name))
    out = Q.drift_summary_with_model(spark, sf_dir)
    assert made[-1] == ("scored", ["split", "model_text", "model_category", "model_pmax"]) and "PythonUDF" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_model_are_prepared_once(spark, sf_dir, monkeypatch):
    """Training and every prediction read written rows, which no longer cut and mask labels."""
    from sparktally.plans.catalogue import models as Q

    trained = []
    monkeypatch.setattr(Q.M, "train", lambda df, **_: trained.append(df))
    _, rows = Q._trained(spark, sf_dir)
    for df in (rows, *trained):
        assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rows.count() == Q.prepared(spark, sf_dir).count()
