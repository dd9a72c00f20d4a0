"""Trained models, with the library's settings: grams of 1 to 5 characters, up to 200 000 features."""

from pyspark.sql import functions as F

from sparktally.functions import text as T
from sparktally.operators import classify as C
from sparktally.operators import drift as D
from sparktally.operators import evaluate as E
from sparktally.operators import models as M
from sparktally.plans import sqltext as S
from sparktally.plans.catalogue.drift import _MIX, prepared, train
from sparktally.plans.catalogue.features import _tfidf_sql
from sparktally.plans.catalogue.text import PREPARED
from sparktally.plans.fixtures import gazetteer, table, transactions
from sparktally.plans.registry import query
from sparktally.session import cut_lineage, scratch_path


def _scores(preds):
    pairs = E.eval_summary(preds, "category_label", "model_category", "model_pmax", 0.6)
    return pairs.withColumn("classes", F.array_join("classes", ","))


def _trained(spark, sf, **options):
    """The model of the train half, and all prepared rows, written once as several steps read them."""
    rows = cut_lineage(prepared(spark, sf).select("tx_id", "split", "category_label", "model_text"), "prepared")
    return M.train(rows.where(train()), **options), rows


@query("char_tfidf_vectors", f"""{PREPARED}, {_tfidf_sql(
    f'docs AS (SELECT model_text AS doc, COUNT(*) AS copies, {S.ngrams("model_text", 1, 5)} AS terms FROM prepared GROUP BY 1)')},
sums AS (SELECT doc, COUNT(*) AS terms, SUM(w) AS total, MAX(w) AS largest FROM weights GROUP BY doc)
SELECT tx_id, terms, ROUND(total, 6) AS sum_weight, ROUND(largest, 6) AS max_weight FROM prepared JOIN sums ON doc = model_text""")
def char_tfidf_vectors(spark, sf):
    rows = prepared(spark, sf)
    features = M.fit_text_features(rows)
    values = F.unwrap_udt("features")["values"]
    return features.transform(rows).select(
        "tx_id", F.size(values).cast("bigint").alias("terms"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_weight"),
        F.round(F.array_max(values), 6).alias("max_weight"))


@query("train_forest")
def train_forest(spark, sf):
    _, preds = M.train_and_validate(prepared(spark, sf), classifier=M.forest())
    return _scores(preds)


@query("train_boosted")
def train_boosted(spark, sf):
    _, preds = M.train_and_validate(prepared(spark, sf), classifier=M.boosted(parallelism=6))
    return _scores(preds)


@query("calibrate_sigmoid")
def calibrate_sigmoid(spark, sf):
    model, rows = _trained(spark, sf, calibrate="sigmoid")
    return _scores(model.predict(rows.where(~train())))


@query("calibrate_isotonic")
def calibrate_isotonic(spark, sf):
    model, rows = _trained(spark, sf, calibrate="isotonic")
    return _scores(model.predict(rows.where(~train())))


@query("predict")
def predict(spark, sf):
    model, rows = _trained(spark, sf)
    return model.predict(rows).select(
        "tx_id", "model_category", F.round("model_pmax", 6).alias("model_pmax"),
        F.array_join(F.transform("proba", lambda p: F.round(p, 4).cast("string")), ",").alias("proba"))


@query("save_load_model")
def save_load_model(spark, sf):
    model, rows = _trained(spark, sf)
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = M.TextModel.load(spark, path)
    return loaded.predict(rows).select("tx_id", "model_category", F.round("model_pmax", 6).alias("model_pmax"))


@query("classify_with_trained_model")
def classify_with_trained_model(spark, sf):
    model, _ = _trained(spark, sf)
    return C.classify(transactions(spark, sf), gazetteer(spark), model.router_model(), model.labels)


@query("predicted_mix")
def predicted_mix(spark, sf):
    model, rows = _trained(spark, sf)
    return D.category_mix(model.predict(rows.where(~train())), "model_category")


@query("drift_summary_with_model")
def drift_summary_with_model(spark, sf):
    model, rows = _trained(spark, sf)
    scored = cut_lineage(model.predict(rows).select("split", "model_text", "model_category", "model_pmax"), "scored")
    summary = D.drift_summary(scored, train(), label="model_category", conf="model_pmax")
    return summary.select(
        "psi_topk", "oov_rate", "ks_confidence_stat", "ks_confidence_pvalue",
        F.col("largest_label_shift.class").alias("shift_class"), D.any_alert().alias("alert"))


def _document_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_tokens("text").alias("tokens"))


@query("word2vec")
def word2vec(spark, sf):
    model = M.word2vec(_document_tokens(spark, sf), "tokens", size=16, epochs=1, min_count=20, partitions=8)
    return M.pca(model.getVectors().withColumn("v", M.vector_to_array("vector")), "v", 3).select(
        "word", F.size("v").alias("dim"), F.array_join(F.transform("pca", lambda x: F.round(x, 4).cast("string")), ",").alias("pca"))


@query("pca")
def pca(spark, sf):
    return M.pca(table(spark, sf, "embeddings"), "embedding", 3).select(
        "vec_id", F.size("pca").alias("dim"), *[F.round(F.col("pca")[i], 6).alias(f"pc{i + 1}") for i in range(3)])


@query("drift_summary_saved_model", f"""{PREPARED}, {_MIX},
learnt AS (SELECT DISTINCT unnest({S.ngrams("model_text")}) AS gram FROM prepared WHERE split = 'train' AND tx_id % 3 = 0),
texts AS (SELECT model_text AS txt, SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a,
  SUM(CASE WHEN split = 'prod' THEN 1 ELSE 0 END) AS b FROM prepared GROUP BY 1),
grams AS (SELECT unnest({S.ngrams("txt")}) AS gram, a, b FROM texts),
profile AS (SELECT gram, CAST(SUM(a) AS BIGINT) AS n_train, CAST(SUM(b) AS BIGINT) AS n_prod FROM grams GROUP BY 1),
top AS (SELECT * FROM profile JOIN learnt USING (gram) WHERE n_train > 0 ORDER BY n_train DESC, gram LIMIT 500),
shares AS (SELECT n_train / (SUM(n_train) OVER () + 1e-12) AS p, n_prod / (SUM(n_prod) OVER () + 1e-12) AS q FROM top),
psi AS (SELECT SUM((q - p) * ln((q + 1e-12) / (p + 1e-12))) AS psi FROM shares),
oov AS (SELECT 1.0 - (SELECT SUM(n_prod) FROM profile JOIN learnt USING (gram)) / CAST(SUM(n_prod) AS DOUBLE) AS oov_rate FROM profile)
SELECT ROUND(psi, 4) AS psi_topk, ROUND(oov_rate, 4) AS oov_rate, class AS shift_class, ROUND(abs_delta, 4) AS shift_abs_delta,
  psi > 0.2 AS psi_alert, TRUE AS has_ks FROM psi, oov, shift""")
def drift_summary_saved_model(spark, sf):
    """Drift on the vocabulary of a model that saw a third of the training rows, saved and loaded."""
    rows = prepared(spark, sf)
    path = scratch_path(spark, "model")
    M.train(rows.where(train() & (F.col("tx_id") % 3 == 0))).save(path)
    summary = D.drift_summary(rows, train(), model=M.TextModel.load(spark, path))
    return summary.select(
        "psi_topk", "oov_rate", F.col("largest_label_shift.class").alias("shift_class"),
        F.col("largest_label_shift.abs_delta").alias("shift_abs_delta"), F.col("alerts.psi_topk_gt_threshold").alias("psi_alert"),
        (F.col("ks_confidence_stat").between(0, 1) & F.col("ks_confidence_pvalue").between(0, 1)).alias("has_ks"))


@query("model_invariants", """
SELECT COUNT(*) AS rows, COUNT(*) AS sum_to_one, COUNT(*) AS named_by_largest, 0::BIGINT AS loaded_differs,
  COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) AS mix_total FROM orders""")
def model_invariants(spark, sf):
    """What must hold for any model: probabilities sum to one, the category is the likeliest, a loaded model predicts the same, the mix counts all."""
    model, rows = _trained(spark, sf)
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = M.TextModel.load(spark, path)
    mine = model.predict(rows).select("tx_id", "split", "model_category", "model_pmax", "proba")
    both = mine.join(loaded.predict(rows).select("tx_id", F.col("proba").alias("again"), F.col("model_category").alias("category_again")), "tx_id")
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*[F.lit(x) for x in model.labels]), F.array_position("proba", F.array_max("proba")).cast("int"))
    mix = D.category_mix(rows.where(~train()), "category_label").agg(F.sum("n")).scalar()
    predicted = D.category_mix(model.predict(rows.where(~train())), "model_category").agg(F.sum("n")).scalar()
    apart = F.exists(F.zip_with("proba", "again", lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(total - 1) < 1e-9).alias("sum_to_one"),
        F.count_if((best == F.col("model_category")) & (F.col("model_pmax") == F.array_max("proba"))).alias("named_by_largest"),
        F.count_if(apart | (F.col("model_category") != F.col("category_again"))).alias("loaded_differs"),
    ).withColumn("mix_total", F.least(mix, predicted))


@query("calibration_invariants", """
SELECT COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) AS rows, COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) AS sum_to_one, TRUE AS monotone FROM orders""")
def calibration_invariants(spark, sf):
    """Isotonic calibration gives probabilities, and its curves never fall."""
    model, rows = _trained(spark, sf, calibrate="isotonic")
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    curves = [list(c.predictions.toArray()) for c in model.calibrators]
    return model.predict(rows.where(~train())).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(total - 1) < 1e-9).alias("sum_to_one")).withColumn(
        "monotone", F.lit(all(c == sorted(c) for c in curves)))


@query("pca_invariants", """
SELECT COUNT(*) AS rows, TRUE AS centred, TRUE AS uncorrelated, TRUE AS falling FROM embeddings""")
def pca_invariants(spark, sf):
    """Principal components are centred, uncorrelated, and of falling variance."""
    rows = M.pca(table(spark, sf, "embeddings"), "embedding", 3).select(*[F.col("pca")[i].alias(f"p{i}") for i in range(3)])
    figures = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.greatest(*[F.abs(F.avg(f"p{i}")) for i in range(3)]).alias("mean"),
        F.greatest(F.abs(F.corr("p0", "p1")), F.abs(F.corr("p0", "p2")), F.abs(F.corr("p1", "p2"))).alias("corr"),
        *[F.var_pop(f"p{i}").alias(f"v{i}") for i in range(3)])
    return figures.select("rows", (F.col("mean") < 1e-6).alias("centred"), (F.col("corr") < 1e-4).alias("uncorrelated"),
                          ((F.col("v0") >= F.col("v1")) & (F.col("v1") >= F.col("v2"))).alias("falling"))
