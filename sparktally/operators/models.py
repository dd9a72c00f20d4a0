"""Text classifiers: features, training, calibration, prediction, storage."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, LogisticRegressionModel, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import (
    PCA, CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer,
    StandardScaler, StringIndexer, VectorSlicer, Word2Vec,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktally.functions.gram_scores import GramModel, gram_probabilities
from sparktally.functions.text import BLANKS_TO_ONE, char_ngrams, ngram_rows
from sparktally.functions.vectors import as_doubles
from sparktally.operators.features import MAX_FEATURES, stratified_split
from sparktally.operators.frequent import most_frequent, text_counts
from sparktally.session import cut_lineage

#: The blank pattern with its backslashes doubled for SQL text.
BLANKS_TO_ONE_SQL = BLANKS_TO_ONE.replace("\\", "\\\\")

TEXT, LABEL, FEATURES = "model_text", "category_label", "features"
#: Columns of training rows: for how many equal rows one stands, and its part in calibration.
WEIGHT, FOLD, FOLDS = "_weight", "_fold", 3
#: Features that trees are grown on, picked by chi-square.
TREE_FEATURES = 2_000
#: Bins of a score for isotonic calibration.
SCORE_BINS = 4_096
#: Training rows of one partition at most, on average.
PARTITION_ROWS = 50_000
#: Rows that stand for equal ones where a classifier draws rows: up to so many stay single.
PORTIONS = 100


def _gram_stage(text: str, low: int, high: int) -> SQLTransformer:
    """Character n-grams as a stage, so that a saved pipeline is complete."""
    return SQLTransformer(statement=(
        f"SELECT *, transform(array(regexp_replace({text}, '{BLANKS_TO_ONE_SQL}', ' ')), t -> "
        f"flatten(transform(sequence({low}, {high}), n -> CASE WHEN length(t) >= n "
        f"THEN transform(sequence(1, length(t) - n + 1), i -> substring(t, i, n)) "
        f"ELSE array() END)))[0] AS grams FROM __THIS__"
    ))


def fit_text_features(df: DataFrame, text: str = TEXT, low: int = 1, high: int = 5,
                      max_features: int = MAX_FEATURES) -> PipelineModel:
    """n-grams -> counts of the most frequent -> tf * (idf + 1) -> unit length, idf = ln((1 + n) / (1 + df)).

    Equal texts are cut once. One aggregation, combined before it travels, counts occurrences and texts of every gram; a
    threshold picks the most frequent, equal counts by gram. Only the picked grams reach the driver, as the model holds them.
    """
    texts = cut_lineage(text_counts(df, text), "texts")
    rows = texts.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    cut = ngram_rows(texts, ["_copies"], "_text", low, high, first="_first")
    known = cut_lineage(cut.groupBy("gram").agg(
        F.sum("_copies").alias("n"), F.sum(F.when(F.col("_first"), F.col("_copies")).otherwise(0)).alias("df")), "grams")
    picked = sorted(most_frequent(known, "n", "gram", max_features).collect(), key=lambda r: (-r["n"], r["gram"]))
    if not picked:
        raise ValueError("the texts hold no n-grams")
    counter = CountVectorizerModel.from_vocabulary([r["gram"] for r in picked], inputCol="grams", outputCol="counts")
    idf = [math.log((rows + 1.0) / (r["df"] + 1.0)) + 1.0 for r in picked]
    weights = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted")
    return PipelineModel([
        _gram_stage(text, low, high), counter, weights, Normalizer(p=2.0, inputCol="weighted", outputCol=FEATURES)])


def linear(strength: float = 1e-4, rounds: int = 100) -> LogisticRegression:
    """Multinomial logistic regression on all features, which stay sparse."""
    return LogisticRegression(featuresCol=FEATURES, labelCol="label", family="multinomial", regParam=strength, maxIter=rounds)


def chi_square(df: DataFrame, features: str = FEATURES, label: str = "label", weight: str | None = None) -> DataFrame:
    """feature, chi2: how unevenly the weight of each feature falls on the classes.

    Observed are the sums of a feature's values by class, expected its whole sum times the class's share of rows.
    All sums are of entries that are there, combined before they travel; a feature without any has no row.
    ``weight`` is the number of rows that one stands for.
    """
    times = F.col(weight) if weight else F.lit(1.0)
    entries = df.select(label, times.alias("_times"), F.explode(F.arrays_zip(
        F.unwrap_udt(features)["indices"].alias("i"), F.unwrap_udt(features)["values"].alias("v"))).alias("e"))
    observed = entries.groupBy(F.col("e.i").alias("feature"), label).agg(F.sum(F.col("e.v") * F.col("_times")).alias("o"))
    shares = df.groupBy(label).agg(F.sum(times).alias("n"))
    total = shares.agg(F.sum("n")).scalar()
    share = shares.select(label, (F.col("n") / total).alias("share"))  # one row per class
    # sum over classes of (o - e)^2 / e, e = share * whole: sum of o^2 / (share * whole), less whole
    parts = observed.join(share, label).groupBy("feature").agg(
        F.sum("o").alias("whole"), F.sum(F.col("o") * F.col("o") / F.col("share")).alias("squares"))
    return parts.select("feature", (F.col("squares") / F.col("whole") - F.col("whole")).alias("chi2"))


def best_features(df: DataFrame, k: int = TREE_FEATURES, features: str = FEATURES, label: str = "label",
                  weight: str | None = None) -> list[int]:
    """The ``k`` features of largest chi-square, in order of their numbers; equal ones go by number."""
    scored = cut_lineage(chi_square(df, features, label, weight).select(
        F.round(F.greatest(F.col("chi2"), F.lit(0.0)) * 1e6).cast("bigint").alias("score"), F.lpad(F.col("feature").cast("string"), 12, "0").alias("name")), "chi2")
    return sorted(int(r["name"]) for r in most_frequent(scored, "score", "name", k).select("name").collect())


def forest(trees: int = 400, depth: int = 30, seed: int = 42) -> RandomForestClassifier:
    """Random forest; 30 is the deepest tree that Spark grows."""
    return RandomForestClassifier(featuresCol=FEATURES, labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(rounds: int = 300, depth: int = 6, rate: float = 0.1, seed: int = 42, parallelism: int = 2) -> OneVsRest:
    """Gradient-boosted trees, one binary ensemble per class."""
    binary = GBTClassifier(
        featuresCol=FEATURES, labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate,
        subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
    return OneVsRest(classifier=binary, featuresCol=FEATURES, labelCol="label", parallelism=parallelism)


@dataclass
class TextModel:
    """Fitted features, classifier, labels and, optionally, calibrators."""

    features: PipelineModel
    classifier: object
    labels: list[str]
    metadata: dict = field(default_factory=dict)
    calibrators: list = field(default_factory=list)

    # ------------------------------------------------------------ prediction
    def probabilities(self, df: DataFrame) -> DataFrame:
        """Add ``proba``: one probability per label. The linear model scores equal texts of a task once, without Spark's stages."""
        linear_parts = _linear_on_grams(self.features, self.classifier)
        if linear_parts:
            model, text = linear_parts
            scored = df
            proba = gram_probabilities(df.sparkSession, model, F.regexp_replace(text, BLANKS_TO_ONE, " "))
        else:
            scored = self.classifier.transform(self.features.transform(df))
            if "probability" in scored.columns:
                proba = vector_to_array("probability")
            else:  # margins of one ensemble per class
                sigmoid = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
                proba = _normalized(sigmoid)
        # decided once: the columns below read it several times
        out = scored.withColumn("proba", proba).select(*df.columns, "proba")
        return _calibrated(out, self.calibrators) if self.calibrators else out

    def predict(self, df: DataFrame) -> DataFrame:
        """Add proba, model_category (first largest) and model_pmax."""
        names = F.array(*[F.lit(label) for label in self.labels])
        out = self.probabilities(df).withColumn("model_pmax", F.array_max("proba"))
        best = F.array_position("proba", F.col("model_pmax")).cast("int")
        return out.withColumn("model_category", F.get(names, best - 1))

    def with_oov(self, df: DataFrame, text: str = "masked") -> DataFrame:
        """Add ``model_oov``: share of n-grams the vocabulary lacks, 1.0 without any.

        The counter keeps known grams only, so the sum of its counts over
        their number gives the rate with neither explode nor join.
        """
        counter = next(s for s in self.features.stages if isinstance(s, CountVectorizerModel))
        split = df.withColumn("_grams", char_ngrams(text, *self.metadata.get("ngram_range", (1, 5))))
        copy = counter.copy({counter.inputCol: "_grams", counter.outputCol: "_seen"})
        seen = F.aggregate(F.unwrap_udt("_seen")["values"], F.lit(0.0), lambda acc, x: acc + x)
        rate = F.coalesce(1.0 - seen / F.nullif(F.size("_grams"), F.lit(0)), F.lit(1.0))
        return copy.transform(split).withColumn("model_oov", rate).drop("_grams", "_seen")

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """gram: the n-grams that the model knows, as many as it was fitted with at most."""
        counter = next(s for s in self.features.stages if isinstance(s, CountVectorizerModel))
        return spark.createDataFrame([(g,) for g in counter.vocabulary], "gram string")

    def router_model(self) -> Callable[[DataFrame], DataFrame]:
        """The form that the router expects."""
        return lambda df: self.predict(self.with_oov(df)).drop("proba")

    # --------------------------------------------------------------- storage
    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        PipelineModel([self.classifier]).write().overwrite().save(f"{path}/classifier")
        for i, calibrator in enumerate(self.calibrators):
            calibrator.write().overwrite().save(f"{path}/calibrator-{i}")
        spark = SparkSession.getActiveSession()
        rows = [(list(self.labels), {k: str(v) for k, v in self.metadata.items()}, len(self.calibrators))]
        spark.createDataFrame(rows, "labels array<string>, metadata map<string,string>, calibrators int").coalesce(
            1).write.mode("overwrite").json(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        meta = spark.read.schema(
            "labels array<string>, metadata map<string,string>, calibrators int").json(f"{path}/metadata").first()
        metadata = dict(meta["metadata"])
        if "ngram_range" in metadata:
            metadata["ngram_range"] = tuple(int(x) for x in metadata["ngram_range"].strip("()").split(","))
        kind = LogisticRegressionModel if metadata.get("calibrate") == "sigmoid" else IsotonicRegressionModel
        return cls(
            PipelineModel.load(f"{path}/features"), PipelineModel.load(f"{path}/classifier").stages[0],
            list(meta["labels"]), metadata,
            [kind.load(f"{path}/calibrator-{i}") for i in range(meta["calibrators"])],
        )


def _linear_on_grams(features: PipelineModel, classifier) -> tuple[GramModel, str] | None:
    """What the stages of ``fit_text_features`` and a multinomial model compute, with the name of the text; None for any other stages."""
    kinds = [SQLTransformer, CountVectorizerModel, ElementwiseProduct, Normalizer]
    if [type(s) for s in features.stages] != kinds or not isinstance(classifier, LogisticRegressionModel):
        return None
    grams, counter, weights, unit = features.stages
    asked = re.search(r"regexp_replace\((\w+), .*sequence\((\d+), (\d+)\), n ", grams.getStatement())
    if not asked or _gram_stage(asked[1], int(asked[2]), int(asked[3])).getStatement() != grams.getStatement():
        return None
    coefficients, intercepts = classifier.coefficientMatrix.toArray(), classifier.interceptVector.toArray()
    if counter.getBinary() or counter.getMinTF() != 1.0 or unit.getP() != 2.0 or not len(counter.vocabulary):
        return None
    if not 2 <= classifier.numClasses == len(coefficients) or not np.isfinite(intercepts).all():
        return None
    return GramModel(list(counter.vocabulary), weights.getScalingVec().toArray(), coefficients, intercepts), asked[1]


def _normalized(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > 0, F.transform(values, lambda x: x / total)).otherwise(
        F.transform(values, lambda x: F.lit(1.0) / F.size(values)))


# ------------------------------------------------------------------- training

def train(df: DataFrame, classifier=None, text: str = TEXT, label: str = LABEL, low: int = 1, high: int = 5,
          max_features: int = MAX_FEATURES, calibrate: str = "none", key: str = "tx_id",
          metadata: dict | None = None, tree_features: int = TREE_FEATURES) -> TextModel:
    """Fit features, classifier and, if asked for, calibrators on labelled rows.

    Without a ``classifier`` it is ``linear()``, which takes all features. Any other gets the ``tree_features`` that tell the
    classes apart best, as trees look at every feature for every node. The linear model gets equal rows once, with their number as weight.
    Others draw rows, so equal ones stay single up to ``PORTIONS``; more are that many portions of equal weight, each drawn by itself, so the part that
    such a text gets in a tree varies by a tenth around its own. Trees hold each row dense, so this bounds what they keep and read.
    """
    if calibrate not in ("none", "sigmoid", "isotonic"):
        raise ValueError("calibrate is 'none', 'sigmoid' or 'isotonic'")
    classifier = classifier or linear()
    features = fit_text_features(df.select(text), text, low, high, max_features)
    indexer = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(df)
    labels = list(indexer.labels)
    columns = ["label", FEATURES, WEIGHT, *([FOLD] if calibrate != "none" else [])]
    rows = df.withColumn(FOLD, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FOLDS)))
    portions = 1 if isinstance(classifier, LogisticRegression) else PORTIONS
    if not classifier.hasParam("weightCol"):
        portions = None
    rows = _equal_rows(rows, [text, label, *columns[3:]], portions)
    ready = indexer.transform(features.transform(rows)).select(*columns).persist()
    if not isinstance(classifier, LogisticRegression) and len(features.stages[1].vocabulary) > tree_features:
        chosen = best_features(ready, tree_features, weight=WEIGHT)
        slicer = VectorSlicer(inputCol="_all", outputCol=FEATURES, indices=chosen)
        features.stages[-1].setOutputCol("_all")
        features = PipelineModel([*features.stages, slicer])
        whole, ready = ready, slicer.transform(ready.withColumnRenamed(FEATURES, "_all")).select(*columns).persist()
        whole.unpersist()
    try:
        calibrators = _fit_calibrators(ready, classifier, labels, calibrate) if calibrate != "none" else []
        fitted = _fit(classifier, ready)
    finally:
        ready.unpersist()
    meta = {"ngram_range": (low, high), "max_features": max_features, "calibrate": calibrate, **(metadata or {})}
    return TextModel(features, fitted, labels, meta, calibrators)


def train_and_validate(df: DataFrame, val: float = 0.2, seed: int = 42, key: str = "tx_id",
                       label: str = LABEL, **options) -> tuple[TextModel, DataFrame]:
    """A model of the train part and its predictions on the val part."""
    split = stratified_split(df, key, label, val, seed)
    model = train(split.where("part = 'train'"), label=label, key=key,
                  metadata={"val_size": val, "seed": seed}, **options)
    return model, model.predict(split.where("part = 'val'"))


def _equal_rows(df: DataFrame, columns: list[str], portions: int | None = 1) -> DataFrame:
    """At most ``portions`` rows for all that are equal, their WEIGHT together the number of those; without a bound each stays.

    They are dealt out so that all cores have some and no task more than it can hold.
    """
    counted = cut_lineage(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "rows")
    parts = F.col("_n") if portions is None else F.least(F.col("_n"), F.lit(portions))
    total = counted.agg(F.coalesce(F.sum(parts), F.lit(0))).first()[0]
    dealt = counted.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_ROWS)))
    rows = dealt.withColumn(WEIGHT, F.col("_n").cast("double") / parts)
    if portions != 1:
        rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), parts.cast("int"))))
    return rows.drop("_n")


def _fit(classifier, rows: DataFrame):
    """The classifier on weighted rows, as if every row stood there as often as its weight says.

    Spark's penalty is on coefficients of features in units of their deviation. Its weighted variance divides by W - Q / W (sums of weights
    and of their squares), that of the single rows by W - 1: one factor for all features, which the penalty takes back.
    """
    if not isinstance(classifier, LogisticRegression):
        return classifier.copy({classifier.weightCol: WEIGHT} if classifier.hasParam("weightCol") else {}).fit(rows)
    w, q = rows.agg(F.sum(WEIGHT), F.sum(F.col(WEIGHT) * F.col(WEIGHT))).first()
    options = {classifier.weightCol: WEIGHT}
    if classifier.getStandardization() and classifier.getRegParam() > 0 and w * w > q:
        factor = (w - 1.0) / (w - q / w)
        strength, mix = classifier.getRegParam(), classifier.getElasticNetParam()
        first, second = strength * mix / math.sqrt(factor), strength * (1.0 - mix) / factor
        options |= {classifier.regParam: first + second, classifier.elasticNetParam: first / (first + second)}
    return classifier.copy(options).fit(rows)


def _fit_calibrators(ready: DataFrame, classifier, labels: list[str], method: str) -> list:
    """One calibrator per class, on scores each fold got from a model of the others."""
    scored = None
    for i in range(FOLDS):
        fitted = _fit(classifier, ready.where(F.col(FOLD) != i))
        unseen = TextModel(PipelineModel([]), fitted, labels).probabilities(ready.where(F.col(FOLD) == i))
        scored = unseen if scored is None else scored.unionByName(unseen)
    scored = scored.select("label", "proba", WEIGHT).persist()
    try:
        return [_fit_one(scored, i, method) for i in range(len(labels))]
    finally:
        scored.unpersist()


def _fit_one(scored: DataFrame, index: int, method: str):
    score = F.get("proba", F.lit(index))
    rows = scored.select(
        (F.col("label") == index).cast("double").alias("target"), score.alias("score"),
        array_to_vector(F.array(score)).alias("score_vector"), (F.col(WEIGHT) if WEIGHT in scored.columns else F.lit(1.0)).alias(WEIGHT))
    if method == "sigmoid":
        return LogisticRegression(featuresCol="score_vector", labelCol="target", weightCol=WEIGHT).fit(rows)

    def mean(c: str) -> Column:
        return F.sum(F.col(c) * F.col(WEIGHT)) / F.sum(WEIGHT)

    # neighbouring violators are pooled over bins, so however many rows there are, a bounded number is put in order
    bins = rows.groupBy(F.least(F.floor(F.col("score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).alias("bin")).agg(
        mean("target").alias("target"), mean("score").alias("score"), F.sum(WEIGHT).alias("weight"))
    return IsotonicRegression(featuresCol="score", labelCol="target", weightCol="weight").fit(bins)


def _calibrated(df: DataFrame, calibrators: list) -> DataFrame:
    """Replace ``proba`` by calibrated, renormalised probabilities."""
    keep = df.columns
    for i, calibrator in enumerate(calibrators):
        if isinstance(calibrator, LogisticRegressionModel):
            margin = calibrator.intercept + float(calibrator.coefficients[0]) * F.get("proba", F.lit(i))
            df = df.withColumn(f"_p{i}", 1.0 / (1.0 + F.exp(-margin)))
        else:
            df = df.withColumn("_v", array_to_vector(F.array(F.get("proba", F.lit(i)))))
            copy = calibrator.copy({calibrator.featuresCol: "_v", calibrator.predictionCol: f"_p{i}"})
            df = copy.transform(df).drop("_v")
    values = F.array(*[F.col(f"_p{i}") for i in range(len(calibrators))])
    return df.withColumn("proba", _normalized(values)).select(*keep)


# --------------------------------------------------------------- embeddings

def word2vec(df: DataFrame, tokens: str, size: int = 100, window: int = 5, min_count: int = 1,
             epochs: int = 200, seed: int = 42, partitions: int | None = None):
    """Skip-gram word vectors; the model's ``getVectors()`` holds one row per word.

    Training runs in ``partitions`` parts (all cores if not given), whose vectors
    are merged after every epoch; Spark's own default of one part would
    pass the whole corpus through one task.
    """
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    return Word2Vec(
        inputCol=tokens, outputCol="document_vector", vectorSize=size, windowSize=window, minCount=min_count,
        maxIter=epochs, seed=seed, numPartitions=partitions).fit(df)


def pca(df: DataFrame, vector: str, k: int = 3, output: str = "pca") -> DataFrame:
    """Add the first ``k`` principal components of the centred vectors, as an array."""
    prepared = df.withColumn("_v", array_to_vector(as_doubles(vector)))
    steps = Pipeline(stages=[
        StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_centred"),
        PCA(k=k, inputCol="_centred", outputCol="_pca"),
    ])
    projected = steps.fit(prepared).transform(prepared)
    return projected.select(*df.columns, vector_to_array("_pca").alias(output))
