"""Drift between two populations of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktally.functions.text import ngram_rows
from sparktally.operators.cumulative import is_number, running_totals, weighted_count
from sparktally.operators.frequent import among_most_frequent, most_frequent
from sparktally.session import cut_lineage

MAX_FEATURES = 200_000
TOP_K = 500
EPSILON = 1e-12


# ------------------------------------------------------------- n-gram counts

def ngram_counts(df: DataFrame, text: str, weights: dict[str, Column] | None = None,
                 vocabulary: DataFrame | None = None, low: int = 1, high: int = 5) -> DataFrame:
    """Corpus counts of character n-grams, one BIGINT column per weight.

    Texts are counted first and split once per distinct text. Both steps
    combine on the map side, so a text or gram that fills a third of the rows
    travels as one partial sum per task.
    """
    weights = weights or {"n": F.lit(1)}
    texts = df.groupBy(F.col(text).alias("_text")).agg(
        *[F.sum(w.cast("bigint")).alias(name) for name, w in weights.items()]
    )
    grams = ngram_rows(texts, list(weights), "_text", low, high)
    counts = grams.groupBy("gram").agg(*[F.sum(name).alias(name) for name in weights])
    if vocabulary is None:
        return counts
    return counts.join(vocabulary.select("gram"), "gram", "left_semi")


def ngram_profile(df: DataFrame, text: str, is_train: Column, low: int = 1, high: int = 5) -> DataFrame:
    """gram, n_train, n_prod for both populations in one pass."""
    train = F.coalesce(is_train, F.lit(False))
    return ngram_counts(df, text, {"n_train": train.cast("int"), "n_prod": (~train).cast("int")}, low=low, high=high)


def stored_profile(df: DataFrame, text: str, is_train: Column, low: int = 1, high: int = 5) -> DataFrame:
    """``ngram_profile``, written once for all that reads it."""
    return cut_lineage(ngram_profile(df, text, is_train, low, high), "profile")


def vocabulary(profile: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent training grams; equal counts go by gram.

    A threshold on the count picks them, so nothing is put in order. ``profile`` is read several times:
    ``stored_profile`` is the one to give.
    """
    return most_frequent(profile.where("n_train > 0"), "n_train", "gram", max_features)


def top_ngrams(profile: DataFrame, k: int = TOP_K) -> DataFrame:
    return profile.where("n_train > 0").orderBy(F.desc("n_train"), "gram").limit(k)


def ngram_deltas(top: DataFrame, n: int = 25) -> DataFrame:
    """The grams whose count moved most between the populations."""
    delta = F.col("n_prod") - F.col("n_train")
    return top.select("gram", delta.alias("delta")).orderBy(F.desc(F.abs("delta")), "gram").limit(n)


def _psi_term(p: Column, q: Column, p_total: Column, q_total: Column) -> Column:
    p = p / (p_total + EPSILON)
    q = q / (q_total + EPSILON)
    return (q - p) * F.ln((q + EPSILON) / (p + EPSILON))


def psi(df: DataFrame, p: str = "n_train", q: str = "n_prod") -> DataFrame:
    """Population stability index of two aligned count columns.

    Both totals come from one subquery that reads the same columns as the sum
    of the terms, so the shuffle below is made once and used by both.
    """
    counts = df.select(F.col(p).cast("double").alias("_p"), F.col(q).cast("double").alias("_q"))
    totals = counts.agg(F.struct(F.sum("_p").alias("p"), F.sum("_q").alias("q"))).scalar()
    term = _psi_term(F.col("_p"), F.col("_q"), totals["p"], totals["q"])
    return counts.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("psi"))


def oov_rate(counts: DataFrame, vocab: DataFrame, n: str = "n_prod") -> DataFrame:
    """Share of gram occurrences that the vocabulary lacks, 0.0 on no grams."""
    known = vocab.select("gram", F.lit(True).alias("_known"))
    missing = F.sum(F.when(F.col("_known").isNull(), F.col(n)).otherwise(0))
    return counts.join(known, "gram", "left").agg(
        F.coalesce(missing / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)).alias("oov_rate")
    )


# --------------------------------------------------------------- two samples

def ks_two_sample(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """Largest distance of the two distribution functions and its asymptotic p-value."""
    known = df.where(is_number(value) & is_first.isNotNull())
    by_value = known.groupBy(F.col(value).alias("v")).agg(
        weighted_count(is_first).alias("a"), weighted_count(~is_first).alias("b")
    )
    totals = running_totals(by_value, "v", ["a", "b"])
    gap = F.abs(F.col("cum_a") / F.nullif("all_a", F.lit(0)) - F.col("cum_b") / F.nullif("all_b", F.lit(0)))
    stat = totals.agg(
        F.max(gap).alias("ks_stat"), F.max("all_a").alias("n_first"), F.max("all_b").alias("n_second")
    )
    return stat.withColumn("ks_pvalue", _ks_pvalue(F.col("ks_stat"), F.col("n_first"), F.col("n_second")))


def _ks_pvalue(stat: Column, n: Column, m: Column) -> Column:
    lam = F.sqrt(n * m / (n + m)) * stat

    def term(total: Column, j: Column) -> Column:
        sign = F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return total + sign * F.exp(F.lit(-2.0) * j * j * lam * lam)

    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def histogram(df: DataFrame, value: str, is_train: Column, bins: int = 30) -> DataFrame:
    """Equal-width bins of each population over its own range, empty ones included; the last bin is closed."""
    v = F.col(value).cast("double")
    sides = df.where(is_number(value)).select(
        F.when(is_train, "train").otherwise("prod").alias("side"), v.alias("v")
    )
    ranges = sides.groupBy("side").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    slot = F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    bin_no = F.least(F.lit(bins - 1), F.coalesce(slot, F.lit(0))).cast("bigint")
    # two rows: one range per population
    counts = (
        sides.join(F.broadcast(ranges), "side")
        .groupBy("side", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    grid = ranges.select("side", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return grid.join(counts, ["side", "bin"], "left").select("side", "bin", F.coalesce("n", F.lit(0)).alias("n"))


# -------------------------------------------------------------- category mix

def category_mix(df: DataFrame, label: str) -> DataFrame:
    """Share of every label; a missing label is a class of its own."""
    counts = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def largest_shift(train_mix: DataFrame, prod_mix: DataFrame) -> DataFrame:
    """The class whose share moved most, the first by name on ties."""
    both = train_mix.select("class", F.col("share").alias("train")).join(
        prod_mix.select("class", F.col("share").alias("prod")), "class", "full_outer"
    )
    both = both.select(
        "class", F.coalesce("train", F.lit(0.0)).alias("train"), F.coalesce("prod", F.lit(0.0)).alias("prod")
    )
    return both.withColumn("abs_delta", F.abs(F.col("prod") - F.col("train"))).orderBy(
        F.desc("abs_delta"), "class").limit(1)


# ------------------------------------------------------------------- summary

def profile_summary(profile: DataFrame, k: int = TOP_K, max_features: int = MAX_FEATURES,
                    vocabulary: DataFrame | None = None) -> DataFrame:
    """One row: psi_topk, oov_rate of a stored profile (gram, n_train, n_prod).

    The vocabulary is that of the training counts, or the grams of ``vocabulary``, to which the top grams are then confined.
    """
    if vocabulary is None:
        known = profile
        inside = (F.col("n_train") > 0) & F.coalesce(
            among_most_frequent(profile.where("n_train > 0"), "n_train", "gram", max_features), F.lit(False))
    else:
        listed = vocabulary.select("gram", F.lit(True).alias("_known"))
        profile = cut_lineage(profile.join(listed, "gram", "left"), "profile")
        inside = F.coalesce("_known", F.lit(False))
        known = profile.where(inside)
    best = (F.col("n_train") > 0) & F.coalesce(
        among_most_frequent(known.where("n_train > 0"), "n_train", "gram", k), F.lit(False))
    marks = profile.select("n_train", "n_prod", (inside & best).alias("_top"), inside.alias("_in"))
    totals = marks.agg(
        F.sum(F.when(F.col("_top"), F.col("n_train"))).cast("double").alias("p"),
        F.sum(F.when(F.col("_top"), F.col("n_prod"))).cast("double").alias("q"),
        F.sum(F.when(F.col("_in"), F.col("n_prod"))).alias("known"), F.sum("n_prod").alias("prod")).first()
    term = _psi_term(F.col("n_train"), F.col("n_prod"), F.lit(totals["p"]).cast("double"), F.lit(totals["q"]).cast("double"))
    held = totals["known"] if vocabulary is None else totals["known"] or 0
    found, prod = F.lit(held).cast("bigint"), F.lit(totals["prod"]).cast("bigint")
    return marks.agg(
        F.coalesce(F.sum(F.when(F.col("_top"), term)), F.lit(0.0)).alias("psi_topk"),
    ).select("psi_topk", F.coalesce(1.0 - found / F.nullif(prod, F.lit(0)), F.lit(0.0)).alias("oov_rate"))


_SHIFT = "struct<class:string,train:double,prod:double,abs_delta:double>"


def drift_summary(df: DataFrame, is_train: Column, text: str = "model_text", label: str | None = "category_label",
                  conf: str | None = None, k: int = TOP_K, max_features: int = MAX_FEATURES,
                  psi_alert: float = 0.20, shift_alert: float = 0.15, digits: int | None = 4, model=None) -> DataFrame:
    """One row: psi_topk, oov_rate, KS of the confidence, largest shift, alerts, thresholds.

    The n-gram profile is counted and written once. Thresholds on its counts mark the vocabulary and the
    top grams, and all figures are sums over the profile, so no task holds or orders a vocabulary.

    With a ``model`` (``models.TextModel``) the vocabulary and the sizes of the grams are the model's own, and unless ``conf`` names a
    column, one prediction of all rows gives the confidences and, where there is no ``label``, the categories.
    """
    train = F.coalesce(is_train, F.lit(False))
    if model is None:
        out = profile_summary(stored_profile(df, text, train), k, max_features)
    else:
        low, high = model.metadata.get("ngram_range", (1, 5))
        out = profile_summary(stored_profile(df, text, train, low, high), k, vocabulary=model.vocabulary(df.sparkSession))
        if conf is None:
            conf = "model_pmax"
            wanted = list(dict.fromkeys([conf, label or "model_category"]))
            df = cut_lineage(model.predict(df.withColumn("_train", train)).select("_train", *wanted), "predicted")
            train, label = F.col("_train"), label or "model_category"

    if conf is not None:
        ks = ks_two_sample(df, conf, train)
        ks = ks.select(F.struct("ks_stat", "ks_pvalue")).scalar()
        out = out.withColumn("_ks", ks)
    else:
        out = out.withColumn("_ks", F.lit(None).cast("struct<ks_stat:double,ks_pvalue:double>"))
    if label is not None:
        shift = _shift_between(df, label, train).select(F.struct("class", "train", "prod", "abs_delta")).scalar()
        out = out.withColumn("_shift", shift)
    else:
        out = out.withColumn("_shift", F.lit(None).cast(_SHIFT))
    return out.select(*report_columns(psi_alert, shift_alert, digits))


def report_columns(psi_alert: float = 0.20, shift_alert: float = 0.15, digits: int | None = 4) -> list[Column]:
    """The report from psi_topk, oov_rate, ``_ks`` (ks_stat, ks_pvalue) and ``_shift`` (class, train, prod, abs_delta)."""

    def rounded(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    moved = F.coalesce(F.col("_shift.abs_delta"), F.lit(0.0))
    return [
        rounded(F.col("psi_topk")).alias("psi_topk"),
        rounded(F.col("oov_rate")).alias("oov_rate"),
        rounded(F.col("_ks.ks_stat")).alias("ks_confidence_stat"),
        F.col("_ks.ks_pvalue").alias("ks_confidence_pvalue"),
        F.when(moved > 0, F.struct(
            F.col("_shift.class").alias("class"), rounded(F.col("_shift.train")).alias("train"),
            rounded(F.col("_shift.prod")).alias("prod"), rounded(moved).alias("abs_delta"),
        )).alias("largest_label_shift"),
        F.struct(
            (F.col("psi_topk") > psi_alert).alias("psi_topk_gt_threshold"),
            (moved > shift_alert).alias("label_shift_gt_threshold"),
        ).alias("alerts"),
        F.struct(F.lit(psi_alert).alias("psi_alert"), F.lit(shift_alert).alias("shift_alert")).alias("thresholds"),
    ]


def _shift_between(df: DataFrame, label: str, train: Column) -> DataFrame:
    """Largest shift from one count of both populations."""
    counts = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("class")).agg(
        weighted_count(train).alias("a"), weighted_count(~train).alias("b")
    )
    totals = counts.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    share = {
        name: F.coalesce(F.col(n) / F.nullif(totals[n], F.lit(0)), F.lit(0.0)).alias(name)
        for name, n in (("train", "a"), ("prod", "b"))
    }
    return (
        counts.select("class", *share.values())
        .withColumn("abs_delta", F.abs(F.col("prod") - F.col("train")))
        .orderBy(F.desc("abs_delta"), "class").limit(1)
    )


def any_alert(alerts: str = "alerts") -> Column:
    return (
        F.coalesce(F.col(f"{alerts}.psi_topk_gt_threshold"), F.lit(False))
        | F.coalesce(F.col(f"{alerts}.label_shift_gt_threshold"), F.lit(False))
    )


def drift_alert_count(summaries: DataFrame, ts: str) -> DataFrame:
    """Number of summaries with any alert, and the latest gauges."""
    return summaries.agg(
        F.count_if(any_alert()).alias("drift_alerts_total"),
        F.max_by("psi_topk", ts).alias("psi_topk"),
        F.max_by("oov_rate", ts).alias("oov_rate"),
    )
