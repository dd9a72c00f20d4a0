"""Drift between the train and prod halves of the transactions."""

from pyspark.sql import functions as F

from sparktally.functions import text as T
from sparktally.operators import drift as D
from sparktally.plans import sqltext as S
from sparktally.plans.catalogue.text import PREPARED
from sparktally.plans.fixtures import WITH_TX, table, transactions
from sparktally.plans.registry import query


def train():
    return F.col("split") == "train"


def prepared(spark, sf):
    return T.preprocess(transactions(spark, sf)).withColumn("model_text", T.model_text())


def profile(spark, sf):
    return D.stored_profile(prepared(spark, sf), "model_text", train())


def _profile_sql(text: str) -> str:
    return f"""{PREPARED},
texts AS (SELECT {text} AS txt, SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a,
  SUM(CASE WHEN split = 'prod' THEN 1 ELSE 0 END) AS b FROM prepared GROUP BY 1),
grams AS (SELECT unnest({S.ngrams("txt")}) AS gram, a, b FROM texts),
profile AS (SELECT gram, CAST(SUM(a) AS BIGINT) AS n_train, CAST(SUM(b) AS BIGINT) AS n_prod FROM grams GROUP BY 1),
vocab AS (SELECT * FROM profile WHERE n_train > 0 ORDER BY n_train DESC, gram LIMIT 200000),
top AS (SELECT * FROM profile WHERE n_train > 0 ORDER BY n_train DESC, gram LIMIT 500),
shares AS (SELECT n_train / (SUM(n_train) OVER () + 1e-12) AS p, n_prod / (SUM(n_prod) OVER () + 1e-12) AS q FROM top),
psi AS (SELECT SUM((q - p) * ln((q + 1e-12) / (p + 1e-12))) AS psi FROM shares),
oov AS (SELECT 1.0 - (SELECT SUM(n_prod) FROM vocab) / CAST(SUM(n_prod) AS DOUBLE) AS oov_rate FROM profile)"""


PROFILE = _profile_sql("model_text")


@query("ngram_counts", f"{PROFILE} SELECT gram, n_train, n_prod FROM profile")
def ngram_counts(spark, sf):
    return profile(spark, sf)


@query("ngram_counts_in_vocabulary", f"{PROFILE} SELECT gram, n_prod AS n FROM top WHERE n_prod > 0")
def ngram_counts_in_vocabulary(spark, sf):
    top = D.top_ngrams(profile(spark, sf))
    return D.ngram_counts(prepared(spark, sf).where(~train()), "model_text", vocabulary=top)


@query("top_ngrams", f"{PROFILE} SELECT gram, n_train, n_prod FROM top")
def top_ngrams(spark, sf):
    return D.top_ngrams(profile(spark, sf))


@query("psi", f"{PROFILE} SELECT ROUND(psi, 6) AS psi FROM psi")
def psi(spark, sf):
    return D.psi(D.top_ngrams(profile(spark, sf))).select(F.round("psi", 6).alias("psi"))


@query("psi_normalized_text", f"{_profile_sql('normalized')} SELECT ROUND(psi, 6) AS psi FROM psi")
def psi_normalized_text(spark, sf):
    counts = D.ngram_profile(prepared(spark, sf), "normalized", train())
    return D.psi(D.top_ngrams(counts)).select(F.round("psi", 6).alias("psi"))


@query("oov_rate", f"{PROFILE} SELECT ROUND(oov_rate, 6) AS oov_rate FROM oov")
def oov_rate(spark, sf):
    counts = profile(spark, sf)
    return D.oov_rate(counts, D.vocabulary(counts)).select(F.round("oov_rate", 6).alias("oov_rate"))


_KS = """by_value AS (SELECT {v} AS v, SUM(CASE WHEN {first} THEN 1 ELSE 0 END) AS a,
  SUM(CASE WHEN {first} THEN 0 ELSE 1 END) AS b FROM {src} WHERE {v} IS NOT NULL GROUP BY 1),
cum AS (SELECT SUM(a) OVER (ORDER BY v) AS ca, SUM(b) OVER (ORDER BY v) AS cb,
  SUM(a) OVER () AS na, SUM(b) OVER () AS nb FROM by_value),
ks AS (SELECT MAX(abs(ca / CAST(na AS DOUBLE) - cb / CAST(nb AS DOUBLE))) AS ks_stat,
  CAST(MAX(na) AS BIGINT) AS n_first, CAST(MAX(nb) AS BIGINT) AS n_second FROM cum)"""


@query("ks_two_sample", f"""WITH {_KS.format(v="value", first="event_type = 'click'", src="events")},
lam AS (SELECT *, sqrt(CAST(n_first AS DOUBLE) * n_second / (n_first + n_second)) * ks_stat AS l FROM ks)
SELECT ROUND(ks_stat, 9) AS ks_stat, n_first, n_second, ROUND(CASE WHEN l < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0,
  (SELECT SUM(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * l * l)) FROM range(1, 101) t(j))
  )) END, 6) AS ks_pvalue FROM lam""")
def ks_two_sample(spark, sf):
    return D.ks_two_sample(table(spark, sf, "events"), "value", F.col("event_type") == "click").select(
        F.round("ks_stat", 9).alias("ks_stat"), "n_first", "n_second", F.round("ks_pvalue", 6).alias("ks_pvalue"))


_MIX = """mix AS (SELECT split, category_label AS class, COUNT(*) AS n,
  COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY split) AS DOUBLE) AS share FROM tx GROUP BY 1, 2),
shift AS (SELECT coalesce(a.class, b.class) AS class, coalesce(a.share, 0) AS train, coalesce(b.share, 0) AS prod,
  abs(coalesce(b.share, 0) - coalesce(a.share, 0)) AS abs_delta
  FROM (SELECT * FROM mix WHERE split = 'train') a FULL OUTER JOIN (SELECT * FROM mix WHERE split = 'prod') b
  ON a.class = b.class ORDER BY abs_delta DESC, 1 LIMIT 1)"""


@query("category_mix", f"{WITH_TX}, {_MIX} SELECT class, n, share FROM mix WHERE split = 'train'")
def category_mix(spark, sf):
    return D.category_mix(transactions(spark, sf).where(train()), "category_label")


@query("category_mix_labels", """
SELECT CAST(quality AS VARCHAR) AS class, COUNT(*) AS n, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share
FROM labels GROUP BY quality""")
def category_mix_labels(spark, sf):
    return D.category_mix(table(spark, sf, "labels"), "quality")


@query("largest_shift", f"{WITH_TX}, {_MIX} SELECT class, train, prod, abs_delta FROM shift")
def largest_shift(spark, sf):
    tx = transactions(spark, sf)
    return D.largest_shift(
        D.category_mix(tx.where(train()), "category_label"), D.category_mix(tx.where(~train()), "category_label"))


@query("ngram_deltas", f"""{PROFILE}
SELECT gram, n_prod - n_train AS delta FROM top ORDER BY abs(n_prod - n_train) DESC, gram LIMIT 25""")
def ngram_deltas(spark, sf):
    return D.ngram_deltas(D.top_ngrams(profile(spark, sf)))


@query("histogram", f"""{WITH_TX},
v AS (SELECT split, CASE WHEN tx_id % 11 <> 0 THEN conf * conf * conf END AS conf FROM tx),
r AS (SELECT split, MIN(conf) AS lo, MAX(conf) AS hi FROM v GROUP BY 1),
g AS (SELECT split AS side, CAST(unnest(range(30)) AS BIGINT) AS bin FROM r),
c AS (SELECT v.split AS side, CAST(least(29, floor((conf - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, COUNT(*) AS n
  FROM v JOIN r ON v.split = r.split WHERE conf IS NOT NULL GROUP BY 1, 2)
SELECT g.side, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.side = c.side AND g.bin = c.bin""")
def histogram(spark, sf):
    """Some values are missing or NaN, some bins empty."""
    conf = F.when(F.col("tx_id") % 22 == 0, F.lit(float("nan"))).when(
        F.col("tx_id") % 11 != 0, F.col("conf") * F.col("conf") * F.col("conf"))
    return D.histogram(transactions(spark, sf).withColumn("conf", conf), "conf", train())


_SUMMARY = f"""{PROFILE}, {_MIX}, {_KS.format(v="conf", first="split = 'train'", src="tx")}"""


@query("drift_summary", f"""{_SUMMARY}
SELECT ROUND(psi, 4) AS psi_topk, ROUND(oov_rate, 4) AS oov_rate, ROUND(ks_stat, 4) AS ks_confidence_stat,
  class AS shift_class, ROUND(train, 4) AS shift_train, ROUND(prod, 4) AS shift_prod, ROUND(abs_delta, 4) AS shift_abs_delta,
  psi > 0.2 AS psi_alert, abs_delta > 0.15 AS shift_alert, psi > 0.2 OR abs_delta > 0.15 AS alert
FROM psi, oov, ks, shift""")
def drift_summary(spark, sf):
    return flat_summary(D.drift_summary(prepared(spark, sf), train(), conf="conf"))


def flat_summary(summary):
    return summary.select(
        "psi_topk", "oov_rate", "ks_confidence_stat",
        *[F.col(f"largest_label_shift.{c}").alias(f"shift_{c}") for c in ("class", "train", "prod", "abs_delta")],
        F.col("alerts.psi_topk_gt_threshold").alias("psi_alert"),
        F.col("alerts.label_shift_gt_threshold").alias("shift_alert"),
        D.any_alert().alias("alert"),
    )


@query("drift_summary_normalized_text", f"""{_profile_sql('normalized')}, {_MIX}
SELECT ROUND(psi, 4) AS psi_topk, ROUND(oov_rate, 4) AS oov_rate, psi > 0.2 AS psi_alert, abs_delta > 0.15 AS shift_alert,
  psi > 0.2 OR abs_delta > 0.15 AS alert FROM psi, oov, shift""")
def drift_summary_normalized_text(spark, sf):
    return flat_summary(D.drift_summary(prepared(spark, sf), train(), text="normalized")).select(
        "psi_topk", "oov_rate", "psi_alert", "shift_alert", "alert")


@query("drift_alert_count", """
WITH s AS (SELECT event_id, value / 1000 AS psi, (value % 10) / 100 AS oov, value > 200 AS psi_alert,
  event_type = 'error' AND value > 100 AS shift_alert FROM events)
SELECT COUNT(*) FILTER (WHERE psi_alert OR shift_alert) AS drift_alerts_total,
  arg_max(psi, event_id) AS psi_topk, arg_max(oov, event_id) AS oov_rate FROM s""")
def drift_alert_count(spark, sf):
    summaries = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 1000).alias("psi_topk"), (F.col("value") % 10 / 100).alias("oov_rate"),
        F.struct(
            (F.col("value") > 200).alias("psi_topk_gt_threshold"),
            ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("label_shift_gt_threshold"),
        ).alias("alerts"))
    return D.drift_alert_count(summaries, "event_id")
