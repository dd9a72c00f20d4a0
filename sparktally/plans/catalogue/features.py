"""Terms, TF-IDF, labels, splits and vectors."""

from pyspark.sql import functions as F

from sparktally.functions import text as T
from sparktally.functions import vectors as V
from sparktally.operators import features as X
from sparktally.plans import sqltext as S
from sparktally.plans.catalogue.drift import PROFILE, prepared, profile
from sparktally.plans.catalogue.text import DOCUMENT_WORDS, PREPARED
from sparktally.plans.fixtures import WITH_TX, table, transactions
from sparktally.plans.registry import query
from sparktally.operators import drift as D


def document_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_tokens("text").alias("tokens"))


@query("encode_labels", f"""{WITH_TX},
codes AS (SELECT category_label, row_number() OVER (ORDER BY category_label) - 1 AS label_index
  FROM (SELECT DISTINCT category_label FROM tx))
SELECT tx_id, category_label, label_index FROM tx JOIN codes USING (category_label)""")
def encode_labels(spark, sf):
    return X.encode_labels(transactions(spark, sf).select("tx_id", "category_label"), "category_label")


@query("stratified_split", f"""{WITH_TX},
r AS (SELECT tx_id, category_label, row_number() OVER (PARTITION BY category_label
  ORDER BY md5(concat(CAST(tx_id AS VARCHAR), '|42')), tx_id) AS k, COUNT(*) OVER (PARTITION BY category_label) AS n FROM tx)
SELECT tx_id, category_label, CASE WHEN k <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf):
    return X.stratified_split(
        transactions(spark, sf).select("tx_id", "category_label"), "tx_id", "category_label", 0.2, 42)


def _tfidf_sql(docs: str, limit: int | None = None) -> str:
    """CTEs ending in ``weights(doc, term, tf, w)`` from a CTE ``docs(doc, copies, terms)``."""
    cap = f"ORDER BY corpus DESC, term LIMIT {limit}" if limit else ""
    return f"""{docs},
tf AS (SELECT doc, copies, term, COUNT(*) AS tf FROM (SELECT doc, copies, unnest(terms) AS term FROM docs) GROUP BY 1, 2, 3),
known AS (SELECT term, CAST(SUM(copies) AS DOUBLE) AS df, SUM(copies * tf) AS corpus FROM tf GROUP BY 1 {cap}),
n AS (SELECT CAST(SUM(copies) AS DOUBLE) AS n FROM docs),
raw AS (SELECT doc, tf.term, tf, tf * (ln((1::DOUBLE + n) / (1::DOUBLE + df)) + 1::DOUBLE) AS x FROM tf JOIN known ON tf.term = known.term, n),
weights AS (SELECT doc, term, tf, x / sqrt(SUM(x * x) OVER (PARTITION BY doc)) AS w FROM raw)"""


@query("char_tfidf", f"""{PREPARED}, {_tfidf_sql(
    f'docs AS (SELECT model_text AS doc, COUNT(*) AS copies, {S.ngrams("model_text")} AS terms FROM prepared GROUP BY 1)', 200000)}
SELECT doc AS model_text, COUNT(*) AS terms, CAST(SUM(tf) AS BIGINT) AS tf, ROUND(SUM(w), 6) AS sum_weight,
  ROUND(MAX(w), 6) AS max_weight, arg_max(term, tf * 1000000::BIGINT + unicode(term)) AS common FROM weights GROUP BY doc""")
def char_tfidf(spark, sf):
    weights = X.char_tfidf(prepared(spark, sf), "model_text")
    return weights.groupBy("model_text").agg(
        F.count("*").alias("terms"), F.sum("tf").alias("tf"), F.round(F.sum("tfidf"), 6).alias("sum_weight"),
        F.round(F.max("tfidf"), 6).alias("max_weight"),
        F.max_by("term", F.col("tf") * 1000000 + F.ascii("term")).alias("common"))


@query("char_tfidf_capped", f"""{PREPARED}, {_tfidf_sql(
    f'docs AS (SELECT model_text AS doc, COUNT(*) AS copies, {S.ngrams("model_text", 1, 2)} AS terms FROM prepared GROUP BY 1)', 100)}
SELECT doc AS model_text, term, tf, ROUND(w, 6) AS tfidf FROM weights""")
def char_tfidf_capped(spark, sf):
    return X.char_tfidf(prepared(spark, sf), "model_text", 1, 2, max_features=100).withColumn("tfidf", F.round("tfidf", 6))


@query("bag_of_words", f"""WITH {DOCUMENT_WORDS}
SELECT doc_id, term, COUNT(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM doc_words) GROUP BY 1, 2""")
def bag_of_words(spark, sf):
    return X.bag_of_words(document_words(spark, sf), "doc_id", "tokens")


@query("word_tfidf", f"""WITH {DOCUMENT_WORDS},
{_tfidf_sql("docs AS (SELECT doc_id AS doc, 1 AS copies, tokens AS terms FROM doc_words)")}
SELECT doc AS doc_id, term, tf, ROUND(w, 6) AS tfidf FROM weights""")
def word_tfidf(spark, sf):
    return X.tfidf(document_words(spark, sf), "doc_id", "tokens").withColumn("tfidf", F.round("tfidf", 6))


@query("vocabulary", f"""WITH {DOCUMENT_WORDS}, terms AS (SELECT DISTINCT unnest(tokens) AS term FROM doc_words)
SELECT COUNT(*) AS vocabulary_size, (SELECT string_agg(term, ' ' ORDER BY term)
  FROM (SELECT term FROM terms ORDER BY term LIMIT 30)) AS preview FROM terms""")
def vocabulary(spark, sf):
    return X.vocabulary(document_words(spark, sf), "tokens").select(
        "vocabulary_size", F.array_join("preview", " ").alias("preview"))


@query("oov_rate_row", f"""{PROFILE},
masked_texts AS (SELECT masked AS m, {S.ngrams("masked")} AS g FROM (SELECT DISTINCT masked FROM prepared)),
looked_up AS (SELECT m, g.gram, vocab.gram AS known FROM (SELECT m, unnest(g) AS gram FROM masked_texts) g
  LEFT JOIN vocab ON g.gram = vocab.gram),
rates AS (SELECT m, CAST(SUM(CASE WHEN known IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS oov FROM looked_up GROUP BY m)
SELECT tx_id, ROUND(coalesce(oov, 1::DOUBLE), 9) AS oov FROM prepared LEFT JOIN rates ON masked = m""")
def oov_rate_row(spark, sf):
    vocab = D.vocabulary(profile(spark, sf))
    return X.oov_rate_row(prepared(spark, sf), "tx_id", "masked", vocab).withColumn("oov", F.round("oov", 9))


# ------------------------------------------------------------------ vectors

_UNIT = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS unit FROM v)"""


@query("l2_normalize", f"""WITH {_UNIT}
SELECT vec_id, ROUND(unit[1], 6) AS first, ROUND(unit[64], 6) AS last, ROUND(list_sum(unit), 6) AS total,
  ROUND(list_sum(list_transform(unit, lambda x: x * x)), 6) AS norm FROM u""")
def l2_normalize(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("u"))
    return unit.select(
        "vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"),
        F.round(V._total(F.col("u")), 6).alias("total"), F.round(V.dot("u", "u"), 6).alias("norm"))


@query("cosine_similarity", f"""WITH {_UNIT}
SELECT a.vec_id AS id_a, b.vec_id AS id_b,
  ROUND(list_sum(list_transform(range(1, 65), lambda i: a.unit[i] * b.unit[i])), 6) AS cosine
FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf):
    vectors = table(spark, sf, "embeddings")
    neighbours = vectors.select(F.col("vec_id").alias("id_a"), (F.col("vec_id") + 1).alias("id_b"))
    return V.cosine_similarity(vectors, neighbours, "vec_id", "embedding", digits=6)


@query("centroid_similarity", f"""WITH {_UNIT},
m AS (SELECT label, i, AVG(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(e) AS x FROM u) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c, sqrt(SUM(m * m)) AS norm FROM m GROUP BY 1)
SELECT vec_id, u.label AS label, ROUND(list_sum(list_transform(range(1, 65), lambda i: unit[i] * c[i])) / norm, 6) AS cosine
FROM u JOIN c ON u.label = c.label""")
def centroid_similarity(spark, sf):
    return V.centroid_similarity(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", digits=6)


@query("vector_stats", f"""WITH {_UNIT}
SELECT vec_id, list_min(e) AS min, list_max(e) AS max, ROUND(list_avg(e), 9) AS mean, ROUND(list_stddev_pop(e), 9) AS std FROM u""")
def vector_stats(spark, sf):
    stats = table(spark, sf, "embeddings").select("vec_id", V.vector_stats("embedding").alias("s"))
    return stats.select("vec_id", "s.min", "s.max", F.round("s.mean", 9).alias("mean"), F.round("s.std", 9).alias("std"))
