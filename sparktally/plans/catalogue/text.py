"""Text projections."""

from pyspark.sql import functions as F

from sparktally.functions import text as T
from sparktally.plans import sqltext as S
from sparktally.plans.fixtures import WITH_TX, table, transactions
from sparktally.plans.registry import query

_NORM = S.normalize_label("raw_label")
_OP = S.operation_type("raw_label", "channel")


@query("normalize_label", f"""{WITH_TX}
SELECT tx_id, {_NORM} AS normalized FROM tx""")
def normalize_label(spark, sf):
    return transactions(spark, sf).select("tx_id", T.normalize_label("raw_label").alias("normalized"))


@query("normalize_label_documents", f"""
SELECT doc_id, {S.normalize_label("text")} AS normalized FROM documents""")
def normalize_label_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_label("text").alias("normalized"))


@query("normalize_merchant_text", f"""{WITH_TX}
SELECT tx_id, {S.merchant_text("raw_label")} AS merchant_text FROM tx""")
def normalize_merchant_text(spark, sf):
    return transactions(spark, sf).select(
        "tx_id", T.normalize_merchant_text("raw_label").alias("merchant_text"))


@query("mask_pii", f"""
SELECT conv_id, turn, {S.mask("text")} AS masked FROM conversations""")
def mask_pii(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.mask_pii("text").alias("masked"))


@query("mask_pii_transactions", f"""{WITH_TX}
SELECT tx_id, {S.mask("raw_label")} AS masked FROM tx""")
def mask_pii_transactions(spark, sf):
    return transactions(spark, sf).select("tx_id", T.mask_pii("raw_label").alias("masked"))


@query("mask_pii_reference", f"""{WITH_TX},
found AS (SELECT tx_id, raw_label,
  regexp_extract_all(upper(raw_label), '\\b[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}\\b') AS ibans,
  regexp_extract_all(raw_label, '(?i)\\bRUM[\\w-]{{8,}}\\b') AS rums FROM tx)
SELECT tx_id,
  replace(CASE WHEN len(ibans) > 0 THEN replace(raw_label, ibans[1], 'IBAN_TOKEN') ELSE raw_label END,
          coalesce(rums[1], '#none#'), 'RUM_TOKEN') AS masked_raw,
  {S.normalize_label("raw_label")} LIKE '%iban fr76%' AS iban_left_in_lower_case
FROM found""")
def mask_pii_reference(spark, sf):
    masked = T.mask_pii("normalized", iban_mask="reference")
    return (
        transactions(spark, sf)
        .withColumn("normalized", T.normalize_label("raw_label"))
        .select("tx_id", T.mask_pii("raw_label", iban_mask="reference").alias("masked_raw"),
                masked.contains("iban fr76").alias("iban_left_in_lower_case"))
    )


@query("pii_matches", f"""{WITH_TX}
SELECT tx_id,
  array_to_string(regexp_extract_all(upper(raw_label), '\\b[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}\\b'), ',') AS iban,
  array_to_string(regexp_extract_all(raw_label, '(?i)\\bRUM[\\w-]{{8,}}\\b'), ',') AS rum,
  regexp_matches(upper(raw_label), '\\b[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}\\b') AS has_iban,
  regexp_matches(raw_label, '(?i)\\bRUM[\\w-]{{8,}}\\b') AS has_rum
FROM tx""")
def pii_matches(spark, sf):
    found = transactions(spark, sf).select("tx_id", T.pii_matches("raw_label").alias("m"))
    return found.select(
        "tx_id",
        F.array_join("m.iban", ",").alias("iban"),
        F.array_join("m.rum", ",").alias("rum"),
        (F.size("m.iban") > 0).alias("has_iban"),
        (F.size("m.rum") > 0).alias("has_rum"),
    )


@query("operation_type", f"""{WITH_TX}
SELECT tx_id, {_OP} AS operation_type FROM tx""")
def operation_type(spark, sf):
    return transactions(spark, sf).select(
        "tx_id", T.operation_type("raw_label", "channel").alias("operation_type"))


@query("tokenize", f"""{WITH_TX}
SELECT tx_id, array_to_string(regexp_extract_all({S.mask(_NORM)}, '[a-z0-9]+'), ' ') AS tokens FROM tx""")
def tokenize(spark, sf):
    return T.preprocess(transactions(spark, sf)).select("tx_id", F.array_join("tokens", " ").alias("tokens"))


@query("preprocess", f"""{WITH_TX},
n AS (SELECT tx_id, {_NORM} AS normalized, {_OP} AS operation_type FROM tx),
m AS (SELECT *, {S.mask("normalized")} AS masked FROM n)
SELECT tx_id, normalized, masked, operation_type,
  regexp_matches(upper(normalized), '\\b[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}\\b') AS has_iban,
  regexp_matches(normalized, '(?i)\\bRUM[\\w-]{{8,}}\\b') AS has_rum,
  array_to_string(regexp_extract_all(masked, '[a-z0-9]+'), ' ') AS tokens
FROM m""")
def preprocess(spark, sf):
    return T.preprocess(transactions(spark, sf)).select(
        "tx_id", "normalized", "masked", "operation_type", "has_iban", "has_rum",
        F.array_join("tokens", " ").alias("tokens"))


#: Masked text, operation and model text of every transaction, as SQL.
PREPARED = f"""{WITH_TX},
normed AS (SELECT tx.*, {_NORM} AS normalized, {_OP} AS operation_type FROM tx),
masked AS (SELECT *, {S.mask("normalized")} AS masked FROM normed),
prepared AS (SELECT *, {S.model_text("masked", "operation_type", "mcc")} AS model_text FROM masked)"""


@query("model_text", f"{PREPARED} SELECT tx_id, model_text FROM prepared")
def model_text(spark, sf):
    return T.preprocess(transactions(spark, sf)).select("tx_id", T.model_text().alias("model_text"))


@query("char_ngrams", f"""{PREPARED}
SELECT tx_id, CAST(len({S.ngrams("masked")}) AS BIGINT) AS n_grams,
  array_to_string({S.ngrams("masked")}, '|') AS grams FROM prepared""")
def char_ngrams(spark, sf):
    grams = T.preprocess(transactions(spark, sf)).select("tx_id", T.char_ngrams("masked").alias("g"))
    return grams.select("tx_id", F.size("g").cast("bigint").alias("n_grams"),
                        F.array_join("g", "|").alias("grams"))


@query("clean_tokens", f"""
SELECT doc_id, array_to_string(list_filter(
    regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]|[0-9]', '', 'g'), '\\s+'),
    lambda t: length(t) > 1 AND NOT list_contains({S.words(T.K.STOP_WORDS)}, t)), ' ') AS tokens
FROM documents""")
def clean_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.clean_tokens("text"), " ").alias("tokens"))


#: Prepared words of every document, as SQL.
DOCUMENT_WORDS = f"""doc_words AS (SELECT doc_id, list_filter(
    regexp_split_to_array(regexp_replace(lower(text), '[^\\pL\\pN_]+', ' ', 'g'), ' '),
    lambda t: length(t) > 1 AND NOT list_contains({S.words(T.K.STOP_WORDS)}, t)) AS tokens FROM documents)"""


@query("word_tokens", f"""WITH {DOCUMENT_WORDS}
SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM doc_words""")
def word_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.word_tokens("text"), " ").alias("tokens"))
