"""Registered queries of the operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktally.session import ship_code as ship

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 2048 ids."""
    from sparktally.llm import packing

    return digest_pieces(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (  -- equal sets as one, so that copies do not multiply
  SELECT min(doc_id) AS rep, n, list(doc_id) AS docs
  FROM (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, '|' ORDER BY shingle)) AS h FROM s GROUP BY doc_id)
  GROUP BY h, n),
rs AS (SELECT rep, n, shingle FROM sets JOIN s ON s.doc_id = rep),
pairs AS (
  SELECT a.rep AS a, b.rep AS b
  FROM rs a JOIN rs b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(rep, to_rep) AS (
  SELECT rep, rep FROM sets UNION SELECT r.rep, e.b FROM reach r JOIN both_ways e ON e.a = r.to_rep),
component AS (SELECT rep, min(to_rep) AS component_id FROM reach GROUP BY rep),
named AS (SELECT unnest(docs) AS doc_id, component_id FROM sets JOIN component USING (rep))
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op6_minhash_near_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    from sparktally.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's, one row each."""
    from sparktally.llm import substring

    return substring.repeated_passages(table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (
  SELECT doc_id, i, p.size, item
  FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
        FROM places, sizes WHERE i + size - 1 <= len(w)) p
  JOIN windows USING (size, words)),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    from sparktally.llm import decontam

    return contamination(
        decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def contamination(hits: DataFrame) -> DataFrame:
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; documents with crc32 remainder 0 are held out."""
    from sparktally.llm import langid
    from sparktally.llm.arrow import fold

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, folds=5, held_out=0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; documents with crc32 remainder 1 are held out."""
    from sparktally.llm import toxicity
    from sparktally.llm.arrow import fold

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "sentences")


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; documents with crc32 remainder 1 are held out."""
    from sparktally.llm import quality
    from sparktally.llm.arrow import fold

    docs = table(spark, sf_dir, "documents")
    found = quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text.

    n_near: documents within the Hamming radius, for the query set of ids divisible by 100.
    """
    from sparktally.llm import simhash
    from sparktally.llm.arrow import stored

    found = simhash.edited_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    found = stored(found, "fingerprints")
    asked = found.where("doc_id % 100 = 0").select("doc_id", "fingerprint").distinct()
    near = stored(simhash.count_within(asked, found.select("doc_id", "fingerprint")), "near")
    near = near.select(F.col("query_id").alias("doc_id"), "n_near").groupBy("doc_id").agg(F.max("n_near").alias("n_near"))
    return found.join(near, "doc_id", "left")


@query("op8_lm_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document; documents with crc32 remainder 1 are held out."""
    from sparktally.llm import lm
    from sparktally.llm.arrow import fold

    found = lm.score_texts(table(spark, sf_dir, "documents"), folds=5, held_out=1)
    return found.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents."""
    from sparktally.llm import license_scan

    return license_scan.scan(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(range(0, 5)) AS i),
o AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS i, 0 AS before, 0 AS done
  UNION ALL
  SELECT filter_order || chr(CAST(65 + x.i AS INT)), step + 1, x.i, done, done | CAST(1 << x.i AS INT)
  FROM o, letters x WHERE done & CAST(1 << x.i AS INT) = 0),
whole AS (SELECT filter_order FROM o WHERE step = 5),
steps AS (SELECT w.filter_order, o.step, o.i, o.before, o.done FROM whole w JOIN o ON o.step > 0 AND starts_with(w.filter_order, o.filter_order)),
r AS (
  SELECT part, filter_order, step, i, sum(n) FILTER (fails & done = 0) AS kept,
    sum(n) FILTER (fails & before = 0 AND fails & CAST(1 << i AS INT) != 0) AS removed,
    sum(n) FILTER (fails & before != 0 AND fails & CAST(1 << i AS INT) != 0) AS redundant,
    sum(n) FILTER (fails = CAST(1 << i AS INT)) AS unique_fails,
    sum(good) FILTER (fails & before = 0 AND fails & CAST(1 << i AS INT) != 0) AS good_lost,
    sum(toxic) FILTER (fails & before = 0 AND fails & CAST(1 << i AS INT) != 0) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at every step of all their orders, by language."""
    from sparktally.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(0, 2) r(i)),
s AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    12 + length(role) + length(regexp_replace(role, '[^\\\n|]', '', 'g')) + 1
      + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11 AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


@query("op13_chat_formatting", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as read back from the sequences, and one whose texts hold the template's marks."""
    from sparktally.llm import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = spark.range(2).select(
        F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
        F.lit("<|im_end|><|im_start|>assistant ok"))
    tokenizer = vocabulary("byte_bpe_50k.json")
    nodes, members = chat.format_chats(turns.union(told), tokenizer)
    digests = chat.read_back(nodes, tokenizer)
    return members.select("conv_id", "sequence_id", "node").join(digests, ["sequence_id", "node"]).drop("sequence_id", "node")


OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT * FROM t WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
c AS (
  SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(k) AS BIGINT) AS k
  FROM (SELECT r, doc_id, len(w) AS k, unnest(w) AS term FROM d) JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY r, doc_id, term),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
g AS (
  SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * k * n) // l))))) AS BIGINT) AS score
  FROM q JOIN c USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id),
p AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM p WHERE rank <= 50
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    from sparktally.llm import lexical

    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
