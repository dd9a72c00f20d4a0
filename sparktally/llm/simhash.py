"""Document fingerprints by SimHash, and search within a Hamming radius.

Terms are five-word shingles, weighted by how often they occur. Each term's hash votes
with its weight for or against every bit of the fingerprint; the sign of the sum is the
bit. Two fingerprints that differ in fewer bits than there are blocks agree on a whole
block: one table per block, with that block in front, finds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktally.llm.arrow import plain, schema_of, stored
from sparktally.llm.words import SPACE, mix, shingles, slices, words_of

BITS = 256
BLOCKS = 16
RADIUS = 15
SHINGLE = 5
#: Text per neighbour group of ``edited_texts``.
GROUP_BYTES = 16 << 20
_SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))


def fingerprints(column: pa.Array) -> list[str]:
    """Hexadecimal fingerprints; a text without words has all bits 0."""
    found = words_of(column, SPACE)
    terms, at = shingles(found.hashes, found.first, SHINGLE)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        votes = np.zeros(BITS, np.int64)
        for c in range(a, b, 4096):
            part = terms[c:min(c + 4096, b)]
            spread = np.stack([mix(part ^ s) for s in _SEEDS], 1).view(np.uint8)
            votes += np.unpackbits(spread.reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int32)
        out.append(np.packbits(2 * votes > b - a).tobytes().hex())
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal bits."""
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / BITS


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint per row; null, empty and blank texts have the fingerprint of no bits.

    Equal texts have equal fingerprints. Repeated rows get a row each, a null doc_id stays
    null, an empty table gives no rows, extra columns are ignored, texts are read whole.
    """
    src = plain(docs, doc_id, text)
    schema, arrow = schema_of(src, doc_id, fingerprint=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1)))], schema=arrow)

    return src.mapInArrow(run, schema)


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, doc_id, distance): all rows of ``index`` within ``radius`` bits of a query's fingerprint.

    Both sides have doc_id and fingerprint. Equal fingerprints of either side meet once, so copies cost
    one row; the ids are joined to the distinct pairs at the end. Needs radius < blocks. Null
    fingerprints match nothing; empty sides give no rows.
    """
    if radius >= blocks:
        raise ValueError("the radius must be less than the number of blocks")
    digits = BITS // 4 // blocks

    def tables(side: DataFrame, name: str) -> DataFrame:
        each = side.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = F.array(*[F.struct(F.lit(b).alias("table"), F.substring(name, 1 + b * digits, digits).alias("front"))
                         for b in range(blocks)])
        return each.select(name, F.explode(keys).alias("key")).select(name, "key.table", "key.front")

    distance = None
    for at in range(0, BITS // 4, 8):
        one, two = (F.conv(F.substring(c, at + 1, 8), 16, 10).cast("long") for c in ("a", "b"))
        part = F.bit_count(one.bitwiseXOR(two))
        distance = part if distance is None else distance + part
    pairs = stored(
        tables(queries, "a").join(tables(index, "b"), ["table", "front"]).select("a", "b", distance.alias("distance"))
        .where(F.col("distance") <= radius).distinct(), "pairs")
    left = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("a"))
    right = index.select("doc_id", F.col("fingerprint").alias("b"))
    return pairs.join(left, "a").join(right, "b").select("query_id", "doc_id", "distance")


def count_within(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query_id, n_near: rows of ``index`` within the radius, the query itself included; copies are counted, not listed."""
    sizes = stored(index.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("doc_id")), "sizes")  # one row per fingerprint
    asked = queries.select(F.col("fingerprint").alias("doc_id"), "fingerprint").distinct()
    found = within_radius(asked, sizes, radius).groupBy("query_id").agg(F.sum("doc_id").alias("n_near"))
    return queries.join(stored(found, "near"), queries["fingerprint"] == F.col("query_id"), "left").select(
        queries["doc_id"].alias("query_id"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def neighbour_groups(docs: DataFrame, group_bytes: int, doc_id: str, text: str) -> DataFrame:
    """Rows with ``_group`` (ranges of ascending ids) and ``_extra``: each group also gets the row that follows it.

    The last group is followed by the first row. Only one row per group is looked at to find it.
    """
    size = docs.agg(F.min(doc_id).alias("lo"), F.max(doc_id).alias("hi"), F.count(doc_id).alias("n"),
                    F.sum(F.octet_length(text)).alias("bytes")).first()
    if size["n"] == 0:
        return docs.withColumns({"_group": F.lit(-1).cast("long"), "_extra": F.lit(False)})
    groups = max(1, (size["bytes"] or 0) // group_bytes)
    width = max(1, -(-(size["hi"] - size["lo"] + 1) // groups))
    group = F.when(F.col(doc_id).isNull(), F.lit(-1).cast("long")).otherwise(
        F.floor((F.col(doc_id) - F.lit(size["lo"])) / F.lit(width)).cast("long"))
    numbered = docs.withColumn("_group", group)
    heads = numbered.groupBy("_group").agg(F.min(doc_id).alias("_head"))
    order = Window.orderBy("_group")  # one row per group
    before = F.coalesce(F.lag("_group").over(order), F.max("_group").over(Window.partitionBy()))
    heads = stored(heads.select(F.col("_group").alias("_own"), "_head", before.alias("_before")), "heads")
    marked = numbered.join(heads, (F.col("_group") == F.col("_own")) & F.col(doc_id).eqNullSafe(F.col("_head")), "left")
    places = F.when(F.col("_own").isNull(), F.array(F.struct(F.col("_group").alias("g"), F.lit(False).alias("x")))).otherwise(
        F.array(F.struct(F.col("_group").alias("g"), F.lit(False).alias("x")),
                F.struct(F.col("_before").alias("g"), F.lit(True).alias("x"))))
    return marked.select(*docs.columns, F.explode(places).alias("_p")).select(
        *docs.columns, F.col("_p.g").alias("_group"), F.col("_p.x").alias("_extra"))


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next per row.

    The next row is the next in ascending doc_id, after the last the first; rows of equal id
    follow each other by text, null ids come first. Null texts are empty. Every row's text
    moves once, to its range of ids. An empty table gives no rows; extra columns are ignored.
    """
    src = plain(docs, doc_id, text).withColumn(text, F.coalesce(text, F.lit("")))
    rows = neighbour_groups(src, group_bytes, doc_id, text)
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(parts, "_group").sortWithinPartitions("_group", "_extra", doc_id, text)
    schema, arrow = schema_of(
        src, doc_id, n_chars=T.LongType(), edited=T.StringType(), fingerprint=T.StringType(),
        edited_fingerprint=T.StringType(), near_edited=T.DoubleType(), near_next=T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the row whose next one is not known yet: group, id, text
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                ids, texts, groups, extras = (c.to_pylist() for c in part.columns)
                done = []
                prints = fingerprints(part.column(1))
                for i, t, g, x, p in zip(ids, texts, groups, extras, prints):
                    if waiting is not None and waiting[0] == g:
                        done.append((waiting[1], waiting[2], waiting[3], t, p))
                    waiting = None if x else (g, i, t, p)
                if done:
                    yield _finish(done, arrow)

    return ordered.mapInArrow(run, schema)


def _finish(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    edited = [edit(t, nxt) for _, t, _, nxt, _ in rows]
    prints = fingerprints(pa.array(edited, pa.string()))
    own = [p for _, _, p, _, _ in rows]
    columns = [
        [i for i, *_ in rows], [len(t) for _, t, *_ in rows], edited, own, prints,
        [likeness(a, b) for a, b in zip(own, prints)], [likeness(r[2], r[4]) for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
