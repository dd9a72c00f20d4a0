"""How document filters interact: what each removes at every place of every order, and its Shapley value.

A document's failures are five bits. The table of coalitions, which is how many documents each of the
32 sets of filters removes, says all there is to say about any order: what a filter removes
behind others is the difference of two coalitions. Shapley values are the exact constrained least
squares fit of the coalitions by one number per filter: its kernel-weighted normal equations, with
the constraint that the numbers add up to all removals, are solved in rationals. The solution is linear in
the coalitions, so it is found once and applied to every part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktally.llm.arrow import few, schema_of, stored
from sparktally.llm.words import SPACE, slices, words_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SIGNS = "#$%&*|"
_COPY = 1 << FILTERS.index("E")

_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_SIGN = np.zeros(256, np.int64)
_SIGN[[ord(c) for c in SIGNS]] = 1
#: Bytes that begin a code point.
_POINT = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)


def text_failures(column: pa.Array) -> np.ndarray:
    """Bits A to D of every text; a null is an empty text."""
    found = words_of(column, SPACE, lower=False)
    n_words = np.diff(found.first)
    row = found.rows()
    order = np.lexsort((found.hashes, row))
    h, r = found.hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(n_words))
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    offsets = offsets - offsets[0]

    def per_row(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[found.data])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    return (
        (n_words < LEAST_WORDS) * 1
        + (100 * distinct < DISTINCT_PERCENT * n_words) * 2
        + (100 * per_row(_CAPITAL) > CAPITAL_PERCENT * per_row(_POINT)) * 4
        + (per_row(_SIGN) > 0) * 8
    ).astype(np.int32)


def failures(docs: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, digest (of the text), fails (bits A to D) per row; a null text is empty, a null part an empty string."""
    src = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    src = src.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    schema, arrow = schema_of(src, "doc_id", "part", "digest", fails=T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), piece.column(3), pa.array(text_failures(piece.column(1)))], schema=arrow)

    return src.mapInArrow(run, schema)


def tabulate(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, fails (bits A to E), n, good, toxic: documents, and those so labelled, for each set of failures.

    Rows are first summed by (text, document), so copies cost little, however many there are. Of equal texts
    all but those of the smallest doc_id fail E, which no window over the copies is needed for.
    """
    named = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = stored(
        failures(docs, part, doc_id, text).groupBy("doc_id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n")), "failures")
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least != most")
    copied = few(stored(copied.select("digest", "least"), "copied"))
    named = few(stored(named.where("good OR toxic"), "labelled"))
    marked = rows.join(copied, "digest", "left").join(named, F.col("doc_id") == F.col("id"), "left")
    fails = F.col("fails") + F.when(F.col("doc_id") > F.col("least"), _COPY).otherwise(0)
    return marked.groupBy("part", fails.alias("fails")).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def _solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """x of ``matrix`` x = ``right`` by Gauss-Jordan elimination; all columns of ``right`` at once."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(n: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each player the weight of every coalition's value (by its bits) in the player's Shapley value.

    Least squares over the proper coalitions S with weights (n - 1) / (C(n, |S|) |S| (n - |S|)) of
    (value(S) - sum of the players' numbers in S), subject to the numbers' sum being value(all): the
    normal equations with one multiplier, solved for all right-hand sides at once.
    """
    whole = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, whole)}
    inside = [[s >> i & 1 for i in range(n)] for s in range(whole + 1)]
    matrix = [[sum((w * inside[s][i] * inside[s][j] for s, w in kernel.items()), Fraction(0)) for j in range(n)] + [Fraction(1)]
              for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * inside[s][i] for s in range(whole + 1)] for i in range(n)]
    right.append([Fraction(int(s == whole)) for s in range(whole + 1)])
    return _solve(matrix, right)[:n]


def _steps() -> list[str]:
    """SQL structs of all steps of all orders: order, step, bit of the filter, filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order):
            name = "".join(FILTERS[k] for k in order)
            out.append(f"struct('{name}', {step + 1}, {i}, {before})")
            before |= 1 << i
    return out


def _coalitions(count: str) -> Column:
    """Array by coalition (its bits) of the documents that fail any of its filters."""
    return F.array(*[F.sum(F.when(F.col("fails").bitwiseAND(F.lit(s)) != 0, F.col(count)).otherwise(0)) for s in range(1 << len(FILTERS))])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    All counts are documents of the part. ``removed`` is what the step's filter takes of what is left,
    ``redundant`` what fails it and went before, ``unique_fails`` what fails it alone, ``shapley`` what it removes
    summed over all orders. Null texts are empty, a null part is the empty string. Filter E fails
    for rows whose text another row of a smaller doc_id has; rows without a doc_id neither fail E nor make others
    fail, rows that repeat a doc_id fail together. A document is good or toxic if any of its labels
    says so. Very long texts are read whole, an empty table gives no rows, extra columns are
    ignored. Runs jobs and writes to the shared folder while it is being planned.
    """
    masks = tabulate(docs, labels, part, doc_id, text)
    alone = F.array(*[F.sum(F.when(F.col("fails") == (1 << i), F.col("n")).otherwise(0)) for i in range(len(FILTERS))])
    tables = masks.groupBy("part").agg(
        F.sum("n").alias("total"), _coalitions("n").alias("v"), _coalitions("good").alias("g"), _coalitions("toxic").alias("t"),
        alone.alias("alone"))
    orders = factorial(len(FILTERS))
    values = []
    for weights in shapley_weights():
        scaled = [w * orders for w in weights]  # whole numbers
        assert all(w.denominator == 1 for w in scaled)
        values.append(sum((F.lit(int(w)) * F.col("v")[s] for s, w in enumerate(scaled) if w), F.lit(0).cast("long")))
    tables = tables.withColumn("shapley", F.array(*values))
    steps = tables.select("*", F.explode(F.expr(f"array({', '.join(_steps())})")).alias("s")).select(
        "*", F.col("s.col1").alias("filter_order"), F.col("s.col2").alias("step"), F.col("s.col3").alias("i"), F.col("s.col4").alias("before"))
    after = F.col("before").bitwiseOR(F.expr("shiftleft(1, i)"))

    def gained(table: str) -> Column:
        return F.col(table)[after] - F.col(table)[F.col("before")]

    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.col("v")[after]).alias("kept"), gained("v").alias("removed"),
        (F.col("v")[F.expr("shiftleft(1, i)")] - gained("v")).alias("redundant"), F.col("alone")[F.col("i")].alias("unique_fails"),
        gained("g").alias("good_lost"), gained("t").alias("toxic_lost"), F.col("shapley")[F.col("i")].alias("shapley"))
