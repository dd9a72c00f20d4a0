"""The most frequent terms by a threshold, and joins back to rows that many share; no step sorts a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices of a range of counts that one pass tells apart.
SLICES = 1024
#: Ties that are put in order at the end.
FEW = 500
#: A text in more than this share of the rows is frequent; there are at most 1 / share of them.
FREQUENT_SHARE = 1e-4


def among_most_frequent(df: DataFrame, count: str, key: str, k: int) -> Column:
    """Condition for the ``k`` rows of largest ``count``, equal counts by ascending ``key``.

    ``df`` has one row per key and is read several times, so it should be a stored table. Each pass counts
    rows in slices of the range that holds the k-th count, until that is known. Ties at that count are
    narrowed down by ever longer beginnings of the key. Only numbers per slice and beginning come to the driver, and the condition is
    two comparisons. Null counts are left out; a null key comes first.
    """
    known = df.where(F.col(count).isNotNull()).select(F.col(count).cast("bigint").alias("n"), F.col(key).alias("key"))
    span = known.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    if span[2] <= k:
        return F.col(count).isNotNull()
    if k <= 0:
        return F.lit(False)
    low, high, wanted = span[0], span[1] + 1, k  # the k-th count lies in [low, high); ``wanted`` rows of it are to be taken
    while high - low > 1:
        width = -(-(high - low) // SLICES)
        slot = F.floor((F.col("n") - F.lit(low)) / F.lit(width)).cast("bigint")
        sizes = dict(known.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(slot.alias("s")).count().collect())
        for s in sorted(sizes, reverse=True):
            if sizes[s] >= wanted:
                low, high = low + s * width, min(high, low + (s + 1) * width)
                break
            wanted -= sizes[s]
    ties = known.where(F.col("n") == low).select("key")
    above = F.col(count) > low
    begin, last = None, None
    while True:
        inside = ties if begin is None else ties.where(F.substring("key", 1, len(begin)) == begin)
        sizes = dict(inside.groupBy(F.substring("key", 1, (len(begin) if begin else 0) + 1).alias("b")).count().collect())
        for b in sorted(sizes, key=lambda b: (b is not None, (b or "").encode("utf-8"))):
            if sizes[b] >= wanted:
                break
            wanted -= sizes[b]
        if b is None or b == begin:  # a null key, or the beginning itself
            last = b
            break
        if sizes[b] <= FEW:
            rows = ties.where(F.substring("key", 1, len(b)) == b).collect()
            last = sorted((r[0] for r in rows), key=lambda x: x.encode("utf-8"))[wanted - 1]
            break
        begin = b
    tied = F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= F.lit(last))
    return above | ((F.col(count) == low) & tied)


def most_frequent(df: DataFrame, count: str, key: str, k: int) -> DataFrame:
    """Rows of ``df`` that ``among_most_frequent`` picks."""
    return df.where(F.coalesce(among_most_frequent(df, count, key, k), F.lit(False)))


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """_text, _copies: the distinct texts with their number of rows."""
    return df.groupBy(F.col(text).alias("_text")).agg(F.count(F.lit(1)).alias("_copies"))


def attach(df: DataFrame, results: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """``df`` with the columns of ``results`` (one row per text, in a column of the name ``text``), nulls where there is none.

    ``counts`` is ``text_counts(df, text)`` as a stored table. The few texts that fill more than FREQUENT_SHARE of the
    rows each are broadcast with their results; their rows need no partner any more and are dealt out evenly
    instead of by text, so no task gets more than its share, whatever the distribution. All others meet in a shuffle. If there are no more
    texts than frequent ones may be, all are broadcast.
    """
    names = [c for c in results.columns if c != text]
    total, texts = counts.agg(F.coalesce(F.sum("_copies"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counts.where(F.col("_copies") > F.lit(max(1, int(total * FREQUENT_SHARE)))).select(F.col("_text").alias("_hot"))
    found = results.select(F.col(text).alias("_of"), F.struct(*names, F.lit(True).alias("_is")).alias("_found"))
    if texts * FREQUENT_SHARE <= 1:  # as few as frequent ones may be: rows stay where they are, in their order
        joined = df.join(F.broadcast(found), df[text] == F.col("_of"), "left")
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_found.{c}").alias(c) for c in names])
    # at most 1 / FREQUENT_SHARE rows
    hot = F.broadcast(frequent.join(found, F.col("_hot") == F.col("_of"), "left").select("_hot", F.lit(True).alias("_frequent"), F.col("_found").alias("_ready")))
    marked = df.join(hot, df[text] == F.col("_hot"), "left")
    # rows without a partner: a frequent or a null text
    alone = F.col("_frequent").isNotNull() | F.col(text).isNull()
    spread = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    keyed = marked.withColumn("_key", F.when(alone, spread).otherwise(F.col(text)))
    # results may be as many as the rows, and their file's size says little of what a broadcast would take
    joined = keyed.join(found.hint("merge"), keyed["_key"] == found["_of"], "left")
    best = F.when(F.col("_frequent").isNotNull(), F.col("_ready")).otherwise(F.col("_found"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], best.alias("_best")).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_best.{c}").alias(c) for c in names])
