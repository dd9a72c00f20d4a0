"""Connected components by alternating stars; only edges travel, nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktally.llm.arrow import discard, few, stored


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour, then the
    smaller ones, so paths halve and the edges end as one star per component. Components that
    are one star already are put aside, so only the others' edges travel in the next round. The
    minima are written before they are joined: a hub's edges are then an ordinary
    skewed side that Spark splits. What a round wrote is deleted behind it; ``discard`` the result when it is
    stored. Null ends and loops are left out, repeated edges do no
    harm, no edges give no rows.
    """
    ends = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a != b")
    current = stored(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stars, scratch = [], []
    while (open_ends := _open_ends(current)) is not None:
        before = current
        marked = stored(before.join(few(open_ends).withColumn("open", F.lit(True)), "v", "left").select("u", "v", "open"), "edges")
        scratch += marked.scratch
        stars.append(marked.where("open IS NULL").select("u", "v"))
        current = marked.where("open").select("u", "v")
        discard(before, open_ends)
        both = current.union(current.select(F.col("v"), F.col("u")))
        smallest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(
            both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(small.union(least.select("u", "m")).distinct(), "edges")
        discard(smallest, large, least)
    done = reduce(DataFrame.union, stars, current)
    roots = done.select(F.col("v").alias("node")).distinct()
    out = done.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
    out.scratch = [*current.scratch, *scratch]
    return out


def _open_ends(edges: DataFrame) -> DataFrame | None:
    """The smaller ends of all edges but those of components that are one star; None if there are no others.

    In such a star no node has two smaller neighbours, or a smaller and a larger one.
    """
    kind = edges.schema["v"].dataType
    nodes = edges.select("u", F.col("v").alias("lo"), F.col("v").alias("hi"), F.lit(0).alias("above")).union(
        edges.select("v", F.lit(None).cast(kind), F.lit(None).cast(kind), F.lit(1)))
    bent = stored(
        nodes.groupBy("u").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("above").alias("above"))
        .where("lo != hi OR above = 1 AND lo IS NOT NULL").select("u"), "bent")
    if bent.isEmpty():
        discard(bent)
        return None
    out = stored(edges.join(few(bent), "u", "left_semi").select("v").union(bent).distinct(), "open")
    discard(bent)
    return out
