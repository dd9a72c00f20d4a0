"""Near-duplicate groups of documents by SuperMinHash.

A document's set is its distinct five-word shingles. Every shingle draws one
random permutation of the signature's places; in step j it offers a rank of j plus a
random fraction at its j-th place, and each place keeps the least. As later steps
offer only larger values, a document stops once all its places are filled with
less, for most documents after one or two steps. Ranks of one shingle differ by
construction, which is where the lower variance comes from.

Equal sets collapse into one class first, whatever their number. Classes that share a
band meet in a bucket. There, a growing number of probes is compared with all other
members that are not yet in the probe's component, so a bucket that is one group
costs one comparison per member, and one that is not is still searched in full.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktally.llm.arrow import discard, few, plain, schema_of, stored
from sparktally.llm.components import components
from sparktally.llm.words import SPACE, mix, shingles, slices, words_of

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 8  # a link at 0.85 shares no band with probability 3.8e-5
#: Bits of the parity sketch.
PARITY = 1024
_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64(0xFFFFFFFF)
_NONE = np.uint64(2**64 - 1)


def distinct_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    found = words_of(column, SPACE)
    hashes, at = shingles(found.hashes, found.first, words)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        s = np.sort(hashes[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def signatures(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """(sets, places) of step << 32 | random fraction; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    table = np.full((len(sets), places), _NONE)
    flat = table.reshape(-1)
    row = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = None
    for j in range(places):
        if not len(element):
            break
        draw = mix(element + np.uint64(j * int(_STEP) & (2**64 - 1)))
        pick = j + ((draw >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            each = np.arange(len(element))
            place = order[each, pick]
            order[each, pick] = order[:, j]
            order[:, j] = place
        np.minimum.at(flat, row * places + place, np.uint64(j << 32) | (draw & _LOW))
        live = (table.max(axis=1) >= np.uint64((j + 1) << 32))[row]
        if order is None:
            element, row, pick = element[live], row[live], pick[live]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), pick] = 0
            order[:, 0] = pick
        elif not live.all():
            element, row, order = element[live], row[live], order[live]
    return table


def band_keys(table: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) of 64-bit keys; the band's number is part of the key."""
    folded = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :].repeat(len(table), 0)
    parts = table.reshape(len(table), bands, rows)
    for r in range(rows):
        folded = mix(folded ^ parts[:, :, r])
    return folded


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY / 64) words: for each bit whether an odd number of elements hashes to it.

    An element in only one of two sets flips one bit, so as many bits as differ, elements do at least.
    """
    odd = np.zeros((len(sets), PARITY), np.uint8)
    for row, s in zip(odd, sets):
        row += np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY).astype(np.uint8) & 1
    return np.packbits(odd, axis=1).view(np.uint64)


def _sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, two order-free sums that identify the set, band keys."""
    schema, arrow = schema_of(
        docs, doc_id, "text_hash", n_shingles=T.LongType(), set_a=T.LongType(), set_b=T.LongType(), bands=T.ArrayType(T.LongType()),
        parity=T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                sets = distinct_sets(part.column(1))
                n = np.array([len(s) for s in sets], np.int64)
                a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                filled = np.flatnonzero(n)
                _, first, back = np.unique(np.stack([n.view(np.uint64), a, b], 1)[filled], axis=0,
                                           return_index=True, return_inverse=True)
                chosen = [sets[i] for i in filled[first]]
                table, back = signatures(chosen), back.reshape(-1)
                keys, parity = (x[back].view(np.int64) for x in (band_keys(table), parity_bits(chosen)))
                ends = np.concatenate([[0], np.cumsum(n > 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                    *[pa.ListArray.from_arrays(pa.array(ends * x.shape[1]), pa.array(x.reshape(-1)))
                      for x in (keys, parity)],
                ], schema=arrow)

    return docs.mapInArrow(run, schema)


def _full_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    schema, arrow = schema_of(docs, doc_id, shingles=T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                sets = distinct_sets(part.column(1))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema=arrow)

    return docs.mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored ``pairs`` (a, b) whose full sets are alike enough; a stored table."""
    # sets go only to the sides of the pairs that name them
    ids = [few(stored(pairs.select(F.col(c).alias("id")).distinct(), "asked")) for c in ("a", "b")]
    left, right = (sets.join(i, "id", "left_semi").select(F.col("id").alias(c), F.col("shingles").alias(name))
                   for i, c, name in zip(ids, ("a", "b"), ("left", "right")))
    both = F.size(F.array_intersect("left", "right"))
    out = stored(
        pairs.join(right, "b").join(left, "a")
        .where(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b"), "links")
    discard(*ids)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of ``docs``.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets;
    component_id is the smallest doc_id reachable over links, itself included. Null, empty
    and blank texts have an empty set and are their own component. Repeated rows are
    copies: each gets a row. Rows that share a doc_id but not the text are grouped each by its
    own text, which text_hash tells. A null doc_id joins the component of equal sets with an id; without
    one its component is null and it is kept. An empty table gives no rows; extra columns
    are ignored. Runs jobs and writes to the shared folder while it is being planned.
    """
    src = plain(docs, doc_id, text)
    hashed = src.withColumn("text_hash", F.xxhash64(text))
    sketch = stored(_sketches(hashed, doc_id, text), "sketches")
    key = ["n_shingles", "set_a", "set_b"]
    classes = stored(
        sketch.where("n_shingles > 0").groupBy(key).agg(
            F.min(F.when(F.col(doc_id).isNotNull(), F.struct(F.col(doc_id).alias("id"), "text_hash"))).alias("head"),
            *[F.first(c).alias(c) for c in ("bands", "parity")]).select("*", F.col("head.id").alias("least")), "classes")
    numbered, clash = _numbered(classes)
    entries = numbered.where("id IS NOT NULL").select("id", F.explode("bands").alias("bucket"))
    shared = stored(
        entries.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head != tail"), "buckets")
    found = stored(entries.join(few(shared).select("bucket", "head"), "bucket"), "entries")
    members = stored(found.join(numbered.select("id", "n_shingles", "parity"), "id"), "members")
    wanted = stored(found.select("id").distinct(), "candidates")
    sets = _class_sets(src, numbered, wanted, doc_id, text)
    discard(shared, found, wanted)
    links = _search(members, sets, percent)
    discard(members, sets)

    group = components(links, "a", "b")
    named = numbered.join(group, numbered["id"] == group["node"], "left").select(*key, "least", "component")
    smallest = None
    if clash:  # components are named by numbers that no document has
        named = stored(named, "named")
        smallest = stored(named.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
        out = named.join(smallest, "component", "left").select(*key, F.coalesce("component_id", "least").alias("component_id"))
    else:
        out = named.select(*key, F.coalesce("component", "least").alias("component_id"))
    result = stored(sketch.select(doc_id, "text_hash", *key).join(out, key, "left").select(
        doc_id, "text_hash", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id"))), "groups")
    discard(sketch, classes, numbered, links, group, named, smallest)
    return result


def _numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` with ``id``, and whether ids differ from ``least``, their smallest doc_id.

    Where that is the smallest of several classes, as rows of one doc_id may have several texts, id is a number below all of them.
    """
    clashing = stored(classes.where("least IS NOT NULL").groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("least"), "clashing")
    if clashing.isEmpty():
        discard(clashing)
        return classes.withColumn("id", F.col("least")), False
    lowest = classes.agg(F.min("least")).first()[0]
    marked = classes.join(few(clashing.withColumnRenamed("least", "clash")), F.col("least") == F.col("clash"), "left")
    out = stored(marked.withColumn("id", F.when(F.col("clash").isNull(), F.col("least").cast("long")).otherwise(
        F.lit(min(lowest, 0) - 1).cast("long") - F.monotonically_increasing_id())).drop("clash"), "numbered")
    discard(clashing)
    return out, True


def _class_sets(src: DataFrame, numbered: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, shingles) of the wanted classes, each from the text of its smallest doc_id; a stored table."""
    asked = stored(few(wanted).join(numbered.select("id", "head"), "id").select(
        F.col("id").alias("_class"), F.col("head.id").alias("_least"), F.col("head.text_hash").alias("_of")), "asked")
    chosen = src.join(few(asked), (F.col(doc_id) == F.col("_least")) & (F.xxhash64(text) == F.col("_of")))
    sets = stored(_full_sets(chosen.select(F.col("_class").alias("id"), F.col(text).alias("text")), "id", "text"), "sets")
    if sets.count() > asked.count():  # a row is repeated
        again, sets = sets, stored(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")
        discard(again)
    discard(asked)
    return sets


_TRAITS = ("n_shingles", "parity")


def _differing(name: str, words: int):
    """Bits in which column ``name`` differs from the probe's."""
    parts = [F.bit_count(F.col(name)[i].bitwiseXOR(F.col(f"probe.{name}")[i])) for i in range(words)]
    return sum(parts[1:], parts[0])


def _may_link(percent: int):
    """False for pairs that, by their sizes and parities, cannot be linked.

    Linked sets differ in at most (100 - percent) / (100 + percent) of their summed sizes.
    """
    a, b = F.col("n_shingles"), F.col("probe.n_shingles")
    return (
        (100 * F.least(a, b) >= percent * F.greatest(a, b))
        & (_differing("parity", PARITY // 64) * (100 + percent) <= (100 - percent) * (a + b))
    )


def _search(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links needed for the components: every pair of a bucket is compared unless already connected.

    First the bucket's smallest id is compared with all others. Where several components are
    left, about the next 15 members are, then about the next 240, and so on: a member's place is a hash below the number
    of members, so no bucket is sorted or numbered. Rounds end when every bucket is one component or
    has no member left to compare; members of one component are never compared with each other.
    """
    heads = members.where("id = head").select("bucket", F.struct(*_TRAITS).alias("probe"))
    pairs = (
        members.where("id != head").join(heads, "bucket").where(_may_link(percent))
        .select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    )
    tried = stored(pairs, "pairs")
    links = _confirmed(tried, sets, percent)
    kept = [*tried.scratch, *links.scratch]
    group = components(links, "a", "b")
    rest, done = members.where("id != head").drop("head").dropDuplicates(["bucket", "id"]), 0
    while True:
        old = rest
        if group is not None:
            columns = [c for c in rest.columns if c != "component"]
            rest = rest.select(columns).join(group, rest["id"] == group["node"], "left").select(
                *columns, F.coalesce("component", "id").alias("component"))
        mixed = stored(rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
                       .where("lo != hi").select("bucket", "n"), "mixed")
        if mixed.isEmpty():
            discard(mixed, old, group)
            links.scratch = kept
            return links
        rest = rest.join(mixed, "bucket")
        if not done:
            rest = rest.withColumn("place", 1 + F.pmod(F.xxhash64("bucket", "id"), "n"))
        rest = stored(rest.drop("n"), "rest")
        discard(mixed, old, group)
        upto = 16 * done + 15
        probes = rest.where(F.col("place") <= upto).select(
            "bucket", F.col("id").alias("a"), F.struct(*_TRAITS).alias("probe"), F.col("place").alias("at"),
            F.col("component").alias("own"))
        later = F.expr("component != own AND (place > at OR place = at AND id > a)")
        found = (
            rest.join(probes, "bucket").where(later & _may_link(percent))
            .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        )
        fresh = stored(found, "pairs")
        more = _confirmed(fresh, sets, percent)
        kept += [*fresh.scratch, *more.scratch]
        if more.isEmpty():
            group = None
        else:
            links = links.union(more)
            group = components(links, "a", "b")
        tried, done = tried.union(fresh), upto
        scratch = rest.scratch
        rest = rest.where(F.col("place") > done)
        rest.scratch = scratch
