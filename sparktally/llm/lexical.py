"""Ranked lexical search with K2-treaps over the term-document grid.

A shard is a slice of a task's documents. Its grid has a row per term, the most frequent first, and a
column per document, those of like terms and length side by side; a cell's value is the impact of the term in
the document. The grid is a quadtree that stores no empty cells: each node has four bits for its
children and the largest impact below, kept as the difference from its parent's and compressed.
Rows are split earlier than columns, so that the bounds of narrow document ranges are those of single terms.

A query descends along the row paths of all its terms at once. Its state is a document range with
the node of every term that occurs there; the weighted sum of the nodes' maxima bounds all scores in the range.
Ranges are taken best first and are dropped when their bound falls below the worst of the results
so far, which a task carries from shard to shard. A single column's bound is its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparktally.llm.arrow import stored
from sparktally.llm.words import LOWER, NON_WORD, slices, text_bytes, words_of

TOP = 50
#: Text of a shard.
SHARD_BYTES = 8 << 20
#: Levels by which rows are split before columns.
LEAD = 4
#: Query text per pass over the index.
BLOCK_BYTES = 4 << 20
#: Query terms that descend together.
GROUP_TERMS = 4096
#: Ranges of one query taken at a time.
TAKEN = 48
#: Parts in which results are merged before the last merge.
MERGES = 32
#: Stands for a missing doc_id: last among equal scores.
_NO_ID = 2**63 - 1

_ONES = np.array([m.bit_count() for m in range(16)], np.int64)
#: Set bits below bit q of a mask.
_BELOW = np.array([[(m & ((1 << q) - 1)).bit_count() for q in range(4)] for m in range(16)], np.int64)


def weight(n: int, df: int) -> int:
    """Of a term in ``df`` of ``n`` documents."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in documents of ``length`` terms."""
    m = 100 - 50 + (50 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Treap:
    """K2-treap of a grid of 2 ** row_bits by 2 ** column_bits cells."""

    def __init__(self, row_bits: int, column_bits: int, lead: int = LEAD):
        self.row_bits, self.column_bits = row_bits, column_bits
        late = min(lead, column_bits)  # levels at the bottom that split columns alone
        both = min(row_bits, column_bits - late)
        splits = [(True, False)] * (row_bits - both) + [(False, True)] * (column_bits - late - both)
        splits += [(True, True)] * both + [(False, True)] * late
        self.levels = len(splits)
        self.splits_columns = np.array([c for _, c in splits], np.int64)
        rows = np.array([r for r, _ in splits], bool)
        #: The row's bit that a level looks at, -1 if it does not split rows.
        self.row_shift = np.where(rows, row_bits - np.cumsum(rows), -1)

    def keys(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Paths of cells, two bits a level."""
        key, c = np.zeros(len(row), np.uint64), self.column_bits
        for shift, splits in zip(self.row_shift, self.splits_columns):
            code = np.zeros(len(row), np.uint64)
            if shift >= 0:
                code = (row >> shift & 1).astype(np.uint64)
            if splits:
                c -= 1
                code = code * np.uint64(2) + (column >> c & 1).astype(np.uint64)
            key = key << np.uint64(2) | code
        return key

    def build(self, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> "Treap":
        """Of distinct cells, at least one, with values above 0."""
        key = self.keys(row, column)
        order = np.argsort(key)
        key, top = key[order], value[order].astype(np.int64)
        masks, tops = [], [top]
        for _ in range(self.levels):
            above = key >> np.uint64(2)
            begin = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (key & np.uint64(3)).astype(np.uint8), begin))
            top = np.maximum.reduceat(top, begin)
            tops.append(top)
            key = above[begin]
        self.masks, self.tops = masks[::-1], tops[::-1]
        return self

    def pack(self) -> tuple[bytes, bytes]:
        """(children's bits, maxima as differences from the parent's), compressed."""
        bits = np.concatenate([*self.masks, np.zeros(1, np.uint8)])
        bits = bits[:len(bits) // 2 * 2].reshape(-1, 2)
        deltas = [self.tops[0]]
        for mask, above, top in zip(self.masks, self.tops, self.tops[1:]):
            deltas.append(np.repeat(above, _ONES[mask]) - top)
        planes = np.concatenate(deltas).astype("<u4").view(np.uint8).reshape(-1, 4).T
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return squeeze((bits[:, 0] | bits[:, 1] << 4).tobytes()), squeeze(planes.tobytes())

    def unpack(self, bits: bytes, maxima: bytes) -> "Treap":
        """All nodes numbered level by level: ``mask``, first child and ``top``."""
        open_ = zstandard.ZstdDecompressor().decompress
        pairs = np.frombuffer(open_(bits), np.uint8)
        mask = np.stack([pairs & 15, pairs >> 4], 1).reshape(-1)
        deltas = np.ascontiguousarray(np.frombuffer(open_(maxima), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
        ones = _ONES[mask]
        top, at, first, width = deltas, 0, 1, 1
        for _ in range(self.levels):
            children = ones[at:at + width]
            at, total = at + width, int(children.sum())
            top[first:first + total] = np.repeat(top[at - width:at], children) - top[first:first + total]
            first, width = first + total, total
        self.mask, self.top = mask[:at], top
        self.first = 1 + np.concatenate([[0], np.cumsum(ones[:at])[:-1]])
        return self


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, times) of the distinct terms of each text, and the terms of every row."""
    found = words_of(column, NON_WORD)
    row = found.rows()
    terms, number = np.unique(found.hashes, return_inverse=True)
    key = np.sort(row * max(len(terms), 1) + number)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(key)))
    key = key[begin]
    return key // max(len(terms), 1), terms[key % max(len(terms), 1)], times, np.diff(found.first)


def _bits(n: int) -> int:
    return max(0, (n - 1).bit_length())


_SHARD = T.StructType([
    T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("terms", T.BinaryType()), T.StructField("df", T.BinaryType()),
    T.StructField("bits", T.BinaryType()), T.StructField("maxima", T.BinaryType())])


def _shard(parts: list[tuple], n: int, total: int) -> tuple | None:
    """One index row of slices (doc ids, row, hash, times, lengths), or None without any term."""
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    ids = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + b for p, b in zip(parts, base)])
    terms, number, df = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True, return_counts=True)
    times, length = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    if not len(doc):
        return None
    by_df = np.argsort(-df, kind="stable")
    rank = np.empty(len(terms), np.int64)
    rank[by_df] = np.arange(len(terms))
    row = rank[number]
    # documents with the same most frequent term stand together, by length
    most = np.lexsort((row, -times, doc))
    head = np.full(len(ids), len(terms))
    first = most[np.concatenate([[True], doc[most][1:] != doc[most][:-1]])]
    head[doc[first]] = row[first]
    filled = np.flatnonzero(length > 0)
    order = filled[np.lexsort((ids[filled], length[filled], head[filled]))]
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    treap = Treap(_bits(len(terms)), _bits(len(order))).build(row, place[doc], impacts(times, length[doc], n, total))
    return (ids[order], terms[by_df].tobytes(), df[by_df].astype("<u4").tobytes(), *treap.pack())


@dataclass
class Index:
    """Shards as a stored table, and the counts that their impacts come from."""

    shards: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index of all rows; ids are integers. Null and empty texts have no terms and are not counted.

    Repeated rows are documents each. A text of any length is read whole, its shard is as large as it needs. An
    empty table gives an empty index; extra columns are ignored. Runs jobs and writes to the shared folder.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column(0))
                inside = ~NON_WORD[LOWER[data]]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                starts = offsets[:-1][np.diff(offsets) > 0]
                begins[starts] = inside[starts]
                sums = np.concatenate([[0], np.cumsum(begins)])
                lengths = sums[offsets[1:]] - sums[offsets[:-1]]
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    counts = src.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n, total = int(counts[0] or 0), int(counts[1] or 0)
    arrow = to_arrow_schema(_SHARD)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                parts.append((ids, *cells(part.column(1))))
                size += part.column(1).nbytes
                if size >= shard_bytes:
                    yield from _one(_shard(parts, n, total), arrow)
                    parts, size = [], 0
        if parts:
            yield from _one(_shard(parts, n, total), arrow)

    return Index(stored(src.mapInArrow(build, _SHARD), "treaps"), n, total)


def _one(row: tuple | None, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    if row is not None:
        ends = np.array([0, len(row[0])], np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(ends), pa.array(row[0])), *[pa.array([x], pa.binary()) for x in row[1:]]], schema=arrow)


@dataclass
class Queries:
    """Items of a block; the terms of item i are begin[i]:begin[i + 1]."""

    items: list
    begin: np.ndarray
    terms: np.ndarray
    weights: np.ndarray | None = None


def _block(items: list[tuple]) -> Queries:
    """Of (item id, text) rows; rows of one id are one item with the terms of all."""
    found = words_of(pa.array([t for _, t in items], pa.string()), NON_WORD)
    names: dict = {}
    for (name, _), a, b in zip(items, found.first[:-1], found.first[1:]):
        names.setdefault(name, []).append(found.hashes[a:b])
    terms = [np.unique(np.concatenate(h)) for h in names.values()]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
    return Queries(list(names), begin, np.concatenate(terms) if terms else np.zeros(0, np.uint64))


class Best:
    """The best documents of every item so far: flat arrays in order of item, falling score, rising id."""

    def __init__(self, items: int, top: int):
        self.items, self.most = items, top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = _ranks(item)
        keep = rank < self.most
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = rank[keep] == self.most - 1
        self.floor[self.item[full]] = self.score[full]  # what ties with it may have a smaller id


def _ranks(sorted_groups: np.ndarray) -> np.ndarray:
    """Place of every element in its run."""
    if not len(sorted_groups):
        return np.zeros(0, np.int64)
    at = np.arange(len(sorted_groups))
    begins = np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]])
    return at - np.maximum.accumulate(np.where(begins, at, 0))


def descend(treap: Treap, docs: np.ndarray, item: np.ndarray, row: np.ndarray, weights: np.ndarray, best: Best, taken: int = TAKEN) -> None:
    """All documents of a shard that belong to the best of their items go to ``best``.

    ``item``, ``row`` and ``weights`` tell the terms that the shard has, in order of items.
    """
    owner, r = np.unique(item, return_inverse=True)
    # entries: a term's node in a range
    r_item, r_level, r_column = owner, np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    bound = np.bincount(r, weights * treap.top[0], len(owner)).astype(np.int64)
    node, term = np.zeros(len(item), np.int64), np.arange(len(item))
    if not treap.levels:
        best.add(r_item, bound, docs[r_column])
        return
    while len(r_item):
        live = bound >= best.floor[r_item]
        order = np.lexsort((-bound, r_item))
        order = order[live[order]]
        chosen = np.zeros(len(r_item), bool)
        chosen[order[_ranks(r_item[order]) < taken]] = True
        mine = chosen[r]
        new = _expand(treap, r[mine], node[mine], term[mine], r_level, r_column, row, weights)
        n_range, n_node, n_term, n_bound, n_from, n_side = new
        n_level = r_level[n_from] + 1
        n_column = np.where(treap.splits_columns[r_level[n_from]] > 0, 2 * r_column[n_from] + n_side, r_column[n_from])
        leaf = n_level == treap.levels
        if leaf.any():
            best.add(r_item[n_from[leaf]], n_bound[leaf], docs[n_column[leaf]])
        # what goes on: ranges not taken, and new ones above the floor
        wait = live & ~chosen
        go = ~leaf & (n_bound >= best.floor[r_item[n_from]])
        number = np.cumsum(np.concatenate([wait, go])) - 1
        keep, fresh = wait[r], go[n_range]
        r, node, term = (np.concatenate([number[r[keep]], number[len(wait) + n_range[fresh]]]),
                         np.concatenate([node[keep], n_node[fresh]]), np.concatenate([term[keep], n_term[fresh]]))
        r_item, r_level, r_column, bound = (
            np.concatenate([r_item[wait], r_item[n_from[go]]]), np.concatenate([r_level[wait], n_level[go]]),
            np.concatenate([r_column[wait], n_column[go]]), np.concatenate([bound[wait], n_bound[go]]))


def _expand(treap: Treap, r, node, term, r_level, r_column, row, weights) -> tuple:
    """Entries (range, node, term) and ranges (bound, parent, side) one level below."""
    level = r_level[r]
    mask, splits, shift = treap.mask[node], treap.splits_columns[level], treap.row_shift[level]
    code = np.where(shift >= 0, row[term] >> np.maximum(shift, 0) & 1, 0) << splits
    first = treap.first[node]
    sides = []
    for side in (0, 1):
        has = (mask >> (code + side) & 1 > 0) & (splits >= side)
        at = np.flatnonzero(has)
        sides.append((2 * r[at] + side, first[at] + _BELOW[mask[at], code[at] + side], term[at]))
    n_range, n_node, n_term = (np.concatenate(p) for p in zip(*sides))
    found, n_range = np.unique(n_range, return_inverse=True)
    n_bound = np.bincount(n_range, weights[n_term] * treap.top[n_node], len(found)).astype(np.int64)
    return n_range, n_node, n_term, n_bound, found >> 1, found & 1


def _find(terms: bytes, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``asked``, rows) of the asked terms that a shard has."""
    own = np.frombuffer(terms, np.uint64)
    order = np.argsort(own)
    if not len(own) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, asked, sorter=order), len(own) - 1)
    row = order[at]
    has = np.flatnonzero(own[row] == asked)
    return has, row[has]


def _weighted(index: Index, block: Queries) -> Queries:
    """``block`` with the weights of its terms, from the shards' document counts."""
    asked, back = np.unique(block.terms, return_inverse=True)
    shared = index.shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, df in zip(*(c.to_pylist() for c in batch.columns)):
                at, row = _find(terms, shared.value)
                sums[at] += np.frombuffer(df, "<u4")[row]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["term", "df"])

    found = index.shards.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(asked), np.int64)
    for term, df in found:  # as many as the block has terms at most
        weights[term] = weight(index.documents, df)
    return Queries(block.items, block.begin, block.terms, weights[back])


def _groups(block: Queries) -> Iterator[tuple[int, int]]:
    """Ranges of items with about GROUP_TERMS terms."""
    start = 0
    while start < len(block.items):
        stop = max(start + 1, int(np.searchsorted(block.begin, block.begin[start] + GROUP_TERMS, "right")) - 1)
        yield start, stop
        start = stop


def search(index: Index, queries: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0.

    Equal scores go by ascending doc_id, rows without one last. A null or empty text finds nothing, rows
    of one item_id are one item, rows without an item_id are left out. Items are searched in blocks of
    ``block_bytes`` of text, each in one pass over the index, which only carries ``top`` rows per item and task.
    Runs jobs and writes to the shared folder while it is being planned.
    """
    items = queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("part", T.IntegerType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = None
    for number in range(max(blocks, 1)):
        part = items if blocks <= 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        block = _weighted(index, _block([tuple(r) for r in part.collect()]))
        found = index.shards.mapInArrow(_searched(index, block, top, schema), schema)
        found = stored(found, "found") if blocks > 1 else found  # one block at a time in the tasks' memory
        out = found if out is None else out.union(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = out.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("place") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")


def _searched(index: Index, block: Queries, top: int, schema: T.StructType):
    shared = index.shards.sparkSession.sparkContext.broadcast(block)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked = shared.value
        best = Best(len(asked.items), top)
        item = np.repeat(np.arange(len(asked.items)), np.diff(asked.begin))
        for batch in batches:
            for at in range(batch.num_rows):
                docs = batch.column(0).slice(at, 1).flatten().to_numpy(zero_copy_only=False)
                terms, _, bits, maxima = (batch.column(i)[at].as_py() for i in range(1, 5))
                has, row = _find(terms, asked.terms)
                has, row = has[asked.weights[has] > 0], row[asked.weights[has] > 0]
                treap = Treap(_bits(len(terms) // 8), _bits(len(docs))).unpack(bits, maxima)
                for start, stop in _groups(asked):
                    a, b = np.searchsorted(has, [asked.begin[start], asked.begin[stop]])
                    if a < b:
                        mine = has[a:b]
                        descend(treap, docs, item[mine], row[a:b], asked.weights[mine], best)
        places = pa.array(best.doc, mask=best.doc == _NO_ID)
        names = pa.array(asked.items, arrow.field("item_id").type).take(pa.array(best.item))
        part = np.full(len(best.item), TaskContext.get().partitionId() % MERGES, np.int32)
        yield pa.RecordBatch.from_arrays([names, pa.array(part), places, pa.array(best.score)], schema=arrow)

    return run
