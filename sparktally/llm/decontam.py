"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a slice of a task's rows. Its alphabet is the words of the benchmark: a
window cannot hold any other word, so other words only separate runs, and runs
shorter than the shortest window hold none. The windows are searched backwards, all at
once; their occurrences are located through sampled positions and merged to spans.
Nothing is shuffled. The benchmark is the stated query set: it is searched in blocks of
bounded size, one pass over the rows for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktally.llm.arrow import discard, plain, schema_of, stored
from sparktally.llm.fmindex import FMIndex
from sparktally.llm.words import NON_WORD, Words, slices, words_of

WINDOW = 13
#: Benchmark text per pass; what is broadcast is a few times this.
BLOCK_BYTES = 32 << 20


class Block:
    """Windows of some items as numbers of the block's vocabulary, right-aligned."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        found = words_of(pa.array([t for _, t in items], pa.string()), NON_WORD)
        self.words = np.unique(found.hashes)
        numbers = np.searchsorted(self.words, found.hashes) + 1
        owners: dict[tuple[int, ...], set[str]] = {}
        for (name, _), a, b in zip(items, found.first[:-1], found.first[1:]):
            for at in range(a, max(b - window, a) + 1 if b > a else a):
                owners.setdefault(tuple(numbers[at:min(at + window, b)].tolist()), set()).add(name)
        keys = sorted(owners)
        self.items = [sorted(owners[k]) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.patterns = np.zeros((len(keys), window), np.int64)
        for i, k in enumerate(keys):
            self.patterns[i, window - len(k):] = k

    def occurrences(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word where it begins, window) of every occurrence in the rows of a slice."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(found.hashes):
            return none, none
        spot = np.minimum(np.searchsorted(self.words, found.hashes), len(self.words) - 1)
        known = self.words[spot] == found.hashes
        starts_row = np.zeros(len(known), bool)
        starts_row[found.first[:-1][np.diff(found.first) > 0]] = True
        begins = known & (starts_row | ~np.concatenate([[False], known[:-1]]))
        run = np.cumsum(begins)[known] - 1
        size = np.bincount(run)
        word = np.flatnonzero(known)
        wide = (size >= self.lengths.min())[run]
        word, run = word[wide], run[wide]
        if not len(word):
            return none, none
        # one separator behind every run
        number = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])
        text = np.zeros(len(word) + int(number[-1]) + 1, np.int64)
        text[np.arange(len(word)) + number] = spot[word] + 1
        back = np.full(len(text), -1)
        back[np.arange(len(word)) + number] = word
        index = FMIndex(text, len(self.words))
        lo, hi = index.search(self.patterns, self.lengths)
        hits = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(int(hits.sum()))
        return back[index.locate(rows)], np.repeat(np.arange(len(hits)), hits)


def _items(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(item, text) with a text, and the number of blocks they make."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-size // block_bytes))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                   text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, n_words, n_hit, spans (array of start, end in code points), items (sorted distinct strings) per row.

    A word is hit when it lies in an occurrence of ``window`` consecutive words of an
    item, or of a whole item that has fewer. Spans are maximal runs of hit words. Null
    and empty texts have no words; a null or empty item has no window and an item without
    an id is left out; repeated items count once. Repeated rows get a row each, a null
    doc_id stays null. Empty tables give no rows, or no hits. Extra columns are ignored.
    Very long texts are searched whole. Reads the benchmark while it is being planned; each block but the last is a pass whose result is
    written to the shared folder.
    """
    others = [c for c in carry if c != text]
    src = plain(docs, doc_id, text, *others)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema, arrow = schema_of(
        src, doc_id, text, *others, n_words=T.LongType(), n_hit=T.LongType(), spans=T.ArrayType(span),
        items=T.ArrayType(T.StringType()))
    out = src.select(
        doc_id, text, *others, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast(T.ArrayType(span)).alias("spans"), F.array().cast("array<string>").alias("items"))
    spark = docs.sparkSession
    items, blocks = _items(benchmark, item_id, item_text, block_bytes)
    for number in range(blocks):  # one block at a time on the driver, and in the tasks
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
        block = spark.sparkContext.broadcast(Block([tuple(r) for r in part.collect()], window))
        before, out = out, out.mapInArrow(_scan(block, text, arrow, window), schema)
        if number + 1 < blocks:
            out = stored(out, "hits")
            discard(before)
            block.unpersist()
    return out if text in carry else out.drop(text)


def _scan(block, text: str, arrow: pa.Schema, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield _mark(part, block.value, arrow)

    return run


def _mark(part: pa.RecordBatch, block: Block, arrow: pa.Schema) -> pa.RecordBatch:
    found = words_of(part.column(1), NON_WORD)
    n_words = np.diff(found.first)
    begin, window = block.occurrences(found)
    row = np.searchsorted(found.first, begin, "right") - 1
    cover = np.zeros(len(found.hashes) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + block.lengths[window], -1)
    hit = np.cumsum(cover[:-1]) > 0

    spans, items = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
    n_hit = np.zeros(part.num_rows, np.int64)
    touched = set(row.tolist()) | {r for r, s in enumerate(spans) if s}
    for r, w in set(zip(row.tolist(), window.tolist())):
        items[r] = items[r] + block.items[w]
    data = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)]) if touched else None
    rows = found.first
    bytes_at = np.concatenate([[0], np.cumsum(np.diff(_row_bytes(part)))])
    for r in touched:
        items[r] = sorted(set(items[r]))
        a, b = rows[r], rows[r + 1]
        base = data[bytes_at[r]]
        starts, ends = data[found.starts[a:b]] - base, data[found.ends[a:b]] - base
        mine = hit[a:b].copy()
        for s in spans[r]:  # hits of former blocks
            mine |= (starts >= s["start"]) & (ends <= s["end"])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
        spans[r] = [{"start": int(starts[x]), "end": int(ends[y - 1])} for x, y in zip(edge[::2], edge[1::2])]
        n_hit[r] = mine.sum()
    return pa.RecordBatch.from_arrays([
        *part.columns[:-4], pa.array(n_words.astype(np.int64)), pa.array(n_hit),
        pa.array(spans, arrow.field("spans").type), pa.array(items, arrow.field("items").type)], schema=arrow)


def _row_bytes(part: pa.RecordBatch) -> np.ndarray:
    from sparktally.llm.words import text_bytes

    return text_bytes(part.column(1))[1]
