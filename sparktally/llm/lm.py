"""Language-model scores by a weighted backoff automaton.

The model is an interpolated n-gram model of the whole training text: unigrams with added one half, and longer
n-grams smoothed by a Dirichlet prior, P(w | h) = (c(h w) + PRIOR P(w | h')) / (c(h) + PRIOR), h' being h without its
oldest word. No n-gram is left out, however rare. Its states are the histories that occur; an arc reads a
word and leads to the longest history that ends with it; a failure arc gives up the oldest word and costs PRIOR / (c(h) + PRIOR).

No task holds the whole model. The texts are written once as blocks of bounded size, each with its own small
vocabulary and its texts as numbers. Every block asks for its n-grams: their sorted keys go, in one compressed piece
for each range of keys, to the task of that range, which adds up the training counts of all blocks and sends each
block its totals in the same order, without the keys. There they meet the block's texts and become its
automaton. One left-to-right traversal scores each text.

A range gets one piece per block, each key once, so frequent words weigh no more than others. There are as many ranges as
the text asks for, so a task holds a bounded part of the keys; blocks follow the order of rows and not the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparktally.llm.arrow import discard, fold, plain, stored
from sparktally.llm.words import SPACE, mix, slices, words_of

#: Text per block, and per range of keys.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 16 << 20
#: Words of the longest n-grams, at most 4.
ORDER = 2
#: Weight of the shorter history, in occurrences.
PRIOR = 30.0
#: Hash of the token behind every text.
END = np.uint64(0x5E17D0C2A9B3F46D)
_MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)
_TAG = np.uint64(3)


def extend(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the n-gram that puts ``word`` behind ``history``."""
    return mix(history * _MULTIPLIER + word)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every row, each row's followed by END, and where rows begin."""
    found = words_of(column, SPACE)
    rows = len(found.first) - 1
    first = found.first + np.arange(rows + 1)
    out = np.full(int(first[-1]), END)
    out[np.arange(len(found.hashes)) + found.rows()] = found.hashes
    return out, first


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def ngram_keys(vocabulary: np.ndarray, token: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1 to ``order`` words: (their last token, key); the number of words is in the key's lowest bits."""
    word = vocabulary[token]
    ends = np.repeat(first[1:], np.diff(first))
    begin, value = np.arange(len(token)), word
    out = [(begin, value & ~_TAG)]
    for n in range(2, order + 1):
        go = begin + n <= ends[begin]
        begin = begin[go]
        value = extend(value[go], word[begin + n - 1])
        out.append((begin + n - 1, value & ~_TAG | np.uint64(n - 1)))
    return out


class Grams:
    """Distinct n-grams of a block: sorted ``keys``, and for each order the last tokens and the places of their keys."""

    def __init__(self, vocabulary: np.ndarray, token: np.ndarray, first: np.ndarray, order: int):
        found = ngram_keys(vocabulary, token, first, order)
        self.keys, place = np.unique(np.concatenate([k for _, k in found]), return_inverse=True)
        self.last = [at for at, _ in found]
        self.place = np.split(place, np.cumsum([len(k) for _, k in found])[:-1])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Occurrences whose last token is marked."""
        out = np.zeros(len(self.keys))
        for at, place in zip(self.last, self.place):
            out += np.bincount(place, train[at], len(self.keys))
        return out.astype(np.int64)


class Block:
    """Texts of a row of the block table."""

    fields = "block long, n_train long, train binary, first binary, vocabulary binary, token binary"

    def __init__(self, train: bytes, first: bytes, vocabulary: bytes, token: bytes):
        self.first = _unpacked(first).astype(np.int64)
        self.train = np.repeat(np.frombuffer(train, bool), np.diff(self.first))
        self.vocabulary, self.token = _unpacked_keys(vocabulary), _unpacked(token).astype(np.int64)


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Block table of rows (doc_id, text, train)."""
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), *T.StructType.fromDDL(Block.fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                hashes, first = tokens(part.column(1))
                vocabulary, token = np.unique(hashes, return_inverse=True)
                train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                ends = pa.array(np.array([0, part.num_rows], np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(ends, part.column(0)), pa.array([number]),
                    pa.array([int(np.diff(first)[train].sum())]),
                    *[pa.array([x], pa.binary()) for x in (train.tobytes(), _packed(first), _packed_keys(vocabulary), _packed(token))],
                ], schema=arrow)
                number += 1

    return rows.mapInArrow(run, schema)


def _asked(blocks: DataFrame, ranges: int, order: int) -> DataFrame:
    """(range, block, keys, counts): the n-grams of every block, a piece for each range of keys."""
    schema = T.StructType.fromDDL("`range` long, block long, keys binary, counts binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                number, *data = (c[at].as_py() for c in batch.columns)
                block = Block(*data)
                grams = Grams(block.vocabulary, block.token, block.first, order)
                counts = grams.counts(block.train)
                piece = (grams.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                named, begin = np.unique(piece, return_index=True)
                ends = np.append(begin[1:], len(piece))
                yield pa.RecordBatch.from_arrays([
                    pa.array(named.astype(np.int64)), pa.array(np.full(len(named), number)),
                    pa.array([_packed_keys(grams.keys[a:b]) for a, b in zip(begin, ends)], pa.binary()),
                    pa.array([_packed(counts[a:b]) for a, b in zip(begin, ends)], pa.binary())], schema=arrow)

    return blocks.select("block", "train", "first", "vocabulary", "token").mapInArrow(run, schema)


_TOTALS = "block long, `range` long, totals binary, words long"


def _added(table: pa.Table) -> pa.Table:
    """Totals of a range's keys for every block, in the order of its keys; and, for block -1, how many words occur in training."""
    keys = [_unpacked_keys(k) for k in table["keys"].to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    for part, counts in zip(np.split(place, ends[:-1]), table["counts"].to_pylist()):
        totals[part] += _unpacked(counts).astype(np.int64)  # a block has each key once
    words = int(((distinct & _TAG == 0) & (totals > 0)).sum())
    n, own = table.num_rows, table["range"][0].as_py()
    back = [_packed(t) for t in np.split(totals[place], ends[:-1])]
    return pa.table([
        pa.array([*table["block"].to_pylist(), -1], pa.int64()), pa.array([own] * (n + 1), pa.int64()), pa.array([*back, None], pa.binary()),
        pa.array([None] * n + [words], pa.int64())], names=["block", "range", "totals", "words"])


class Automaton:
    """States, arcs and failure arcs of the n-grams of one block; ``totals`` are those of its keys."""

    def __init__(self, token: np.ndarray, first: np.ndarray, grams: Grams, totals: np.ndarray, n: int, words: int, prior: float = PRIOR):
        size, order = len(token), len(grams.last)
        self.width = int(token.max()) + 1 if size else 1
        ends_text = np.zeros(size, bool)
        ends_text[first[1:] - 1] = True
        # by the last token of each n-gram: its total, and the state that it is
        count = np.zeros((order, size), np.int64)
        for k, (at, place) in enumerate(zip(grams.last, grams.place)):
            count[k, at] = totals[place]
        state = np.zeros((order, size), np.int64)
        rest, fail = [0.0], [0]
        numbers = 1
        for k in range(order - 1):
            at, place = grams.last[k], grams.place[k]
            good = (totals[place] > 0) & ~ends_text[at]
            at, place = at[good], place[good]
            distinct, one, same = np.unique(place, return_index=True, return_inverse=True)
            state[k, at] = numbers + same
            numbers += len(distinct)
            rest += np.log10(prior / (totals[distinct] + prior)).tolist()
            fail += (state[k - 1, at[one]] if k else np.zeros(len(distinct), np.int64)).tolist()
        chance = (count[0] + 0.5) / (n + 0.5 * (words + 1))
        self.base = np.log10(chance)
        one = np.unique(token, return_index=True)[1]
        self.unigram, self.word_state = self.base[one].tolist(), (state[0, one] if order > 1 else np.zeros(len(one), np.int64)).tolist()
        self.known = count[0] > 0

        self.arcs: dict[int, int] = {}
        self.weights: list[float] = []
        self.targets: list[int] = []
        for k in range(1, order):
            at = grams.last[k]
            history = count[k - 1, at - 1]
            chance[at] = (count[k, at] + prior * chance[at]) / (history + prior)
            seen = at[count[k, at] > 0]
            code, one = np.unique(state[k - 1, seen - 1] * self.width + token[seen], return_index=True)
            seen = seen[one]
            self.arcs.update(zip(code.tolist(), range(len(self.weights), len(self.weights) + len(code))))
            self.weights += np.log10(chance[seen]).tolist()
            self.targets += state[min(k, order - 2), seen].tolist()
        self.rest, self.fail = rest, fail

    def score(self, words: list[int]) -> float:
        """One pass over word numbers: follow the arc, or pay for failure until there is one."""
        arcs, weights, targets, fail, rest = self.arcs.get, self.weights, self.targets, self.fail, self.rest
        unigram, word_state, width = self.unigram, self.word_state, self.width
        state, total = 0, 0.0
        for word in words:
            arc = None
            while state:
                arc = arcs(state * width + word)
                if arc is not None:
                    break
                total += rest[state]
                state = fail[state]
            if arc is None:
                total += unigram[word]
                state = word_state[word]
            else:
                total += weights[arc]
                state = targets[arc]
        return total


_SCORES = "n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, folds: int = 5, held_out: int = 1, order: int = ORDER, prior: float = PRIOR,
                block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability) for every row.

    Learns from rows outside the held-out fold. Null and empty texts are the end token alone. Repeated
    rows are learnt and scored each; a null doc_id is an empty string for the fold and stays null.
    Without training rows every token is unknown. An empty table gives no rows; extra columns are
    ignored; a longer text is a block of its own and read whole. Runs jobs and writes to the shared folder while it is being planned.
    """
    src = plain(docs, doc_id, text).withColumnsRenamed({doc_id: "doc_id", text: "text"})
    spark = docs.sparkSession
    rows = src.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold("doc_id", folds) != held_out).alias("train"))
    blocks = stored(_blocks(rows, block_bytes), "blocks")
    size = blocks.agg(F.sum("n_train"), F.sum(F.octet_length("token") + F.octet_length("vocabulary"))).first()
    n = int(size[0] or 0)
    # the packed block table takes about three quarters of the texts' bytes
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * int(size[1] or 0) // (3 * range_bytes)))
    totals = stored(_asked(blocks, ranges, order).groupBy("range").applyInArrow(_added, _TOTALS), "totals")
    discard()
    words = int(totals.where("block = -1").agg(F.sum("words")).first()[0] or 0)

    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), *T.StructType.fromDDL(_SCORES).fields])
    arrow = to_arrow_schema(schema)

    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        return _score_block(block, totals, order, n, words, prior, arrow)

    scored = stored(blocks.groupBy("block").cogroup(totals.where("block >= 0").groupBy("block")).applyInArrow(run, schema), "scores")
    discard(blocks, totals)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def _score_block(row: pa.Table, totals: pa.Table, order: int, n: int, words: int, prior: float, arrow: pa.Schema) -> pa.Table:
    if not row.num_rows:
        return arrow.empty_table()
    block = Block(*(row[c][0].as_py() for c in ("train", "first", "vocabulary", "token")))
    token, first = block.token, block.first
    grams = Grams(block.vocabulary, token, first, order)
    pieces = sorted(zip(totals["range"].to_pylist(), totals["totals"].to_pylist()))
    machine = Automaton(token, first, grams, np.concatenate([_unpacked(t) for _, t in pieces]).astype(np.int64), n, words, prior)
    known = np.add.reduceat(machine.known.astype(np.int64), first[:-1])
    base = np.add.reduceat(machine.base, first[:-1])
    score = [machine.score(token[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    return pa.Table.from_arrays([
        row["doc_ids"].combine_chunks().flatten(), pa.array(np.diff(first).astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)], schema=arrow)
