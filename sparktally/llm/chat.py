"""Chat formatting as prefix trees: conversations that begin alike share the tokens of their common turns.

A turn is ``<|im_start|>role`` and a line break, the text, ``<|im_end|>`` and a line break. Control strings inside a
text are escaped by one more backslash between their first two signs, so none is ever read as a mark,
and every text can be restored. Head, text and end are tokenised apart, so the loss mask, which is the
text of assistant turns, begins and ends between tokens.

Conversations in the order of their turns are the tree in depth-first order: what a conversation shares
with the one before it is on the path already and is not emitted again. Every node (a turn)
carries its token ids, their positions (those of the conversation, not of the sequence) and the
intervals of the sequence that its tokens attend to: its ancestors and itself.

A sequence holds a bounded number of tokens. Ranges of the order go to tasks, so a tree of any size is
spread over tasks and sequences, each of which repeats the stem it needs. Equal conversations are
one class, which one of them stands for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparktally.llm.arrow import discard, few, stored
from sparktally.llm.packing import encoder

# fixed values: the marks of a turn
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Tokens of a sequence; only a longer conversation, alone in its sequence, exceeds it.
CAPACITY = 32_768
#: Bytes of a conversation that is formatted turn by turn instead of as one row.
LONG_BYTES = 8 * CAPACITY
#: Conversations that end in one sequence.
MOST_ENDS = 4096

_MARKED = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}


def escape(text: str) -> str:
    return _MARKED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n|]", lambda m: _ROLE[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\np]", lambda m: _ROLE_BACK[m[0]], role)


_INTERVAL = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _node_schema(conv_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("parent", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("position", T.LongType()),
        T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("attention", T.ArrayType(_INTERVAL)), T.StructField("last_child", T.BooleanType()),
        T.StructField("conv_ids", T.ArrayType(conv_type))])


class Node:
    __slots__ = ("turn", "ids", "loss", "parent", "start", "position", "attention", "last_child", "ends", "number")

    def __init__(self, turn: tuple[str, str], ids: bytes, loss: tuple[int, int] | None, parent: "Node | None", number: int, start: int):
        self.turn, self.ids, self.loss, self.parent, self.number, self.start = turn, ids, loss, parent, number, start
        self.position = parent.position + parent.length if parent else 0
        own = (start, start + self.length)
        if parent is None:
            self.attention = [own]
        elif parent.attention[-1][1] == start:
            self.attention = [*parent.attention[:-1], (parent.attention[-1][0], own[1])]
        else:
            self.attention = [*parent.attention, own]
        self.last_child, self.ends = True, []

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def row(self, sequence: int) -> tuple:
        a, b = self.loss or (0, 0)
        return (sequence, self.number, None if self.parent is None else self.parent.number, self.start, self.length, self.position,
                self.start + a, self.start + b, self.ids, [{"start": s, "end": e} for s, e in self.attention], self.last_child, self.ends)


def turn_ids(enc, role: str, text: str) -> tuple[bytes, tuple[int, int] | None]:
    """Token ids of a turn and, for assistants, the tokens of its text."""
    head, body, tail = enc.encode(f"{START}{escape_role(role)}\n"), enc.encode(escape(text)), enc.encode(f"{END}\n")
    return head + body + tail, (len(head) // 4, (len(head) + len(body)) // 4) if role == ASSISTANT else None


class Trees:
    """Conversations in order to sequences of nodes."""

    def __init__(self, enc, first_sequence: int, capacity: int, most_ends: int):
        self.enc, self.sequence, self.capacity, self.most_ends = enc, first_sequence, capacity, most_ends
        self.nodes: list[Node] = []
        self.path: list[Node] = []
        self.size = self.ends = 0

    def add(self, conv_id, turns: list[tuple[str, str]]) -> list[tuple]:
        """Rows of the sequence that this conversation closes, if it does."""
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared].turn == turns[shared]:
            shared += 1
        fresh = [turn_ids(self.enc, *t) for t in turns[shared:]]
        more = sum(len(ids) for ids, _ in fresh) // 4
        out: list[tuple] = []
        if self.nodes and (self.size + more > self.capacity or self.ends >= self.most_ends):
            stem = [(n.ids, n.loss) for n in self.path[:shared]]
            out = self.close()
            fresh, shared = stem + fresh, 0
        del self.path[shared:]
        for turn, (ids, loss) in zip(turns[shared:], fresh):
            parent = self.path[-1] if self.path else None
            node = Node(turn, ids, loss, parent, len(self.nodes), self.size)
            self.nodes.append(node)
            self.path.append(node)
            self.size += node.length
        self.path[-1].ends.append(conv_id)
        self.ends += 1
        return out

    def close(self) -> list[tuple]:
        seen: set[int | None] = set()
        for node in reversed(self.nodes):
            above = None if node.parent is None else node.parent.number
            node.last_child = above not in seen
            seen.add(above)
        rows = [n.row(self.sequence) for n in self.nodes]
        if rows:
            self.sequence += 1
        self.nodes, self.path, self.size, self.ends = [], [], 0, 0
        return rows


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as Python values, a few at a time."""
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def _trees(convs: DataFrame, tokenizer: str, capacity: int, most_ends: int, schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(encoder(tokenizer), TaskContext.get().partitionId() << 40, capacity, most_ends)
        rows: list[tuple] = []
        for batch in batches:
            for conv_id, turns in _rows(batch):
                rows += trees.add(conv_id, [(t["role"], t["text"]) for t in turns])
                if len(rows) > 1000:
                    yield _batch(rows, arrow)
                    rows = []
        yield _batch(rows + trees.close(), arrow)

    return convs.select("conv_id", "turns").mapInArrow(run, schema)


def _chains(turns: DataFrame, tokenizer: str, schema: T.StructType) -> DataFrame:
    """Sequences of long conversations, turn by turn; rows come sorted, and only the last turn is held."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        sequence = (TaskContext.get().partitionId() << 40) + (1 << 39)  # apart from those of the trees
        held: tuple | None = None
        conv = last = None
        for batch in batches:
            rows = []
            for key, role, text in _rows(batch):
                if held is not None and key == conv:
                    rows.append((*held, []))
                elif held is not None:
                    rows.append((*held, [conv]))
                    sequence, last = sequence + 1, None
                conv = key
                ids, loss = turn_ids(enc, role, text)
                number, start = (0, 0) if last is None else (last[0] + 1, last[1])
                a, b = loss or (0, 0)
                end = start + len(ids) // 4
                held = (sequence, number, None if last is None else number - 1, start, len(ids) // 4, start, start + a, start + b, ids,
                        [{"start": 0, "end": end}], True)
                last = (number, end)
            yield _batch(rows, arrow)
        if held is not None:
            yield _batch([(*held, [conv])], arrow)

    return turns.select("conv_id", "role", "text").mapInArrow(run, schema)


def format_chats(turns: DataFrame, tokenizer: str, capacity: int = CAPACITY, long_bytes: int = LONG_BYTES,
                 most_ends: int = MOST_ENDS, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of all conversations.

    ``nodes`` has a row per turn of a sequence: sequence_id, node (its number in depth-first order), parent,
    start and length (tokens in the sequence), position (of its first token in the conversation, the others
    follow), loss_start and loss_end (tokens in the sequence), ids (binary, little-endian uint32), attention
    (intervals of the sequence up to its last token; inside its own it is causal), last_child (no later
    node has its parent), conv_ids (representatives that end here). ``members`` has a row per conversation: conv_id,
    rep_id, sequence_id, node: where its representative ends.

    A null text or role is empty. Turns of equal number go by role, then text, each of a repeated row is a
    turn, null numbers come first. Rows without a conv_id are one conversation. Conversations of more than
    ``long_bytes`` are a sequence each and are never held whole; so texts and conversations may be of any length.
    An empty table gives no rows, extra columns are ignored. Runs jobs and writes to the shared
    folder while it is being planned.
    """
    src = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"))
    spark = turns.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), "turn", "role", "text").cast("decimal(20,0)")).cast("string")

    sizes = stored(src.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("role") + F.octet_length("text") + 32).alias("bytes"),
        total(1).alias("a"), total(2).alias("b")), "sizes")
    equal = ["n", "bytes", "a", "b"]
    # of one class one stands for all; the class without an id, if any, stands for itself
    reps = stored(sizes.where("conv_id IS NOT NULL").groupBy(equal).agg(F.min("conv_id").alias("rep_id")).withColumn(
        "alone", F.col("bytes") > F.lit(long_bytes)), "classes")
    nameless = sizes.where("conv_id IS NULL").select(F.col("conv_id").alias("rep_id"), (F.col("bytes") > F.lit(long_bytes)).alias("alone"))
    wanted = stored(reps.select("rep_id", "alone").union(nameless), "wanted")
    picked = few(wanted)
    rows = src.join(picked, F.col("conv_id").eqNullSafe(F.col("rep_id")))

    schema = _node_schema(turns.schema[conv_id].dataType)
    short = stored(
        rows.where("NOT alone").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .withColumn("path", F.expr("transform(turns, t -> xxhash64(t.role, t.text))")), "conversations")
    ordered = short.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    chains = rows.where("alone").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    nodes = stored(_trees(ordered, tokenizer, capacity, most_ends, schema).union(_chains(chains, tokenizer, schema)), "nodes")
    discard(wanted, short)

    ends = nodes.where(F.size("conv_ids") > 0).select(F.explode("conv_ids").alias("at"), "sequence_id", "node")
    members = sizes.join(reps, equal, "left").select(
        "conv_id", F.when(F.col("conv_id").isNotNull(), F.col("rep_id")).alias("rep_id"))
    members = members.join(ends, F.col("rep_id").eqNullSafe(F.col("at"))).select("conv_id", "rep_id", "sequence_id", "node")
    return nodes, members


class Digests:
    """Of the turns read so far: how many, hash of all, characters and hash of the text under the loss mask, formatted characters."""

    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def __init__(self):
        self.n = self.loss = self.chars = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def copy(self) -> "Digests":
        out = Digests()
        out.n, out.loss, out.chars = self.n, self.loss, self.chars
        out.turns, out.masked = self.turns.copy(), self.masked.copy()
        return out

    def add(self, role: str, text: str, masked: str, chars: int) -> None:
        self.n, self.loss, self.chars = self.n + 1, self.loss + len(masked), self.chars + chars
        self.turns.update(f"{role}\n{text}\n".encode())
        self.masked.update(masked.encode())

    def result(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(nodes: DataFrame, tokenizer: str, digests: type = Digests) -> DataFrame:
    """sequence_id, node and the digests' columns, for every node where a conversation ends.

    Each turn on the way from the root is restored from the node's ids and told to ``add``: role, text, the text
    under the loss mask, and the formatted characters. Sequences are read in order of their nodes; the state
    of a node is kept only while another branch may need it.
    """
    spark = nodes.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType.fromDDL(f"sequence_id long, node long, {digests.schema}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        states: dict = {}
        sequence = None
        for row_batch in batches:
            out = []
            for at, node, parent, last_child, ids, loss_start, loss_end, ends in _rows(row_batch):
                if at != sequence:
                    sequence, states = at, {}
                if parent is None:
                    mine = digests()
                else:
                    mine = states.pop(parent) if last_child else states[parent].copy()
                mine.add(*parse(enc, ids, loss_start, loss_end))
                states[node] = mine
                if ends:
                    out.append((sequence, node, *mine.result()))
            yield _batch(out, arrow)

    ordered = nodes.select(
        "sequence_id", "node", "parent", "last_child", "ids", F.col("loss_start") - F.col("start"), F.col("loss_end") - F.col("start"),
        F.size("conv_ids") > 0).repartition(parts, "sequence_id").sortWithinPartitions("sequence_id", "node")
    return ordered.mapInArrow(run, schema)


def parse(enc, ids: bytes, loss_start: int, loss_end: int) -> tuple[str, str, str, int]:
    """role, text, text under the loss mask (all unescaped) and formatted characters of a turn's ids."""
    numbers = np.frombuffer(ids, "<u4")
    whole = decode(enc, numbers)
    if not whole.startswith(START) or not whole.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    role, text = whole[len(START):-len(END) - 1].split("\n", 1)
    return unescape_role(role), unescape(text), unescape(decode(enc, numbers[loss_start:loss_end])), len(whole)


def decode(enc, ids: np.ndarray) -> str:
    return enc.merges.decode_bytes(ids.tolist()).decode()
