"""Best-fit packing of tokenised documents into sequences of fixed length.

Every document is the ids of its text, then a stop id. Longer documents are cut
into full pieces, of which the first may be shorter. Each task packs the pieces
it sees, online and in bounded space: a fixed number of open bins, found through
a bitset keyed by free space. A piece goes to the bin it fills best; when one bin
too many is open, the fullest closes. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparktally.llm.arrow import plain, schema_of
from sparktally.llm.words import slices

CAPACITY = 2048
OPEN_BINS = 1024
STOP_ID = 0

_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_LATIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*\Z")
# fixed values: the pattern of the byte-level vocabulary, and its signs for bytes that do not print
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGNS = iter(range(256, 512))
_BYTE_SIGNS = [chr(b if b in _PRINTED else next(_SIGNS)) for b in range(256)]
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizer of the file.

    Texts of Latin letters, ASCII signs and plain white space are merged by tiktoken with
    the vocabulary of the same file, in a quarter of the time; all others by the
    tokenizer itself, since its classes of letters and spaces may be newer or older.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte_of = {sign: b for b, sign in enumerate(_BYTE_SIGNS)}
        ranks = {bytes([byte_of[c] for c in token]): i
                 for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.merges = tiktoken.Encoding(path, pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if text.isascii() and not _CONTROL.search(text) or _LATIN.match(text):
            try:
                return self.merges.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its pattern gives up on some million blanks in a row
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Bins:
    """At most ``most`` open bins; ``place`` gives (bin number, offset)."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most, self.used, self.open = capacity, most, 0, 0
        self.free_bits = 0  # bit f: an open bin has f places free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.used
            self.used += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.open += 1
            if self.open > self.most:  # the fullest has the least space
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        return number, self.capacity - free


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones behind a first one that takes the rest."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian uint32), sequence_id, offset.

    Null and empty texts are the stop id alone. Repeated rows are packed each. A null
    doc_id stays null. An empty table gives no rows. Extra columns are ignored. A very
    long text gives many full pieces. The pieces of about 2 MB of text are taken longest first, equally full bins the last
    touched first. Sequence numbers are unique over all tasks and
    gapless inside each sequence; a task run again gives the same rows.
    """
    src = plain(docs, doc_id, text)
    schema, arrow = schema_of(
        src, doc_id, piece=T.IntegerType(), start=T.LongType(), length=T.LongType(), ids=T.BinaryType(),
        sequence_id=T.LongType(), offset=T.LongType())
    stop = np.array([STOP_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36
        bins = Bins(capacity, open_bins)
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                ids = [enc.encode(t or "") + stop for t in part.column(1).to_pylist()]
                cut = [(row, k, start, n) for row, x in enumerate(ids)
                       for k, (start, n) in enumerate(pieces_of(len(x) // 4, capacity))]
                cut.sort(key=lambda p: -p[3])  # of those at hand, the longest first
                places = [bins.place(p[3]) for p in cut]
                rows = pa.array([p[0] for p in cut], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(rows), pa.array([p[1] for p in cut], pa.int32()),
                    pa.array([p[2] for p in cut], pa.int64()), pa.array([p[3] for p in cut], pa.int64()),
                    pa.array([ids[r][4 * s:4 * (s + n)] for r, _, s, n in cut], pa.binary()),
                    pa.array([task + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64()),
                ], schema=arrow)

    return src.mapInArrow(run, schema)
