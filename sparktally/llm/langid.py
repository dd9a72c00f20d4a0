"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts over all training texts are summed per task and language, then shuffled as
partial sums. The log-probability matrix (languages x buckets) is broadcast; its size is
the number of label values times the buckets. A batch is scored in numpy: bucket numbers
of all n-grams, their matrix columns, one sum per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktally.llm.arrow import fold, plain, schema_of
from sparktally.llm.words import slices, text_bytes

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages x buckets that may be broadcast (4 bytes each).
MOST_CELLS = 1 << 27
UNKNOWN = "und"
_SLICE = 1 << 20


def gram_buckets(points: np.ndarray, order: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the n-gram that begins at every code point but the last order - 1."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = np.full(n, order, np.uint32)
    for j in range(order):
        value = (value ^ points[j:j + n]) * np.uint32(0x9E3779B1)
        value ^= value >> np.uint32(15)
    return (value % np.uint32(buckets)).astype(np.int64)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and where each row begins (one more than rows)."""
    data, offsets = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").lower().encode("utf-32-le"), np.uint32) if len(data) else \
        np.zeros(0, np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if len(points) != begins[-1]:  # lower case of another length: row by row
        texts = [("" if t is None else t).lower() for t in column.to_pylist()]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return points, begins


def _row_grams(points: np.ndarray, begins: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams inside rows, and where each row's begin."""
    all_grams = gram_buckets(points, order, buckets)
    sizes = np.maximum(np.diff(begins) - order + 1, 0)
    inside = np.ones(len(all_grams), bool)
    for back in range(1, order):  # those that would reach into the next row
        at = begins[1:-1] - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return all_grams[inside], np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log share of each language
    table: np.ndarray  # (orders * buckets, languages) log-probabilities


def train(docs: DataFrame, folds: int = 5, held_out: int = 0, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS,
          doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Model of all rows with a language outside the held-out fold; None without such rows."""
    rows = plain(docs, doc_id, text, lang).where(F.col(lang).isNotNull() & (fold(doc_id, folds) != held_out)).select(text, lang)
    schema = T.StructType([T.StructField("lang", rows.schema[lang].dataType), T.StructField("bucket", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text, _SLICE):
                points, begins = code_points(part.column(0))
                names, code = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
                for k, order in enumerate(orders):
                    grams, first = _row_grams(points, begins, order, buckets)
                    cell = np.repeat(code, np.diff(first)) * buckets + grams
                    found = np.bincount(cell, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for name, row in zip(names, found):
                        sums.setdefault(name, np.zeros(len(orders) * buckets, np.int64))[k * buckets:(k + 1) * buckets] += row
                for name, n in zip(names, np.bincount(code)):
                    sums.setdefault(f"{name}\0rows", np.zeros(1, np.int64))[0] += n
        for name, row in sums.items():
            name, _, rows_of = name.partition("\0")
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array((at - bool(rows_of)).astype(np.int32)), pa.array(row[at])],
                names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).toArrow()
    if not by_lang.num_rows:
        return None
    if by_lang.num_rows * len(orders) * buckets > MOST_CELLS:
        raise ValueError(f"{by_lang.num_rows} languages need a larger broadcast: fewer buckets, or MOST_CELLS")
    order = np.argsort(np.array(by_lang["lang"].to_pylist()))
    table = np.zeros((len(order), len(orders) * buckets))
    sizes = np.zeros(len(order))
    cells = by_lang["cells"].combine_chunks()
    for i, at in enumerate(order):
        own = cells[int(at)].values
        bucket, n = np.asarray(own.field("bucket")), np.asarray(own.field("n"))
        sizes[i] = n[bucket == -1].sum()
        table[i, bucket[bucket >= 0]] = n[bucket >= 0]
    for k in range(len(orders)):
        part = table[:, k * buckets:(k + 1) * buckets] + 0.5
        table[:, k * buckets:(k + 1) * buckets] = np.log(part / part.sum(axis=1, keepdims=True))
    names = [by_lang["lang"][int(at)].as_py() for at in order]
    return Model(names, np.log(sizes / sizes.sum()), np.ascontiguousarray(table.T.astype(np.float32)))


def predict(docs: DataFrame, model: Model | None, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's posterior probability) per row.

    ``und`` with score 0 if the text is null, has no letters, or nothing was learnt. Repeated rows get
    equal values, ties go to the first language by name, a null doc_id stays null, an empty table
    gives no rows, extra columns are ignored, long texts are read whole.
    """
    src = plain(docs, doc_id, text)
    schema, arrow = schema_of(src, doc_id, lang_pred=T.StringType(), score=T.DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text, _SLICE):
                texts = part.column(1).to_pylist()
                lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                if model is None:
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    names, score = _posterior(part.column(1), model, orders, buckets)
                    names = [n if ok else UNKNOWN for n, ok in zip(names, lettered)]
                    score = np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score)], schema=arrow)

    return src.mapInArrow(run, schema)


def _posterior(column: pa.Array, model: Model, orders: tuple[int, ...], buckets: int) -> tuple[list[str], np.ndarray]:
    points, begins = code_points(column)
    total = np.tile(model.prior, (len(column), 1))
    for k, order in enumerate(orders):
        grams, first = _row_grams(points, begins, order, buckets)
        filled = np.flatnonzero(np.diff(first))
        if len(filled):
            for language in range(len(model.languages)):
                logs = model.table[k * buckets:(k + 1) * buckets, language].astype(np.float64)
                total[filled, language] += np.add.reduceat(logs[grams], first[filled])
    best = total.argmax(axis=1)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    return [model.languages[b] for b in best], 1 / share.sum(axis=1)
