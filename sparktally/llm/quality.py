"""Quality classifier: a byte-level convolution in numpy.

A text is its bytes, cut into chunks of 256 that overlap so that every window of bytes
lies inside a chunk. Learned filters see every window; their maxima over a chunk pass a
rectifier. Means and maxima of these over all chunks of the document enter one logistic
unit. Filters, biases and unit are trained together by gradient descent; through a
maximum the gradient reaches one window only, so training is cheap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparktally.llm.arrow import plain, schema_of
from sparktally.llm.samples import labelled, sampled_texts
from sparktally.llm.words import slices, text_bytes

CHUNK = 256
WIDTH = 5
FILTERS = 16
#: Labelled documents of each class to fit on.
PER_CLASS = 1000
THRESHOLD = 0.5
_STEP = CHUNK - WIDTH + 1
_PIECE = 1 << 16


@dataclass
class Model:
    """``filters`` (WIDTH, 256, FILTERS), ``bias`` (FILTERS), ``unit`` (2 * FILTERS + 1); or only a prior."""

    filters: np.ndarray | None
    bias: np.ndarray | None
    unit: np.ndarray | None
    prior: float = 0.5


def chunk_maxima(data: np.ndarray, filters: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(chunks, FILTERS) maxima of the filter sums over each chunk's windows, and the windows that reach them.

    A chunk begins at every _STEP-th byte and holds the windows that begin in that step; a
    text shorter than a window is filled up with zero bytes.
    """
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    windows = len(data) - WIDTH + 1
    top, place = [], []
    for at in range(0, windows, _STEP * (_PIECE // _STEP)):
        stop = min(at + _STEP * (_PIECE // _STEP), windows)
        sums = filters[0][data[at:stop]]
        for j in range(1, WIDTH):
            sums += filters[j][data[at + j:stop + j]]
        begins = np.arange(0, stop - at, _STEP)
        top.append(np.maximum.reduceat(sums, begins, axis=0))
        if where:
            for k, b in enumerate(begins):
                place.append(at + b + sums[b:b + _STEP].argmax(axis=0))
    return np.concatenate(top), np.array(place) if where else None


def document_features(top: np.ndarray, bias: np.ndarray) -> np.ndarray:
    active = np.maximum(top + bias, 0)
    return np.concatenate([active.mean(axis=0), active.max(axis=0), [1.0]])


def fit(texts: list[bytes], label: np.ndarray, rounds: int = 10, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on shuffled groups of documents; classes count alike."""
    rng = np.random.default_rng(seed)
    filters = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
    bias = np.zeros(FILTERS, np.float32)
    unit = rng.normal(0, 0.3, 2 * FILTERS + 1).astype(np.float32)
    unit[-1] = 0
    params = [filters, bias, unit]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    data = [np.frombuffer(t, np.uint8) if t else np.zeros(0, np.uint8) for t in texts]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for group in np.array_split(order, max(1, len(order) // 32)):
            grads = [np.zeros_like(p) for p in params]
            for i in group:
                x = data[i] if len(data[i]) >= WIDTH else np.concatenate([data[i], np.zeros(WIDTH - len(data[i]), np.uint8)])
                top, place = chunk_maxima(x, filters, where=True)
                active = np.maximum(top + bias, 0)
                h = np.concatenate([active.mean(axis=0), active.max(axis=0), [1.0]])
                p = 1 / (1 + np.exp(-np.clip(h @ unit, -30, 30)))
                slope = (p - label[i]) * weight[i] / len(group)
                grads[2] += slope * h
                back = np.full(active.shape, 1.0 / len(active)) * unit[:FILTERS]
                back[active.argmax(axis=0), np.arange(FILTERS)] += unit[FILTERS:2 * FILTERS]
                back *= (active > 0) * slope
                grads[1] += back.sum(axis=0)
                for j in range(WIDTH):
                    np.add.at(grads[0], (j, x[place + j], np.arange(FILTERS)[None, :]), back)
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                g += 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(filters, bias, unit)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 1, per_class: int = PER_CLASS,
          doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``per_class`` whole documents of each label outside the held-out fold.

    Labels other than 0 and 1, and ids with both, are left out. Without documents of both
    labels the model is their share of 1, or one half without any.
    """
    chosen = labelled(labels, label, held_out, doc_id=doc_id)
    rows = sampled_texts(plain(docs, doc_id, text), chosen, per_class, doc_id, text).toArrow()
    rows = sorted(zip([t or "" for t in rows["text"].to_pylist()], rows["label"].to_pylist()))  # whatever the order of tasks
    marks = np.array([m for _, m in rows], np.int64)
    if len(set(marks.tolist())) < 2:
        return Model(None, None, None, float(marks.mean()) if len(marks) else 0.5)
    return fit([t.encode() for t, _ in rows], marks)


def quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (0 or 1) per row.

    Null and empty texts are one chunk of zero bytes. Repeated rows get the same values, a
    null doc_id stays null, an empty table gives no rows, extra columns are ignored, long
    texts are read whole.
    """
    src = plain(docs, doc_id, text)
    schema, arrow = schema_of(src, doc_id, score=T.DoubleType(), predicted=T.IntegerType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text):
                score = scores(part.column(1), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=arrow)

    return src.mapInArrow(run, schema)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    if model.filters is None:
        return np.full(len(column), model.prior)
    data, offsets = text_bytes(column)
    out = np.empty(len(column))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        top, _ = chunk_maxima(data[a:b], model.filters)
        out[i] = document_features(top, model.bias) @ model.unit
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))
