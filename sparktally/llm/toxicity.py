"""Toxicity by multiple-instance learning.

Only documents have labels, but a document is toxic because of some sentence. Each
sentence gets a probability from a logistic model on its words and word beginnings;
the document's is their noisy-or, one minus the product of the complements. A sentence
without any feature of the model cannot offend, however many there are. The likelihood of the document labels trains the sentence model, which then also tells the
offending sentences.

Features are 64-bit hashes looked up in the trained vocabulary, so a word that was not
trained has no weight and cannot collide with one that was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktally.llm.arrow import plain, schema_of
from sparktally.llm.samples import labelled, sampled_texts
from sparktally.llm.words import NON_WORD, hash_spans, mix, slices, text_bytes, words_of

#: Labelled documents of each class to fit on.
PER_CLASS = 4000
#: Features of the sentence model: those that tell the classes apart best.
FEATURES = 20_000
PREFIXES = (4, 5)
THRESHOLD = 0.7
#: Text bytes that are scored at once; a worker holds some twenty times as much.
SLICE = 1 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


@dataclass
class Model:
    """Sorted feature hashes with weights, and the bias of a sentence; ``prior`` replaces them if nothing was learnt."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float | None = None


class Sentences:
    """Features of a slice's sentences: feature hash, sentence, and for sentences their row, start, end (bytes)."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        found = words_of(column, NON_WORD)
        # a sentence ends behind each mark; every row begins one
        self.starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(_ENDS[data]) + 1]))
        self.starts = self.starts[self.starts < len(data)]
        self.stops = np.concatenate([self.starts[1:], [len(data)]])[:len(self.starts)]
        sentence = np.searchsorted(self.starts, found.starts, "right") - 1
        hashes, owners = [found.hashes], [sentence]
        for n in PREFIXES:
            long = np.flatnonzero(found.ends - found.starts > n)
            starts = found.starts[long]
            hashes.append(mix(hash_spans(found.data, starts, starts + n) + np.uint64(n)))
            owners.append(sentence[long])
        self.features, self.sentence = np.concatenate(hashes), np.concatenate(owners)
        used = np.unique(sentence)  # sentences without words are none
        self.number = np.full(len(self.starts), -1)
        self.number[used] = np.arange(len(used))
        self.used = used
        self.row = np.searchsorted(offsets, self.starts[used], "right") - 1
        self.data = data
        self.offsets = offsets


def _feature_counts(texts: DataFrame) -> DataFrame:
    """feature, documents of label 0 and of label 1 that have it; one partial row per slice."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("feature", "no", "yes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Sentences(part.column(0))
                if not len(found.features):
                    continue
                label = part.column(1).to_numpy()
                row = found.row[found.number[found.sentence]]
                values, code = np.unique(found.features, return_inverse=True)
                pair = np.unique(code.astype(np.int64) * part.num_rows + row)
                code, yes = pair // part.num_rows, label[pair % part.num_rows] == 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(values.view(np.int64)), pa.array(np.bincount(code[~yes], minlength=len(values))),
                    pa.array(np.bincount(code[yes], minlength=len(values)))], names=["feature", "no", "yes"])

    return texts.mapInArrow(run, schema).groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))


def _bags(texts: DataFrame, features: np.ndarray) -> DataFrame:
    """label, number of sentences, and (sentence << 32 | feature number) pairs per document."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("sentences", T.IntegerType()),
                           T.StructField("pairs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Sentences(part.column(0))
                spot = np.minimum(np.searchsorted(features, found.features), len(features) - 1)
                known = features[spot] == found.features
                sentence = found.number[found.sentence[known]]
                pair = np.unique(sentence << 32 | spot[known])
                row = found.row[pair >> 32]
                total = np.bincount(found.row, minlength=part.num_rows)
                first = np.concatenate([[0], np.cumsum(total)])
                pair -= first[row] << 32
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(1).cast(pa.int32()), pa.array(total.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(pair))], names=["label", "sentences", "pairs"])

    return texts.mapInArrow(run, schema)


def noisy_or(log_clear: np.ndarray) -> np.ndarray:
    return -np.expm1(log_clear)


def fit_sentences(label: np.ndarray, sentences: np.ndarray, pairs: list[np.ndarray], n_features: int,
                  rounds: int = 250, rate: float = 0.1, lasso: float = 0.0, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights, none negative, and bias that maximise the likelihood of the document labels.

    ``lasso`` is taken off times the weights, ``ridge`` times half their squares.

    Adam on the whole sample with a proximal step in its metric: a feature gets a weight only if
    its slope exceeds ``lasso``, which words that merely stand in a few toxic documents do not.
    """
    sizes = np.array([len(p) for p in pairs])
    first = np.concatenate([[0], np.cumsum(sentences)])
    flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    sentence = (flat >> 32) + np.repeat(first[:-1], sizes)
    feature = flat & 0xFFFFFFFF
    doc = np.repeat(np.arange(len(label)), sentences)
    balance = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    offers = np.bincount(sentence, minlength=len(doc)) > 0
    w = np.zeros(n_features + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, w[feature], minlength=len(doc)) + w[-1]
        p = np.where(offers, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        clear = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(label))
        toxic = np.maximum(noisy_or(clear), 1e-9)
        scale = np.where(label == 1, (1 - toxic) / toxic, -1.0) * balance
        slope = scale[doc] * p
        g = np.append(np.bincount(feature, slope[sentence], minlength=n_features), slope.sum())
        g[:-1] -= ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w += pace * m / (1 - 0.9**step)
        w[:-1] = np.maximum(w[:-1] - pace[:-1] * lasso, 0)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 1, per_class: int = PER_CLASS,
          features: int = FEATURES, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Sentence model from at most ``per_class`` documents of each label outside the held-out fold.

    Labels other than 0 and 1, and ids with both, are left out. Without documents of both
    labels the model is their share of 1, or 0 without any.
    """
    texts = sampled_texts(plain(docs, doc_id, text), labelled(labels, label, held_out, doc_id=doc_id), per_class, doc_id, text)
    counts = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    none = np.zeros(0, np.uint64)
    if len(counts) < 2:
        return Model(none, np.zeros(0, np.float32), 0.0, float(1 in counts))
    n0, n1 = counts[0], counts[1]
    total = F.col("no") + F.col("yes")
    lean = F.col("yes") / n1 - F.col("no") / n0
    best = (
        _feature_counts(texts).where(total >= 3)
        .select("feature", (lean * lean / (total * (n0 + n1 - total) + 1)).alias("score"))
        .orderBy(F.desc("score"), "feature").limit(features)
    )
    chosen = np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))
    if not len(chosen):
        return Model(none, np.zeros(0, np.float32), 0.0, n1 / (n0 + n1))
    bags = _bags(texts, chosen).toArrow()
    label, sentences = bags["label"].to_numpy().astype(np.int64), bags["sentences"].to_numpy().astype(np.int64)
    pairs = [np.asarray(p.values) for p in bags["pairs"]]
    kept, weights, bias = fit_selected(label, sentences, pairs, len(chosen))
    return Model(chosen[kept], weights.astype(np.float32), bias)


def fit_selected(label: np.ndarray, sentences: np.ndarray, pairs: list[np.ndarray], n_features: int,
                 lasso: float = 0.02, ridge: float = 0.06) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with a weight, weights, bias): chosen with a lasso, then fitted with a ridge, which shrinks less.

    The lasso falls with the root of the number of documents of label 1, as their chance
    slopes do; the ridge with the number, so it weighs as much as a fixed part of a document.
    """
    n = max(1, int(label.sum()))
    weights, _ = fit_sentences(label, sentences, pairs, n_features, lasso=lasso / n**0.5)
    kept = np.flatnonzero(weights > 0.05)
    number = np.full(n_features, -1)
    number[kept] = np.arange(len(kept))
    pairs = [p[number[p & 0xFFFFFFFF] >= 0] for p in pairs]
    pairs = [p >> 32 << 32 | number[p & 0xFFFFFFFF] for p in pairs]
    weights, bias = fit_sentences(label, sentences, pairs, len(kept), ridge=ridge / n)
    return kept, weights, bias


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id",
             text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, score (0 to 1), predicted (0 or 1), sentences (start, end in code points, score) per row.

    ``sentences`` are those that alone reach one half. Null, empty and wordless texts have no sentence
    and score 0. Repeated rows get the same values, a null doc_id stays null, an empty table gives
    no rows, extra columns are ignored, long texts are read whole. A carried text is not sent twice.
    """
    src = plain(docs, doc_id, text, *[c for c in carry if c != text])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("score", T.DoubleType())])
    schema, arrow = schema_of(src, doc_id, *carry, score=T.DoubleType(), predicted=T.IntegerType(), sentences=T.ArrayType(span))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text, SLICE):
                score, spans = _score(part.column(1), part.num_rows, model)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[part.column(c) for c in carry], pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                    pa.array(spans, arrow.field("sentences").type)], schema=arrow)

    return src.mapInArrow(run, schema)


def _score(column: pa.Array, n: int, model: Model) -> tuple[np.ndarray, list]:
    spans: list = [[] for _ in range(n)]
    if model.prior is not None or not len(model.features):
        return np.full(n, model.prior or 0.0), spans
    found = Sentences(column)
    spot = np.minimum(np.searchsorted(model.features, found.features), len(model.features) - 1)
    known = model.features[spot] == found.features
    pair = np.unique(found.number[found.sentence[known]] << 32 | spot[known])  # a repeated word counts once
    z = np.bincount(pair >> 32, model.weights[pair & 0xFFFFFFFF], minlength=len(found.row)) + model.bias
    p = np.where(np.bincount(pair >> 32, minlength=len(found.row)) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
    score = noisy_or(np.bincount(found.row, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
    worst = np.flatnonzero(p >= 0.5)
    if len(worst):
        chars = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
        for s in worst:
            base = chars[found.offsets[found.row[s]]]
            at = found.used[s]
            spans[found.row[s]].append({"start": int(chars[found.starts[at]] - base),
                                        "end": int(chars[found.stops[at]] - base), "score": float(p[s])})
    return np.clip(score, 0.0, 1.0), spans
