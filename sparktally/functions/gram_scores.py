"""Class probabilities of a linear model on character n-grams, computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters of the texts that are scored at once.
CHARACTERS = 1 << 20
#: Scored texts that a task keeps for its next batches.
KEPT = 50_000


class GramModel:
    """Counts of known n-grams, weighted and of unit length, times coefficients: the softmax of the margins.

    The grams form a tree whose levels are sorted arrays of (parent, letter), so all positions of all texts
    descend a level by one binary search, and a position drops out where no gram goes on. Whatever the letters, nothing is hashed.
    """

    def __init__(self, grams: list[str], scaling: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray):
        self.scaling, self.intercepts = scaling, intercepts
        self.coefficients = np.ascontiguousarray(coefficients.T)  # one row per gram
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        codes = np.array(grams, dtype=f"<U{sizes.max()}").view(np.uint32).reshape(len(grams), -1)
        used = np.unique(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32))
        self.letters = np.full(int(used[-1]) + 2, -1, np.int64)  # the last is for all beyond
        self.letters[used] = np.arange(len(used))
        self.width = len(used)
        self.levels, node = [], np.zeros(len(grams), np.int64)
        for n in range(1, codes.shape[1] + 1):
            there = np.flatnonzero(sizes >= n)
            keys, node[there] = np.unique(node[there] * self.width + self.letters[codes[there, n - 1]], return_inverse=True)
            ends = np.full(len(keys), -1, np.int64)
            whole = np.flatnonzero(sizes == n)
            ends[node[whole]] = whole
            self.levels.append((keys, ends))

    def probabilities(self, texts: list[str]) -> np.ndarray:
        out, start, total = np.empty((len(texts), len(self.intercepts))), 0, 0
        for i, text in enumerate(texts):
            total += len(text)
            if total >= CHARACTERS or i + 1 == len(texts):
                out[start:i + 1] = self._scored(texts[start:i + 1])
                start, total = i + 1, 0
        return out

    def _scored(self, texts: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letters[np.minimum(codes, len(self.letters) - 1)]
        doc = np.repeat(np.arange(len(texts)), sizes)
        end = np.cumsum(sizes)[doc]
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for n, (keys, ends) in enumerate(self.levels):
            inside = np.flatnonzero(at + n < end[at])
            at, node = at[inside], node[inside]
            letter = letters[at + n]
            key = np.where(letter < 0, -1, node * self.width + letter)
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = np.flatnonzero(keys[node] == key)
            at, node = at[known], node[known]
            gram = ends[node]
            full = np.flatnonzero(gram >= 0)
            found.append(doc[at[full]] * len(self.scaling) + gram[full])
        entries, counts = np.unique(np.concatenate(found), return_counts=True)
        doc, gram = np.divmod(entries, len(self.scaling))
        weight = counts * self.scaling[gram]
        length = np.sqrt(np.bincount(doc, weight * weight, len(texts)))
        weight = weight / length[doc]
        margins = np.stack([np.bincount(doc, weight * c, len(texts)) for c in self.coefficients[gram].T], axis=1) + self.intercepts
        odds = np.exp(margins - margins.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def gram_probabilities(spark: SparkSession, model: GramModel, text: Column) -> Column:
    """array<double>: one probability per class; a null text counts as empty.

    Equal texts of a batch, and of the batches before it in a task, are scored once. Declared as not deterministic, so
    that a filter on what is made of the scores does not score the texts again.
    """
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shipped.value
        classes = len(held.intercepts)
        places, scored = {}, np.empty((0, classes))
        for texts in batches:
            coded = texts.fill_null("").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            fresh = [t for t in distinct if t not in places]
            if len(places) + len(fresh) > KEPT:
                places, scored, fresh = {}, scored[:0], distinct
            places.update(zip(fresh, range(len(places), len(places) + len(fresh))))
            scored = np.concatenate([scored, held.probabilities(fresh)])
            rows = np.fromiter(map(places.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
            yield pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * classes, scored[rows].ravel())

    return scores.asNondeterministic()(text)
