"""Trained operators: hand-made data they must learn, held-out accuracy on the tables, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparktally.llm import langid, lm, quality, toxicity
from tests.llm.conftest import frame, words


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"), big


# ---------------------------------------------------------------- language

def test_language_held_out(tables):
    docs, _, _ = tables
    got = langid.predict(docs, langid.train(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    out = got[[remainder(i, 5) == 0 for i in got.doc_id]]
    assert len(out) > 100 and (out.lang_pred == out.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_equals_plain_bayes(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcd " if i % 2 else "cdef é") for _ in range(30)), "x" if i % 2 else "y") for i in range(40)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    counts = {k: [Counter() for _ in langid.ORDERS] for k in "xy"}
    n = Counter()

    def grams(t, o):
        points = np.array([ord(c) for c in t], np.uint32)
        return langid.gram_buckets(points, o).tolist()

    for i, t, k in rows:
        if remainder(i, 5):
            n[k] += 1
            for c, o in zip(counts[k], langid.ORDERS):
                c.update(grams(t, o))
    for i, t, _ in rows:
        logs = {}
        for k in "xy":
            logs[k] = math.log(n[k] / sum(n.values()))
            for c, o in zip(counts[k], langid.ORDERS):
                total = sum(c.values()) + 0.5 * langid.BUCKETS
                logs[k] += sum(math.log((c[g] + 0.5) / total) for g in grams(t, o))
        best = max(logs, key=logs.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)


def test_language_odd_rows(odd, nothing):
    got = langid.predict(odd, langid.train(odd)).collect()
    assert len(got) == 17
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 12)) and by[8].lang_pred == "en"
    assert langid.train(nothing) is None and langid.predict(nothing, None).collect() == []
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


# ---------------------------------------------------------- language model

def brute_lm(rows, folds=5, held_out=1, order=lm.ORDER, prior=lm.PRIOR):
    """Scores from the definition: Dirichlet priors over dictionaries of all n-grams."""
    docs = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    train = [w for i, w in docs if remainder("" if i is None else i, folds) != held_out]
    counts = {k: Counter(tuple(w[i:i + k]) for w in train for i in range(len(w) - k + 1)) for k in range(1, order + 1)}
    uni = Counter({k[0]: c for k, c in counts[1].items()})
    n, v = sum(uni.values()), len(uni)

    def prob(history, word):
        if not history:
            return (uni[word] + 0.5) / (n + 0.5 * (v + 1))
        return (counts[len(history) + 1][(*history, word)] + prior * prob(history[1:], word)) / (counts[len(history)][history] + prior)

    out = []
    for i, w in docs:
        base = sum(math.log10(prob((), x)) for x in w)
        full = sum(math.log10(prob(tuple(w[max(0, k - order + 1):k]), x)) for k, x in enumerate(w))
        out.append((i, len(w), sum(uni[x] > 0 for x in w), n, base, full))
    return out, prob, uni


def language(seed, n):
    rng = random.Random(seed)
    w, out = "a", []
    for _ in range(n):
        w = rng.choice({"a": "bbbc", "b": "cad", "c": "aab", "d": "dabe", "e": "ax"}.get(w, "ae"))
        out.append(w if rng.random() < 0.95 else f"rare{rng.randint(0, 40)}")
    return " ".join(out)


@pytest.mark.parametrize("block_bytes, range_bytes, order", [(1, 1 << 20, 2), (400, 50, 3), (1 << 20, 1 << 20, 2), (1 << 20, 300, 4), (300, 300, 1)])
def test_scores_equal_the_definition(spark, block_bytes, range_bytes, order):
    rows = [(i, language(i, 5 + i % 37)) for i in range(60)] + [(70, ""), (71, None), (10**15, language(99, 50)), (3, language(3, 8)), (None, "a b c"), (None, "a b c")]
    want, prob, uni = brute_lm(rows, order=order)
    got = lm.score_texts(frame(spark, rows), order=order, block_bytes=block_bytes, range_bytes=range_bytes).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), *r[1:4], round(r[4], 6))
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(found, sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-9)
    for history in [(), ("a",), ("a", "b"), ("zz", "b"), ("d", "d")]:  # probabilities sum to one
        assert sum(prob(history[-order + 1:] if order > 1 else (), x) for x in uni) == pytest.approx(
            1 - prob(history[-order + 1:] if order > 1 else (), "unknown"), abs=1e-9)
    if order > 1:
        held = [r for r in got if remainder("" if r.doc_id is None else r.doc_id, 5) == 1]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_texts_that_occur_twice_stand_out(spark):
    rows = [(i, words(i, 60)) for i in range(200)] + [(1000 + i, words(i, 60)) for i in range(20)]
    got = {r.doc_id: r.score - r.base_score for r in lm.score_texts(frame(spark, rows)).collect()}
    learnt = [i for i in range(20) if remainder(i, 5) != 1 and remainder(1000 + i, 5) != 1]
    others = [v for i, v in got.items() if 20 <= i < 1000]
    assert len(learnt) > 5 and min(got[i] for i in learnt) > max(others)


def test_language_model_odd_rows(odd, nothing):
    got = lm.score_texts(odd).collect()
    assert len(got) == 17 and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert sum(r.doc_id is None for r in got) == 2 and {r.n_tokens for r in got if r.doc_id == 4} == {40_001}
    assert lm.score_texts(nothing).collect() == []


# ------------------------------------------------------------- toxicity

def test_toxic_sentences_are_found_from_document_labels(spark):
    rng = random.Random(2)
    bad = ["scumbag", "moronic", "vermin"]
    rows, marks = [], []
    for i in range(600):
        parts = [words(7 * i + k, rng.randint(3, 9)) for k in range(rng.randint(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] += f" {rng.choice(bad)} {words(i, 2)}"
        rows.append((i, ". ".join(parts) + "."))
        marks.append((i, 1, int(toxic)))
    docs = frame(spark, rows)
    got = toxicity.toxicity(docs, toxicity.train(docs, labels_of(spark, marks))).collect()
    held = [r for r in got if remainder(r.doc_id, 3) == 1]
    assert all((r.predicted == 1) == (r.doc_id % 6 == 0) for r in held)
    text = dict(rows)
    for r in held:
        if r.doc_id % 6 == 0:
            assert [any(b in text[r.doc_id][s.start:s.end] for b in bad) for s in r.sentences] == [True]


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = labels_of(spark, [(1, 1, 1), (4, 1, 0), (6, None, 1), (6, 0, 0), (None, 1, 1), (99, 1, 1), (5, 0, 7)])
    got = toxicity.toxicity(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(odd, labels.limit(0))
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.0}
    assert toxicity.toxicity(nothing, none).collect() == [] and toxicity.train(nothing, labels).prior == 0.0


# -------------------------------------------------------------- quality

def test_quality_held_out(tables):
    docs, labels, _ = tables
    got = quality.quality(docs, quality.train(docs, labels)).toPandas().merge(labels.toPandas())
    out = got[[remainder(i, 3) == 1 for i in got.doc_id]]
    assert len(out) > 80 and (out.predicted == out.quality).mean() > 0.93


def test_chunks_cover_every_window():
    rng = np.random.default_rng(0)
    filters = rng.normal(size=(quality.WIDTH, 256, 3)).astype(np.float32)
    for n in (0, 1, 5, 251, 252, 253, 600, 66_000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        top, place = quality.chunk_maxima(data, filters, where=True)
        x = data if n >= quality.WIDTH else np.concatenate([data, np.zeros(quality.WIDTH - n, np.uint8)])
        sums = sum(filters[j][x[j:len(x) - quality.WIDTH + 1 + j]] for j in range(quality.WIDTH))
        assert np.allclose(top.max(axis=0), sums.max(axis=0), atol=1e-5)
        assert len(top) == -(-len(sums) // (quality.CHUNK - quality.WIDTH + 1))
        assert np.allclose(np.take_along_axis(sums, place, 0), top, atol=1e-5)


def test_quality_odd_rows(spark, odd, nothing):
    labels = labels_of(spark, [(1, 1, 1), (4, 0, 0), (6, None, 1), (6, 0, 0), (None, 1, 1), (99, 1, 1), (-5, 1, 0), (9, 0, 0)])
    got = quality.quality(odd, quality.train(odd, labels)).collect()
    assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
    none = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.quality(odd, none).collect()} == {0.5}
    assert quality.quality(nothing, none).collect() == []
