import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktally.llm import lexical
from tests.llm.conftest import frame, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, top=50):
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, w) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = {}
    for item, text in items:
        asked, found = set(terms(text)), []
        for i, w in docs:
            c, m = Counter(w), 100 - 50 + 50 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in asked if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out[item] = [(None if none else i, -s) for s, none, i in sorted(found)[:top]]
    return {k: v for k, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 25)), st.integers(1, 10**6), min_size=1), st.integers(0, 5))
def test_packed_treap_holds_the_cells_and_their_maxima(grid, lead):
    row, column = (np.array([c[i] for c in grid]) for i in (0, 1))
    value = np.array(list(grid.values()))
    packed = lexical.Treap(6, 5, lead).build(row, column, value).pack()
    treap = lexical.Treap(6, 5, lead).unpack(*packed)
    leaves = treap.top[-len(grid):]
    order = np.argsort(treap.keys(row, column))
    assert leaves.tolist() == value[order].tolist() and treap.top[0] == value.max()
    best = lexical.Best(2, 3)
    asked = sorted({c[0] for c in grid})[:7]
    weights = np.arange(2, 2 + len(asked))
    lexical.descend(treap, np.arange(32) * 10, np.zeros(len(asked), np.int64), np.array(asked), weights, best, taken=2)
    scores = Counter()
    for (r, c), v in grid.items():
        if r in asked:
            scores[c] += v * int(weights[asked.index(r)])
    want = sorted(((-s, c) for c, s in scores.items()))[:3]
    assert [(-s, d // 10) for s, d in zip(best.score.tolist(), best.doc.tolist())] == want


@pytest.mark.parametrize("shard_bytes, block_bytes, parts", [(1 << 20, 1 << 20, 1), (3000, 200, 5)])
def test_against_brute_force(spark, shard_bytes, block_bytes, parts):
    rng = random.Random(3)
    vocabulary = [words(i, 1) for i in range(60)]
    # the first words are in a third of all texts and more
    def text(n):
        return " ".join(vocabulary[min(int(rng.expovariate(0.12)), 59)].title() for _ in range(n))
    rows = [(i, text(rng.choice([1, 5, 30, 30, 200]))) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(120)] + [(3, rows[3][1]), (None, rows[7][1]), (901, None), (902, ""), (903, "... ! -")]
    items = [(i, text(rng.choice([1, 4, 12, 40]))) for i in range(30)] + [(90, None), (91, "unheard of"), (92, rows[7][1])]
    index = lexical.build_index(frame(spark, rows).repartition(parts), shard_bytes)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("unused", "x")
    assert got(lexical.search(index, queries, block_bytes=block_bytes)) == brute(rows, items)


def test_ties_go_by_id_and_rows_of_one_item_are_one(spark):
    rows = [(i, "alpha beta") for i in range(80, 0, -1)] + [(200, "gamma")]
    index = lexical.build_index(frame(spark, rows), 50)
    queries = spark.createDataFrame([(1, "alpha"), (1, "beta alpha"), (None, "alpha"), (2, "gamma")], "item_id long, text string")
    found = got(lexical.search(index, queries))
    assert [i for i, _ in found[1]] == list(range(1, 51)) and len({s for _, s in found[1]}) == 1
    assert [i for i, _ in found[2]] == [200] and set(found) == {1, 2}


def test_odd_and_empty_tables(spark, odd, nothing):
    queries = spark.createDataFrame([(1, "one"), (2, words(1, 40_000)), (3, "日本語 ñandú")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(lexical.search(lexical.build_index(odd), queries)) == brute(rows, [tuple(r) for r in queries.collect()])
    assert got(lexical.search(lexical.build_index(nothing), queries)) == {}
    assert got(lexical.search(lexical.build_index(odd), queries.limit(0))) == {}
