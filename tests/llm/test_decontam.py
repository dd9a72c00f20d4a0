import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktally.llm import decontam
from sparktally.llm.fmindex import FMIndex, suffix_order
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=14), min_size=1, max_size=8), st.integers(1, 4))
def test_index_finds_all_places(runs, size):
    text = np.array([x for run in runs for x in [*run, 0]])
    order = suffix_order(text)
    codes = [tuple(("s", i) if text[i] == 0 else ("w", int(text[i])) for i in range(p, len(text))) for p in range(len(text))]
    assert sorted(range(len(text)), key=lambda p: codes[p]) == order.tolist()
    index = FMIndex(text, 3)
    patterns = {tuple(text[i:i + size].tolist()) for i in range(len(text) - size + 1)} | {(3,) * size}
    patterns = sorted(p for p in patterns if 0 not in p)
    if not patterns:
        return
    lo, hi = index.search(np.array(patterns), np.full(len(patterns), size))
    for p, a, b in zip(patterns, lo, hi):
        places = [i for i in range(len(text) - size + 1) if tuple(text[i:i + size].tolist()) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def brute(rows, items, window=13):
    wins = {}
    for name, text in items:
        w = WORD.findall((text or "").lower())
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(name)
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        hit, found = set(), set()
        for size in {len(k) for k in wins}:
            for a in range(len(w) - size + 1):
                names = wins.get(tuple(w[a:a + size]))
                if names:
                    hit |= set(range(a, a + size))
                    found |= names
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_hits_equal_brute_force_in_one_block_or_many(spark, block_bytes):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 12, 13, 14, 40])))) for k in range(30)]
    items += [("i3", items[3][1]), ("null", None), ("empty", "")]
    rows = []
    for i in range(60):
        w = [rng.choice([*pool, "other"]) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            name, text = rng.choice(items[:30])
            at = rng.randint(0, len(w))
            w[at:at] = text.upper().split() if rng.random() < 0.3 else text.split()
        rows.append((i, ", ".join(w)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.benchmark_hits(frame(spark, rows), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got} == brute(rows, items)
    text = dict(rows)
    for r in got:
        assert sum(len(WORD.findall(text[r.doc_id][s.start:s.end].lower())) for s in r.spans) == r.n_hit


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "日本語 ñandú ÉTÉ"), (2, "one"), (None, "some words"), (3, None)], "item_id long, text string")
    got = decontam.benchmark_hits(odd, bench).collect()
    assert len(got) == 17
    by = {r.doc_id: r for r in got}
    assert by[8].items == ["1"] and by[8].n_hit == 3 and by[7].items == ["2"] and by[4].n_hit == 0
    assert by[1].n_words == by[2].n_words == by[12].n_words == 0 and by[11].n_words == 1
    assert decontam.benchmark_hits(nothing, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontam.benchmark_hits(odd, bench.limit(0)).collect())


def test_blocks_of_the_benchmark_give_the_same(spark):
    rows = [(i, " ".join(f"w{(7 * i + 3 * k) % 50}" for k in range(60))) for i in range(40)]
    items = [(i, " ".join(f"w{(5 * i + 3 * k) % 50}" for k in range(9 + i))) for i in range(20)] + [(30, None), (None, "w1 w2"), (31, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = ([tuple(r) for r in decontam.benchmark_hits(frame(spark, rows), bench, block_bytes=size).orderBy("doc_id").collect()]
                    for size in (1 << 20, 150))
    assert whole == parts and any(r[2] for r in whole)
