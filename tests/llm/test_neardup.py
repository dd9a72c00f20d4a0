import random

import numpy as np
import pytest

from sparktally.llm import neardup
from sparktally.llm.components import components
from tests.llm.conftest import frame, words


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for g in range(12):
        base = words(g, rng.randint(3, 120)).split()
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{n}"
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_chain_of_edits_is_one_component(spark):
    """Neighbours are linked, the ends are not: what one probe misses, later rounds must find."""
    base = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(base[2 * k:2 * k + 150])) for k in range(20)]
    got = {r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == set(c for _, c, _ in brute(rows).values())


def test_odd_rows(spark, odd, nothing):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 17
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 6
    assert sorted(r.component_id for r in rows if r.doc_id == 10) == [9, 10]  # two texts, one of them a copy
    assert sorted((r.component_id, r.kept) for r in rows if r.doc_id is None and r.n_shingles) == [(None, True)]
    assert neardup.near_duplicates(nothing).collect() == []


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = pool[:200], pool[50:250]
    table = neardup.signatures([a, b, a[:3]], 256)
    assert abs((table[0] == table[1]).mean() - 150 / 250) < 0.12
    assert (table < np.uint64(256 << 32)).all()  # all places are filled, in at most as many steps
    # ranks of one element's steps are a permutation of the places
    one = neardup.signatures([pool[:1]], 64)[0]
    assert sorted(int(v) >> 32 for v in one) == list(range(64))


@pytest.mark.parametrize("n", [2, 7, 40])
def test_components_of_paths_and_stars(spark, n):
    path = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_rows_of_one_id_with_different_texts_are_judged_each_by_its_own(spark):
    one, other = words(1, 60), words(2, 60)
    rows = [(2, one), (3, one + " more"), (3, other), (-7, other + " end"), (3, words(4, 50)), (9, words(4, 50))]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(2, 56, 2, True), (3, 57, 2, False), (3, 56, -7, False), (-7, 57, -7, True), (3, 46, 3, True), (9, 46, 3, False)}


def test_rounds_of_components_move_only_what_is_not_one_star_yet(spark, monkeypatch):
    from sparktally.llm import components as module

    rows, plain_stored = [], module.stored

    def counted(df, name):
        out = plain_stored(df, name)
        if name in ("large", "least"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(module, "stored", counted)
    edges = [(10 * i, 10 * i + k) for i in range(200) for k in range(1, 5)] + [(5000 + i, 5001 + i) for i in range(12)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{10 * i + k: 10 * i for i in range(200) for k in range(5)}, **{5000 + i: 5000 for i in range(13)}}
    assert rows and max(rows) < 40
