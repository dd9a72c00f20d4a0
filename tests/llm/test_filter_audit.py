import re
from collections import Counter
from itertools import permutations
from math import factorial
import random

import pytest

from sparktally.llm import filter_audit
from tests.llm.conftest import frame, words


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = {}
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, members in docs.items():
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step + 1] = (
                    len(left), len(gone), sum(d[0][f] for d in members) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in members),
                    sum(d[1] for d in gone), sum(d[2] for d in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def label_frame(spark, labels):
    return spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = words(i, rng.choice([20, 150, 199, 200, 260]))
        if rng.random() < 0.3:
            text = " ".join(text.split()[:60] * 4)
        if rng.random() < 0.3:
            text = text.title()
        if rng.random() < 0.3:
            text += rng.choice("#$%&*|")
        rows.append((i, text, rng.choice(["en", "fr", None, ""])))
    # a third are copies of one text, in several languages and of both labels
    rows += [(1000 - k, rows[5][1], rng.choice(["en", "de"])) for k in range(150)]
    rows += [(5, rows[5][1], "en"), (7, rows[9][1], "fr"), (None, rows[5][1], "en"), (None, None, "en"), (400, None, "en"), (401, "", None)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 1001, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    assert got(filter_audit.audit(frame(spark, rows), label_frame(spark, labels))) == brute(rows, labels)


def test_edges_of_the_conditions(spark):
    rows = [(1, " ".join(["Aa"] * 100 + [f"b{i}" for i in range(99)]), "x"), (2, " ".join(["a"] * 101 + [f"b{i}" for i in range(99)]), "x"),
            (3, "A" * 3 + "é" * 97, "x"), (4, "A" * 3 + "é" * 96, "x"), (5, "É" * 50 + " |", "x"), (6, "a\x0bb\x0cc\x1cd", "x")]
    assert got(filter_audit.audit(frame(spark, rows), label_frame(spark, [(1, 1, 1)]))) == brute(rows, [(1, 1, 1)])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_least_squares_give_shapley_values(n):
    rng = random.Random(n)
    value = [0] + [rng.randint(0, 1000) for _ in range(2**n - 1)]
    for i, weights in enumerate(filter_audit.shapley_weights(n)):
        total = 0
        for order in permutations(range(n)):
            before = sum(1 << k for k in order[:order.index(i)])
            total += value[before | 1 << i] - value[before]
        assert sum(w * v for w, v in zip(weights, value)) * factorial(n) == total


def test_odd_and_empty_tables(spark, odd, nothing):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    labels = [(4, 1, 1), (7, 0, 1)]
    assert got(filter_audit.audit(odd, label_frame(spark, labels))) == brute(rows, labels)
    assert got(filter_audit.audit(odd, label_frame(spark, labels).limit(0))) == brute(rows, [])
    assert got(filter_audit.audit(nothing, label_frame(spark, labels))) == {}
