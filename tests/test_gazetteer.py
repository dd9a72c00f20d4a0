import random

import pytest

from sparktally.functions import similarity as S
from sparktally.operators import gazetteer as G
from sparktally.operators import keyed_join as K

GAZ = "alias_idx long, alias string, merchant_id string, display_name string"


def gaz(spark, aliases):
    return spark.createDataFrame([(i, a, f"m{i}", a.title()) for i, a in enumerate(aliases)], GAZ)


def test_small_gazetteer(spark):
    g = spark.createDataFrame(
        [(0, "carrefour", "carrefour", "Carrefour"), (1, "mcdo", "mcdonalds", "McDonald's")], GAZ)
    df = spark.createDataFrame([("CB CARREFOUR 75 PARIS TPE1245",), ("",), (None,)], "raw_label string")
    rows = G.best_merchant(df, g, threshold=70).collect()
    assert [r.merchant_id for r in rows] == ["carrefour", None, None]
    assert G.normalize_merchant(df, g).columns == ["raw_label", "merchant_id", "display_name", "score"]


def test_resolve_lower_cut(spark):
    df = spark.createDataFrame([("cb carrefour 75 paris",)], "normalized string")
    row = G.resolve_merchant(df, gaz(spark, ["carrefour", "mcdo", "edf"]), cut=0.80).first()
    assert row.gaz_display == "Carrefour" and row.gaz_score >= 0.80 and "alias" in row.gaz_reason


def test_reasons(spark):
    df = spark.createDataFrame([("casino lille",), ("zzz",), ("",)], "normalized string")
    rows = G.resolve_merchant(df, gaz(spark, ["casino", "edf"]), explain_weak=True).collect()
    assert rows[0].gaz_reason == "alias:casino|score:0.90"
    assert rows[1].gaz_reason == "weak-alias:casino|score:0.00" and rows[1].gaz_display is None
    assert rows[2].gaz_reason == "weak-alias:casino|score:0.00"
    empty = G.resolve_merchant(df, gaz(spark, ["x"]).limit(0)).collect()
    assert {r.gaz_reason for r in empty} == {"gazetteer-empty"}


def test_ties_go_by_file_order(spark):
    g = spark.createDataFrame([(7, "casino", "late", "Late"), (2, "casino", "early", "Early")], GAZ)
    df = spark.createDataFrame([("casino lille",)], "normalized string")
    assert G.resolve_merchant(df, g).first().gaz_merchant_id == "early"
    assert G.resolve_merchant(df, g, max_shipped=0).first().gaz_merchant_id == "early"


def test_accuracy_of_no_pairs(spark):
    pairs = spark.createDataFrame([], "raw_label string, merchant_id string")
    assert G.merchant_accuracy(pairs, gaz(spark, ["edf"])).first().accuracy == 0.0


def _random_texts(seed, n):
    r = random.Random(seed)
    stems = ["carrefour", "casino", "paris", "lyon", "edf", "bk", "uber", "trip", "total", "sa", "café", "x"]

    def word():
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 1, 2])):
            place = r.randrange(len(w) + 1)
            w[place : place + r.choice([0, 1])] = r.choice("aeiors1")
        return "".join(w)

    return sorted({" ".join(word() for _ in range(r.randint(1, 4))) for _ in range(n)} - {""})


@pytest.mark.parametrize("threshold", [70, 80, 86, 90, 95])
def test_blocked_token_set_loses_nothing(spark, threshold):
    labels, aliases = _random_texts(1, 250), _random_texts(2, 120)
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    names = G.merchant_aliases(gaz(spark, aliases))
    got = {(r.label, r.alias_idx): r.score for r in G.blocked_scores(
        rows, names, "token_set", float(threshold)).collect()}
    want = {}
    for r in names.collect():
        for label, score in zip(labels, S.token_set_ratio(labels, [r.alias] * len(labels))):
            if score >= threshold:
                want[label, r.alias_idx] = float(score)
    assert got == pytest.approx(want) and want


def test_blocked_weighted_ratio_loses_nothing(spark):
    labels, aliases = _random_texts(3, 250), _random_texts(4, 120) + ["x", "bk", "a"]
    rows = spark.createDataFrame([(x,) for x in labels + ["b", "xy"]], "label string")
    names = G.plain_aliases(gaz(spark, aliases))
    got = {(r.label, r.alias_idx): r.score for r in G.blocked_scores(
        rows, names, "weighted_ratio", 90.0).collect()}
    want = {}
    for i, alias in enumerate(aliases):
        texts = labels + ["b", "xy"]
        for label, score in zip(texts, S.weighted_ratio(texts, [alias] * len(texts))):
            if score >= 90:
                want[label, i] = float(score)
    assert got == pytest.approx(want) and want


@pytest.mark.parametrize("floor", [85.0, 90.0, 95.0])
def test_prefixes_meet_where_scores_reach_the_floor(floor):
    """Whatever the order of the keys, also for texts of one letter or one trigram over and over."""
    texts = _random_texts(31, 160) + ["a", "b", "ab", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "aaaa aaaa aaaaa", "x x x", "aa aa"]
    rng = random.Random(7)
    plain = K.Keys(floor, {"d": floor}, True)
    counts = {k: rng.randint(1, 50) for t in texts for k in plain.every(t) if rng.random() < 0.5}
    for scorer, grams in ((S.token_set_ratio, {"d": floor}), (S.ratio, {"r": floor}), (S.token_sort_ratio, {"o": floor})):
        keys = K.Keys(floor, grams, True, counts)
        full, prefix, edits = ({t: set(getattr(keys, what)(t)) for t in texts} for what in ("all", "prefix", "edits"))
        for a in texts:
            for b, score in zip(texts, scorer([a] * len(texts), texts)):
                met = edits[a] & edits[b] or (scorer is S.token_set_ratio and (prefix[a] & full[b] or prefix[b] & full[a]))
                assert score < floor or met, (a, b, score)
                if a in b and len(b) <= 8 * len(a):
                    assert prefix[a] & full[b]


@pytest.mark.parametrize("floor", [70.0, 80.0, 86.0, 90.0])
def test_one_token_in_all_texts(spark, floor):
    """The most frequent token and its trigrams bring no pair together that others do not."""
    names = [f"{x} shop" for x in _random_texts(21, 120)]
    labels = [f"{x} shop paris" for x in _random_texts(22, 60)] + names[:40]
    rows = spark.createDataFrame([(x,) for x in sorted(set(labels))], "raw_label string")
    g = gaz(spark, names)
    near = sorted(map(tuple, G.best_merchant(rows, g, threshold=floor).collect()), key=str)
    assert near == sorted(map(tuple, G.best_merchant(rows, g, threshold=floor, max_shipped=0).collect()), key=str)


@pytest.mark.parametrize("min_score", [0.0, 40.0, 70.0, 79.9, 80.0, 86.0])
def test_candidates_same_at_every_size(spark, monkeypatch, min_score):
    """In the task, joined and in blocks: the same rows as scoring every pair."""
    labels, aliases = _random_texts(5, 80), _random_texts(6, 60)
    df = spark.createDataFrame([(x,) for x in labels], "raw_label string")
    g = gaz(spark, aliases)
    names = [(r.alias_idx, r.alias) for r in G.merchant_aliases(g).collect()]
    asked = [r[0] for r in df.select(G.normalize_merchant_text("raw_label")).collect()]
    want = []
    for raw, text in zip(labels, asked):
        score = S.token_set_ratio([text] * len(names), [a for _, a in names])
        best = sorted((-s, i, a) for (i, a), s in zip(names, score) if s >= min_score)[:3] if text else []
        want += [(raw, r + 1, a, int(-s)) for r, (s, i, a) in enumerate(best)]
    monkeypatch.setattr(G, "BLOCK", 13)
    for shipped in (10**6, 0):
        got = G.merchant_candidates(df, g, k=3, min_score=min_score, max_shipped=shipped).select(
            "raw_label", "rank", "alias_norm", "score").collect()
        assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("cut,weak", [(0.5, False), (0.8, False), (0.9, False), (0.9, True)])
def test_resolved_same_at_every_size(spark, monkeypatch, cut, weak):
    labels, aliases = _random_texts(15, 80) + ["", "zzz", "b"], _random_texts(16, 60) + ["b", "xy"]
    df = spark.createDataFrame([(x,) for x in labels] + [(None,)], "normalized string")
    g = gaz(spark, aliases)
    want = {None: (None, None)}
    for text in labels:
        score = S.weighted_ratio([text] * len(aliases), aliases)
        s, i = max((round(s, 9), -i) for i, s in enumerate(score))
        shown = weak or (s >= 100 * cut - 1e-9 and text)
        want[text] = (f"m{-i}" if s >= 100 * cut and text else None, pytest.approx(s / 100) if shown else None)
    monkeypatch.setattr(G, "BLOCK", 17)
    for shipped in (10**6, 0):
        got = G.resolve_merchant(df, g, cut=cut, explain_weak=weak, max_shipped=shipped).collect()
        assert {r.normalized: (r.gaz_merchant_id, r.gaz_score) for r in got} == want


def test_values_do_not_change_beyond_two_thousand_aliases(spark):
    many = ["carrefour", "mcdo"] + [f"merchant{i} of place{i * 7}" for i in range(1999)]
    df = spark.createDataFrame([("CB CARREFOUR 75 PARIS TPE1245",)], "raw_label string")
    assert G.best_merchant(df, gaz(spark, many), threshold=70).first().merchant_id == "m0"
    low = spark.createDataFrame([("cb carrefour 75 paris",)], "normalized string")
    assert G.resolve_merchant(low, gaz(spark, many), cut=0.80).first().gaz_display == "Carrefour"
    assert G.merchant_candidates(df, gaz(spark, many)).count() == 5


def test_blocked_pairs_are_scored_once(spark):
    df = spark.createDataFrame([(x,) for x in _random_texts(3, 30)], "raw_label string")
    g = gaz(spark, _random_texts(4, 30))
    for out in (G.best_merchant(df, g, max_shipped=0),
                G.resolve_merchant(df.withColumnRenamed("raw_label", "normalized"), g, max_shipped=0)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 1


def test_candidates_same_both_ways(spark):
    labels = _random_texts(5, 150)
    g = gaz(spark, _random_texts(6, 80))
    df = spark.createDataFrame([(x,) for x in labels], "raw_label string")
    near = sorted(map(tuple, G.merchant_candidates(df, g, k=3, min_score=85.0).collect()))
    far = sorted(map(tuple, G.merchant_candidates(df, g, k=3, min_score=85.0, max_shipped=0).collect()))
    assert near == far and near


def test_pairs_meet_by_shuffle(spark):
    """Small files say nothing of their rows: no side of the join on keys or of the join back is broadcast whole."""
    labels = spark.createDataFrame([(f"shop {i} lyon",) for i in range(50)], "label string")
    left, right = G._with_tokens(labels, gaz(spark, [f"shop {i}" for i in range(50)]))
    keys = G._keys("weighted_ratio", 90.0)
    for pairs in (K.token_pairs, K.edit_pairs):
        joined = pairs(left, right, "label", "alias", keys)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() >= 0


def test_pieces_of_long_texts_are_long():
    r = random.Random(5)
    assert {len(p) for p in K.pieces_of("a" * 10 + "b" * 20)[0]} == {16}
    assert K.pieces_of("")[0] == ["s"]
    for _ in range(3000):
        whole = "".join(r.choice("ab c") for _ in range(r.randint(1, 140)))
        size = r.randint(-(-len(whole) // 8), len(whole))
        at = r.randint(0, len(whole) - size)
        assert set(K.pieces_of(whole[at:at + size])[0]) <= set(K.pieces_of(whole)[1])


def test_explained_labels_are_scored_once(spark, monkeypatch):
    """Without a high cut the shipped gazetteer meets each distinct label in one task, with the answers of the row by row form."""
    from sparktally.plans.fixtures import gazetteer

    labels = ["cb carrefour 75 paris", "", None, "zzz", "uber trip"]
    df = spark.createDataFrame([(i, labels[i % 5]) for i in range(200)], "tx_id long, normalized string").repartition(6)
    seen = []

    attach = G.attach
    monkeypatch.setattr(G, "attach", lambda rows, best, text, counts: seen.append(best.count()) or attach(rows, best, text, counts))
    got = {(r.normalized, r.gaz_score, r.gaz_reason) for r in G.resolve_merchant(df, gazetteer(spark), explain_weak=True).collect()}
    assert seen == [4] and len(got) == 5
    by_label = {t: (s, why) for t, s, why in got}
    assert by_label[None] == (None, None) and by_label[""][0] == 0.0 and by_label["cb carrefour 75 paris"][1].startswith("alias:carrefour|")
    joined = G.resolve_merchant(df, gazetteer(spark), explain_weak=True, max_shipped=0).collect()
    assert got == {(r.normalized, r.gaz_score, r.gaz_reason) for r in joined}
