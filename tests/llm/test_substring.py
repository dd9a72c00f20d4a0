from sparktally.llm import substring
from tests.llm.conftest import frame, words


def spans(df):
    return {(r.doc_id, r.kept_doc_id): (r.start, r.end, r.n_words) for r in df.collect()}


def test_passage_at_any_place_is_found_whole(spark):
    passage = words(100, 52)
    rows = [(i, f"{words(i, 30 + 7 * i)} {passage} {words(50 + i, 20)}") for i in range(8)] + [(20, words(20, 300))]
    docs = frame(spark, rows)
    found = substring.repeated_passages(docs)
    got = found.collect()
    assert {r.doc_id for r in got} == set(range(1, 8)) and {r.kept_doc_id for r in got} == {0}
    text = dict(rows)
    assert all(text[r.doc_id][r.start:r.end] == passage + " " and r.n_words == 52 for r in got)
    cut = {r.doc_id: r for r in substring.cut_spans(docs, found).collect()}
    assert cut[0].text == text[0] and cut[20].text == text[20] and cut[20].n_chars == len(text[20])
    for i in range(1, 8):
        assert cut[i].text == text[i].replace(passage + " ", "") and cut[i].n_chars == len(cut[i].text)
    assert list(cut[1].asDict()) == docs.columns


def test_every_long_repeat_is_found_by_brute_force(spark):
    """All 50-word runs shared with an earlier document lie in removed spans, and nothing else does."""
    import random

    rng = random.Random(5)
    pieces = [words(i, rng.randint(20, 90)) for i in range(25)]
    rows = [(i, " ".join(rng.choice(pieces) if rng.random() < 0.3 else words(1000 + 10 * i + k, rng.randint(5, 60))
                         for k in range(5))) for i in range(40)]
    found = substring.repeated_passages(frame(spark, rows)).collect()
    removed = {(r.doc_id, w) for r in found for w in range(*_word_range(dict(rows)[r.doc_id], r.start, r.end))}
    first, must = {}, set()
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            home = first.setdefault(tuple(w[k:k + 50]), i)
            if home != i:
                must |= {(i, x) for x in range(k, k + 50)}
    assert must <= removed
    seen = {}
    for i, t in rows:  # a removed word lies in a run of 20 that an earlier document has
        w = t.split()
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k:k + 20]), i)
    for i, x in removed:
        w = dict(rows)[i].split()
        assert any(seen.get(tuple(w[k:k + 20]), i) < i for k in range(max(0, x - 19), x + 1))


def _word_range(text, start, end):
    a = len(text[:start].split())
    return a, a + len(text[start:end].split())


def test_edited_paragraphs_count_as_repeats_and_short_ones_do_not(spark):
    base = words(7, 120).split()
    edited = list(base)
    edited[60] = "changed"
    rows = [(1, " ".join(base)), (2, words(8, 40) + " " + " ".join(edited)), (3, words(9, 60) + " " + " ".join(base[:30]))]
    got = substring.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {2} and sum(r.n_words for r in got) >= 118


def test_odd_rows(spark, odd, nothing):
    got = substring.repeated_passages(odd)
    assert {(r.doc_id, r.kept_doc_id) for r in got.collect()} == {(5, 4), (10, 9)}
    cut = substring.cut_spans(odd, got).collect()
    assert len(cut) == 17 and sum(r.text == "" for r in cut) == 3  # 2, and all of 5 and of one text of 10
    assert substring.repeated_passages(nothing).collect() == []
    assert substring.cut_spans(nothing, substring.repeated_passages(nothing)).collect() == []


def test_repeats_inside_a_later_document_are_all_found_however_rows_fall(spark):
    passage = words(31, 60)
    rows = [(1, f"{words(32, 20)} {passage} {words(33, 20)}"),
            (5, f"{passage} {words(34, 90)} {passage} {words(35, 30)}"), (6, words(36, 50))]
    docs = frame(spark, rows)
    for dealt in (docs.coalesce(1), docs.repartitionByRange(3, "doc_id")):
        got = substring.repeated_passages(dealt).collect()
        assert [(r.doc_id, r.kept_doc_id, r.n_words) for r in got] == [(5, 1, 60)] * 2
        assert passage not in {r.doc_id: r.text for r in substring.cut_spans(dealt, substring.repeated_passages(dealt)).collect()}[5]


def test_rows_of_one_id_meet_earlier_documents_however_rows_fall(spark):
    passage = words(41, 60)
    rows = [(1, f"{passage} {words(42, 20)}"), (5, f"{words(43, 40)} {passage}"), (5, f"{words(44, 70)} {passage}")]
    docs = frame(spark, rows)
    for dealt in (docs.coalesce(1), docs.repartitionByRange(3, "doc_id")):
        assert [(r.doc_id, r.kept_doc_id, r.n_words) for r in substring.repeated_passages(dealt).collect()] == [(5, 1, 60)] * 2


def test_partners_that_are_unlike_or_shorter_do_not_hide_others(spark):
    """The first document has each passage edited or cut; the second and third share it whole."""
    rows = []
    for k in range(30):
        whole = words(5000 + k, 80 if k % 2 else 60).split()
        first = whole[:40] + ["edited"] + whole[41:] if k % 2 else whole[:45]
        rows.append((k, f"{words(6000 + k, 15)} {' '.join(first)} {words(6100 + k, 15)}"))
        rows += [(100 * j + k, f"{words(6000 + 200 * j + k, 15)} {' '.join(whole)} {words(6100 + 200 * j + k, 15)}") for j in (1, 2)]
    docs = frame(spark, rows)
    for dealt in (docs.coalesce(1), docs.repartitionByRange(3, "doc_id")):
        got = substring.repeated_passages(dealt).collect()
        whole = {r.doc_id for r in got if r.n_words >= (80 if r.doc_id % 2 else 60)}
        assert whole >= set(range(200, 230))


def test_run_hashes_tell_runs_apart():
    import numpy as np

    h = substring.mix(np.arange(1, 200, dtype=np.uint64) % np.uint64(70))
    for n in (1, 2, 19, 50):
        keys = substring._run_hashes(h, n)
        alike = {}
        for i, key in enumerate(keys):
            alike.setdefault(int(key), set()).add(tuple(h[i:i + n].tolist()))
        assert len(keys) == 200 - n and len(alike) == min(70, 200 - n) and all(len(x) == 1 for x in alike.values())


def test_edited_passages_against_brute_force(spark):
    """Passages with 2 % of their words changed, missing or added: nine tenths of what is alike are found whole, or nearly."""
    import random

    rng = random.Random(12)
    rows, want = [], {}
    for k in range(120):
        n = rng.choice([100, 150, 250])
        passage = words(70_000 + k, n).split()
        edited = list(passage)
        for at in sorted(rng.sample(range(n), n // 50), reverse=True):
            kind = rng.random()
            edited[at:at + 1] = ["changed"] if kind < 0.6 else [] if kind < 0.8 else [edited[at], "added"]
        rows.append((k, f"{words(71_000 + k, 30)} {' '.join(passage)} {words(72_000 + k, 30)}"))
        rows.append((1000 + k, f"{words(73_000 + k, 25)} {' '.join(edited)} {words(74_000 + k, 35)}"))
        one, two = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (passage, edited))
        if len(one & two) >= 0.8 * len(one | two):
            want[1000 + k] = len(edited)
    got = {}
    for r in substring.repeated_passages(frame(spark, rows)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
        assert r.kept_doc_id == r.doc_id - 1000
    found = [i for i, n in want.items() if got.get(i, 0) >= n - 12]
    assert len(want) > 60 and len(found) >= 0.9 * len(want)
    assert all(n <= {100: 104, 150: 154, 250: 258}[100] + 154 for n in got.values())  # nothing of what surrounds them


def test_anchors_behind_16_million_words():
    import numpy as np

    class Found:
        hashes = substring.mix(np.arange((1 << 24) + 3000, dtype=np.uint64))
        first = np.array([0, len(hashes)])

    tail = Found()
    tail.hashes = Found.hashes[-5000:]
    tail.first = np.array([0, 5000])
    whole, part = substring.anchors(Found()), substring.anchors(tail) + len(Found.hashes) - 5000
    near = whole[whole >= len(Found.hashes) - 4900]
    assert len(near) > 200 and near.tolist() == part[part >= len(Found.hashes) - 4900].tolist()


def test_whole_texts_move_only_where_a_side_of_a_pair_or_a_cut_names_them(spark, monkeypatch):
    passage = words(100, 60)
    docs = frame(spark, [(i, f"{words(i, 40)} {passage} {words(50 + i, 30)}") for i in range(6)] + [(9, words(9, 200))])
    seen, plain_spans = [], substring._spans
    monkeypatch.setattr(substring, "_spans", lambda pairs, *more: seen.append(pairs) or plain_spans(pairs, *more))
    monkeypatch.setattr(substring, "discard", lambda *frames: None)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substring.repeated_passages(docs)
        plan = substring.cut_spans(docs, found)._jdf.queryExecution().executedPlan().toString()
        aligned = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert aligned.count("LeftSemi") == 2
    assert {r.doc_id for r in found.collect()} == set(range(1, 6))
