from sparktally.llm import license_scan
from tests.llm.conftest import frame, words


def test_notices_are_found_and_others_are_not(spark):
    notices = {i: (family, text) for i, (family, text) in enumerate(
        (f, t) for f, texts in license_scan.TEMPLATES.items() for t in texts)}
    rows = [(i, f"{words(i, 30)}.\n{text}\n{words(i + 500, 20)}") for i, (_, text) in notices.items()]
    rows += [(100 + i, f"{words(i + 50, 12)}\nthis is of the work and in with version {words(i, 5)}") for i in range(200)]
    rows += [(400, f"{words(3, 9)} Released under the MIT License. {words(4, 9)}")]
    got = license_scan.scan(frame(spark, rows)).collect()
    confirmed = {r.doc_id: r.family for r in got if r.confirmed}
    assert {i for i in confirmed if i < 100} == set(notices)
    # short notices of sibling families may be told apart only by the number
    assert sum(confirmed[i] == family for i, (family, _) in notices.items()) >= len(notices) - 1
    assert all(r.number == 1 for r in got if r.doc_id < 100)
    assert confirmed[400] == "mit" and not [r for r in got if 100 <= r.doc_id < 400 and r.confirmed]
    assert all((r.family == license_scan.UNKNOWN) == (not r.confirmed) for r in got)


def test_odd_rows(odd, nothing):
    assert license_scan.scan(odd).collect() == []
    assert license_scan.scan(nothing).collect() == []


def test_main_path_has_no_python(odd, capsys):
    license_scan.scan(odd).explain()
    plan = capsys.readouterr().out
    assert not [w for w in ("Python", "Pandas", "ArrowEval") if w in plan]


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """40 ordinary lines of 50 copies each: 30 places hold 30 lines."""
    lines = spark.createDataFrame([(words(k, 8),) for k in range(40)] * 50, "paragraph string")
    seen, store = {}, license_scan.stored
    monkeypatch.setattr(license_scan, "stored", lambda df, name: seen.setdefault(name, store(df, name)))
    license_scan.train(lines, sample=30)
    assert seen["examples"].where("family = 'other'").select("paragraph").distinct().count() == 30


def test_threshold_counts_every_distinct_paragraph_once(spark):
    """Of 20 000 distinct paragraphs 11 may pass; copies, and what is like a template, do not count."""
    rows = [(words(k, 6), 0.9 - k / 100) for k in range(20)] + [(words(0, 6), 0.9)] * 500
    rows += [(license_scan.TEMPLATES["mit"][0], 0.97)] * 50 + [(t, 0.95) for f in license_scan.TEMPLATES.values() for t in f]
    likely = spark.createDataFrame(rows, "paragraph string, probability double").selectExpr("*", f"{license_scan._WORDS} AS words")
    least = license_scan._calibrated(likely, 20_000)
    assert len({p for p, chance in rows[:20] if chance >= least}) == 11
    assert license_scan._calibrated(likely, 20_000_000) == license_scan.LEAST_PROBABILITY
