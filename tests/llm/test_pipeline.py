"""Each stage against a brute-force version on its own input, and decisions on planted rows."""

import random

import corpus_pipeline as pipeline
import pytest

from tests.llm.conftest import frame, words
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_neardup import brute as groups


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("tables"))
    bench = [(i, words(9000 + i, 30)) for i in range(5)]
    passage, rows = words(8000, 70), []
    for i in range(240):
        text = ". ".join(words(100 * i + k, rng.randint(5, 25)) for k in range(rng.randint(2, 8))) + "."
        if i % 6 == 0:
            text += f" you {rng.choice(['scumbag', 'vermin'])} {words(i, 3)}."
        if i % 20 == 3:
            text = f"{text} {passage} {words(i, 10)}"
        if i % 20 == 7:
            text = f"{text} {bench[i % 5][1]}"
        rows.append((i, text))
    rows += [(300 + k, rows[k][1]) for k in (1, 2, 3)] + [(320, rows[5][1] + " more"), (321, None), (322, ""), (1, rows[1][1])]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = frame(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, rows, bench


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, planted):
    folder, rows, bench = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == [
        "toxicity", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]

    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    toxic = {i for i, t in rows if t and ("scumbag" in t or "vermin" in t)}
    assert sorted(texts(clean), key=str) == sorted(((i, t) for i, t in rows if i not in toxic), key=str)

    single = stage["minhash_near_dedup"](spark, clean, folder)
    assert single.columns == docs.columns
    kept = groups(dict(texts(clean)).items())
    assert sorted(i for i, _ in texts(single)) == sorted(i for i, (_, _, keep) in kept.items() if keep)

    cut = stage["substring_dedup"](spark, single, folder)
    assert cut.columns == docs.columns and cut.count() == single.count()
    passage = words(8000, 70)
    holders = sorted(i for i, t in texts(single) if t and passage in t)
    before, after = dict(texts(single)), dict(texts(cut))
    assert len(holders) > 5
    for i, t in after.items():
        want = before[i] if i not in holders[1:] else before[i].replace(passage + " ", "")
        assert t == want, i
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())

    pure = stage["benchmark_decontamination"](spark, cut, folder)
    hits = contaminated(list(after.items()), [(str(i), t) for i, t in bench])
    bad = {i for i, (n, hit, _) in hits.items() if hit and 20 * hit >= n}
    assert pure.columns == docs.columns and bad and sorted(i for i, _ in texts(pure)) == sorted(set(after) - bad)

    pieces = stage["best_fit_packing"](spark, pure, folder)
    assert {r.doc_id for r in pieces.collect()} == set(after) - bad


def test_run_equals_the_stages(spark, planted):
    folder, _, _ = planted
    assert len({r.doc_id for r in pipeline.run(spark, folder).collect()}) > 100


def test_odd_and_empty_documents(spark, planted, odd, nothing):
    folder, _, _ = planted
    for docs in (odd, nothing):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, folder)
        rows = docs.collect()
    assert rows == []
    first = pipeline.one_of_each_group(spark, odd, folder).collect()
    assert sum(r.doc_id is None for r in first) == 2 and sorted(r.doc_id for r in first if r.doc_id == 7 or r.doc_id == 5) == []


def test_a_text_goes_to_the_workers_once(spark, planted, monkeypatch):
    """Stages that score rows carry the text itself and the other columns beside it, in batches of BATCH_ROWS, and leave the setting as it was."""
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, carry = pipeline._parted(docs)
    assert rows.columns == ["doc_id", "text", "rest"] and carry == ("text", "rest")
    assert "text" not in rows.schema["rest"].dataType.names
    assert rows.select(*pipeline._whole(docs)).columns == docs.columns
    plain = docs.select("doc_id", "text")
    assert pipeline.drop_toxic(spark, plain, folder).columns == plain.columns
    assert pipeline.drop_contaminated(spark, plain, folder).columns == plain.columns
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    def stage(session, given, folder):
        seen.append(session.conf.get(name))
        return given

    monkeypatch.setattr(pipeline, "STAGES", [("first", stage), ("last", stage)])
    assert pipeline.run(spark, folder).count() == docs.count()
    assert seen == [str(pipeline.BATCH_ROWS), before] and spark.conf.get(name) == before
