from pyspark.sql import functions as F

from sparktally.operators import drift as D
from sparktally.streaming import router as ST

SCHEMA = "ts timestamp, confidence double, router string"


def test_append_mode_leaves_the_last_window_open(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", 0.7, "model>llm" if h % 2 else "rules") for h in range(4)]
    spark.createDataFrame(rows, "ts string, confidence double, router string").withColumn(
        "ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.event_stream(spark, str(tmp_path / "in"), SCHEMA)
    windows = ST.metrics_stream(stream, "ts", "1 hour", "0 minutes")
    ST.run_available(windows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.schema(windows.schema).parquet(str(tmp_path / "out"))
    assert sorted(r.window_start.hour for r in out.collect()) == [0, 1, 2]
    assert {r.fallback_rate for r in out.collect()} == {0.0, 1.0}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    train = D.ngram_counts(spark.createDataFrame([("abc",), ("abd",)], "t string"), "t").withColumnRenamed("n", "n_train")
    state, reports = str(tmp_path / "state"), str(tmp_path / "reports")
    update = ST.running_drift(train, "t", state, reports)
    first, second = (spark.createDataFrame([(x,)], "t string") for x in ("abc", "xyz"))
    update(first, 0)
    update(second, 1)
    once = spark.read.parquet(f"{reports}/batch=1").first()
    update(second, 1)
    assert spark.read.parquet(f"{reports}/batch=1").first() == once
    assert once.n_grams == 12 and once.oov_rate == 0.5
    assert spark.read.parquet(f"{reports}/batch=0").first().oov_rate == 0.0


def test_streamed_router_answers_alike_beyond_the_shipping_bound(spark, tmp_path):
    from sparktally.plans.fixtures import gazetteer

    schema = "tx_id string, raw_label string, channel string, mcc int"
    rows = [("t", "CB EDF", "CB", None), ("u", "CB CARREFOUR 75 PARIS", "CB", None), ("v", "zzz", None, 5411)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    found = []
    for bound in (1000, 3):
        routed = ST.classify_stream(ST.event_stream(spark, str(tmp_path / "in"), schema), gazetteer(spark), max_shipped=bound)
        assert routed.isStreaming
        out = str(tmp_path / f"out{bound}")
        ST.run_available(routed, out, str(tmp_path / f"cp{bound}")).awaitTermination()
        found.append(sorted(map(str, spark.read.schema(routed.schema).parquet(out).collect())))
    assert found[0] == found[1] and len(found[0]) == 3


def test_windowed_drift_keeps_open_windows_only(spark, tmp_path):
    """One file per day: reports are those of the batch operator, and the state does not grow with the days."""
    import datetime
    import random

    rng = random.Random(3)
    schema = "ts timestamp, model_text string, category_label string, conf double"
    train = spark.createDataFrame([("abc abd", "x", 0.5), ("abc", "y", 0.25), ("bcd", "x", 0.75)], "model_text string, category_label string, conf double")
    side = ST.training_side(train, "model_text", "category_label", "conf", k=8)
    start, rows = datetime.datetime(2024, 1, 1), []
    for day in range(9):
        part = [(start + datetime.timedelta(days=day, hours=rng.randint(0, 23)), rng.choice(["abc", "abd x", "zzz", None]), rng.choice(["x", "y", "z", None]),
                 rng.choice([0.1, 0.5, 0.9, None, float("nan")])) for _ in range(12)]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.event_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    query = ST.drift_windows(stream, side, str(tmp_path / "out"), str(tmp_path / "cp"), "ts", width="1 day", delay="1 hour")
    query.awaitTermination()
    got = {r.window_start.day: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == list(range(1, 9))  # the last day is open
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) < 3 * 60  # grams, labels and confidences of two or three open days
    for day, r in got.items():
        mine = spark.createDataFrame([(t, c, v, False) for ts, t, c, v in rows if ts.day == day], "model_text string, category_label string, conf double, tr boolean")
        both = train.withColumn("tr", F.lit(True)).union(mine)
        want = D.drift_summary(both, F.col("tr"), conf="conf", k=8).first()
        for name in ("psi_topk", "oov_rate", "ks_confidence_stat", "largest_label_shift", "alerts"):
            assert r[name] == want[name], (day, name)


def test_windowed_drift_keeps_texts_and_not_their_grams(spark, tmp_path):
    """A row puts three entries into the state, however long its text, and a stream that runs again goes on where it was."""
    import datetime

    schema = "ts timestamp, model_text string, category_label string, conf double"
    train = spark.createDataFrame([("abc", "x", 0.5)], "model_text string, category_label string, conf double")
    side = ST.training_side(train, "model_text", "category_label", "conf", k=8)
    days, sizes = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)], []
    for day in days:
        rows = [(day, " ".join(f"word{day.day}{i}{j}" for j in range(40)), "x", 0.5) for i in range(5)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ST.event_stream(spark, str(tmp_path / "in"), schema)
        query = ST.drift_windows(stream, side, str(tmp_path / "out"), str(tmp_path / "cp"), "ts", width="1 day", delay="1 hour")
        query.awaitTermination()
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 3 * (5 + 1 + 1)  # three open days
    found = spark.read.parquet(str(tmp_path / "out"))
    assert [r.window_start.day for r in found.collect()] == [1]  # the watermark is an hour before the second ends
