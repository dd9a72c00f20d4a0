import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(n, T.StringType()) for n in (
        "component_id", "row", "spans", "score", "piece", "start", "key", "block", "word", "features", "group", "label",
        "fingerprint", "_id", "_rows", "_cut", "_h", "_text", "ids", "bucket")],
])
EXTRA = len(SCHEMA) - 5


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang), with the extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *["x"] * EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null id, null, empty, blank and very long texts, repeated rows, ties, one word, no ASCII."""
    long = words(1, 40_000)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one"), (7, "one"), (7, "one"), (8, "日本語 ñandú ÉTÉ\n\nß"),
        (None, "no id at all here but some words to read"), (None, None), (9, words(2, 60)), (10, words(2, 60)), (10, words(3, 60)),
        (11, "x" * 300_000), (12, "!!! ... ???"), (-5, words(4, 30), None),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
