"""Small helpers around mapInArrow."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparktally.session import scratch_path


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra columns of any name cannot clash."""
    return docs.select(*columns)


def schema_of(docs: DataFrame, *columns: str, **more: T.DataType) -> tuple[T.StructType, pa.Schema]:
    """Result schema: some input columns, then new ones; also as Arrow."""
    fields = [T.StructField(c, docs.schema[c].dataType) for c in columns]
    fields += [T.StructField(name, kind) for name, kind in more.items()]
    schema = T.StructType(fields)
    return schema, to_arrow_schema(schema)


def fold(name: Column | str, parts: int) -> Column:
    """Remainder of the CRC-32 of the value as text, which splits rows for training; a null counts as empty."""
    return F.crc32(F.coalesce(F.col(name).cast("string") if isinstance(name, str) else name, F.lit("")).cast("binary")) % parts


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: survives lost executors, has real sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = [path]
    return out


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Arrow batches to Python workers have at most ``rows`` rows: both sides hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Seconds between two collections of garbage, at least.
COLLECT_EVERY = 10.0
_collected = [0.0]


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for these frames, once all that reads them is stored itself.

    Collecting garbage lets Spark delete the shuffle files of the jobs that are done, too; without frames that is all.
    """
    paths = [path for f in frames if f is not None for path in getattr(f, "scratch", ())]
    spark = SparkSession.active()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        _collected[0] = time.monotonic()
        gc.collect()
        spark._jvm.System.gc()


#: Rows of ids (a few longs each) that may be broadcast.
MOST_BROADCAST = 2_000_000


def few(ids: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Stored ``ids``, marked for broadcast if a count shows at most ``most`` rows, so that what they pick need not move."""
    if ids.limit(most + 1).count() > most:
        return ids
    out = F.broadcast(ids)
    out.scratch = getattr(ids, "scratch", [])
    return out
