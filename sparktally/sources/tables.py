"""Readers and writers of transactions, pairs, requests, reports, logs and images."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktally import constants as K
from sparktally import schemas
from sparktally.functions.text import strip
from sparktally.operators.drift import any_alert
from sparktally.session import ship_code

#: Bytes up to which a table in few splits is dealt out to all cores.
SMALL_TABLE = 64 << 20


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself, or ValueError naming the columns it lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; a small one in few splits is spread over the cores.

    Row-heavy text work on a single small file would leave cores idle. Only tables of at
    most ``SMALL_TABLE`` bytes are dealt out, row by row, so no more than that is ever
    shuffled for it; larger ones are read as they are.
    """
    ship_code(spark)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= SMALL_TABLE and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _named_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV columns by header name, as text: only the header line is read up front."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the known columns; a value that does not parse becomes null."""
    columns = []
    for name in df.columns:
        kind = types.get(name, "string")
        value = F.col(name)
        if kind == "int":  # tolerate 5411.0
            value = value.try_cast("double").try_cast("int")
        elif kind != "string":
            value = value.try_cast(kind)
        columns.append(value.alias(name))
    return df.select(*columns)


def read_transactions(spark: SparkSession, path: str, required: tuple[str, ...] = ("raw_label",),
                      format: str = "csv") -> DataFrame:
    """Transactions by column name; training and evaluation also require category_label.

    The optional columns channel and mcc are there in any case, without values if the file lacks them.
    """
    if format == "parquet":
        found = require_columns(spark.read.parquet(path), list(required))
    else:
        found = _typed(require_columns(_named_csv(spark, path), list(required)), schemas.TRANSACTION)
    return found.withColumns({
        name: F.lit(None).cast(schemas.TRANSACTION[name]) for name in ("channel", "mcc") if name not in found.columns})


def read_eval_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled (raw_label, merchant_id) pairs."""
    pairs = require_columns(_named_csv(spark, path), ["raw_label", "merchant_id"])
    return pairs.select("raw_label", "merchant_id")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header that keeps blanks at the ends of values."""
    (
        df.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


# ------------------------------------------------------------------ requests

def explode_requests(documents: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Valid transactions of request documents, and the documents or rows that are invalid.

    A document needs a list of transactions, a transaction its raw_label. Fields are read as
    text and then typed, so ``"mcc": "5411"`` is 5411; a value that is not of its field's
    type makes the transaction invalid, and ``missing`` names the first such field.
    """
    parsed = documents.withColumn("_request", F.from_json(body, schemas.REQUEST))
    items = F.col("_request.transactions")
    rows = parsed.where(items.isNotNull()).select(*documents.columns, F.explode(items).alias("_tx"))
    wrong, typed = [F.when(F.col("_tx.raw_label").isNull(), F.lit("raw_label"))], []
    for name, kind in schemas.REQUEST_TYPES.items():
        value = F.col(f"_tx.{name}")
        cast = value if kind == "string" else value.try_cast(kind)
        wrong.append(F.when(value.isNotNull() & cast.isNull(), F.lit(name)))
        typed.append(cast.alias(name))
    rows = rows.withColumn("_wrong", F.coalesce(*wrong))
    fine = F.col("_wrong").isNull()
    carried = [c for c in documents.columns if c != body]
    valid = rows.where(fine).select(*carried, *typed)
    bad_rows = rows.where(~fine).select(*carried, F.to_json("_tx").alias(body), F.col("_wrong").alias("missing"))
    bad_documents = parsed.where(items.isNull()).select(*carried, body, F.lit("transactions").alias("missing"))
    return valid, bad_rows.unionByName(bad_documents)


# ------------------------------------------------------------------- reports

def write_summary(df: DataFrame, path: str) -> None:
    """One-row JSON report; nulls are kept as fields."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_drift_summary(spark: SparkSession, path: str) -> DataFrame:
    """status, the report's fields and ``alert``; one 'no_report' row if there is no report."""
    try:
        report = spark.read.schema(schemas.DRIFT_SUMMARY).json(path)
        status = "ok"
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        report = spark.range(1).select(F.from_json(F.lit("{}"), schemas.DRIFT_SUMMARY).alias("r")).select("r.*")
        status = "no_report"
    return report.select(F.lit(status).alias("status"), "*", any_alert().alias("alert"))


def read_time_log(spark: SparkSession, path: str) -> DataFrame:
    """date, minutes; rows whose minutes are no whole number are skipped."""
    log = require_columns(_named_csv(spark, path), ["date", "minutes"])
    whole = strip("minutes").rlike(r"^[+-]?\d+$")
    return log.where(whole).select(
        F.col("date").try_cast("date").alias("date"), strip("minutes").try_cast("bigint").alias("minutes"))


# -------------------------------------------------------------------- images

def read_images(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """All images below a folder by file extension, in any letter case."""
    any_case = ["".join(f"[{c}{c.upper()}]" for c in ext) for ext in K.IMAGE_EXTENSIONS]
    images = (
        spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True)
        .option("pathGlobFilter", "*.{" + ",".join(any_case) + "}").load(root)
    )
    return images if limit is None else images.limit(limit)


def pixels_hex(values: Column) -> Column:
    """Binary column from an array of integers 0..255."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
