"""Gazetteer tables: reading, building, deriving from label templates, taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktally import schemas
from sparktally.functions.text import BLANKS_TO_ONE, strip
from sparktally.session import cut_lineage
from sparktally.sources.tables import _named_csv, require_columns

#: Aliases of one merchant are numbered below this step.
_ALIASES_PER_MERCHANT = 1 << 20


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """alias_idx, alias, merchant_id, display_name of every line.

    The order of the file decides ties. A file may carry it as ``alias_idx``; if not, lines
    are numbered by file, block and line: each block counts its own lines, and only the
    blocks are put in order. Operators that fold aliases drop those that come out empty.
    """
    raw = require_columns(_named_csv(spark, path), schemas.GAZETTEER)
    if "alias_idx" in raw.columns:
        numbered = raw.withColumn("alias_idx", F.col("alias_idx").cast("bigint"))
    else:
        block = ["_file", "_block"]
        lines = cut_lineage(raw.select(
            *schemas.GAZETTEER, F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")), "lines")
        sizes = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
        before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        numbered = lines.join(offsets, block).withColumn("alias_idx", F.col("_line") - F.col("_first") + F.col("_before"))
    return numbered.select("alias_idx", "alias", "merchant_id", "display_name")


def build_gazetteer(df: DataFrame) -> DataFrame:
    """Lower-cased, stripped aliases; the first occurrence of an alias wins."""
    keyed = df.select(
        strip(F.lower(strip("alias"))).alias("alias"), F.col("alias_idx").cast("bigint").alias("alias_idx"),
        F.col("merchant_id").cast("string").alias("merchant_id"),
        F.col("display_name").cast("string").alias("display_name"))
    first = F.min_by(F.struct("alias_idx", "merchant_id", "display_name"), "alias_idx")
    return keyed.groupBy("alias").agg(first.alias("_f")).select(
        "_f.alias_idx", "alias", "_f.merchant_id", "_f.display_name")


def write_gazetteer(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _template_alias(template: Column) -> Column:
    for part in ("CB ", "PRLV ", "VIR ", "{city}", "{city_code}", "{month}", "{year}"):
        template = F.replace(template, F.lit(part), F.lit(""))
    return strip(F.regexp_replace(F.lower(strip(template)), BLANKS_TO_ONE, " "))


def derive_aliases(templates: DataFrame) -> DataFrame:
    """Aliases from (merchant_order, merchant, template) rows.

    Per merchant: its templates without operation prefixes and placeholders,
    its own name, and the special short names, distinct and sorted.
    """
    base = F.replace(F.lower("merchant"), F.lit("'"), F.lit(""))
    lower = F.lower("merchant")
    own = F.concat(
        F.array(_template_alias(F.col("template")), base),
        F.when(lower.startswith("mc"), F.array(F.lit("mcdo"), F.lit("mcdonald"))).otherwise(F.array().cast("array<string>")),
        F.when(lower == "totalenergies", F.array(F.lit("total"))).otherwise(F.array().cast("array<string>")),
    )
    aliases = templates.select("merchant_order", "merchant", base.alias("merchant_id"), F.explode(own).alias("alias"))
    aliases = aliases.where("alias <> ''").distinct()
    place = F.row_number().over(Window.partitionBy("merchant_order", "merchant").orderBy("alias")) - 1
    return aliases.select(
        (F.col("merchant_order") * _ALIASES_PER_MERCHANT + place).cast("bigint").alias("alias_idx"),
        "alias", "merchant_id", F.col("merchant").alias("display_name"))


def taxonomy(df: DataFrame, category: str = "category", merchant: str = "merchant") -> DataFrame:
    """category and the JSON list of its distinct merchants, by name."""
    distinct = df.select(category, merchant).distinct()
    return distinct.groupBy(F.col(category).alias("category")).agg(
        F.to_json(F.sort_array(F.collect_list(merchant))).alias("merchants"))
