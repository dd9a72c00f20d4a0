"""Exact running totals over a global order without one task seeing every row."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktally.session import cut_lineage

#: Distinct values per slice of the value axis, and the least number of slices.
SLICE_VALUES = 200_000
LEAST_SLICES = 64


def running_totals(df: DataFrame, value: str, counts: list[str], slices: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` and ``all_<c>`` for every count column, ordered by ``value``.

    ``df`` holds one row per distinct value, none of them null or NaN. The axis is cut at
    approximate quantiles; a task orders one slice only, and slice totals give each slice
    its starting point. The number of slices follows the number of values, so a slice
    stays as small however many there are. The cuts affect the
    balance alone: totals are exact wherever they fall. The values are written
    once, so that finding the cuts does not run the plan behind them again.
    """
    df = cut_lineage(df, "values")
    slices = slices or max(LEAST_SLICES, df.count() // SLICE_VALUES)
    cuts = sorted(set(df.approxQuantile(value, [i / slices for i in range(1, slices)], 0.5 / slices)))
    splits = [-math.inf, *cuts, math.inf]
    sliced = Bucketizer(splits=splits, inputCol="_value", outputCol="_slice").transform(
        df.withColumn("_value", F.col(value).cast("double"))
    ).drop("_value")

    by_slice = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = by_slice.select(
        "_slice",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in counts],
        *[F.sum(f"_s_{c}").over(everything).alias(f"all_{c}") for c in counts],
    )
    within = Window.partitionBy("_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(offsets, "_slice")
        .withColumns({f"cum_{c}": F.col(f"_before_{c}") + F.sum(c).over(within) for c in counts})
        .drop("_slice", *[f"_before_{c}" for c in counts])
    )


def is_number(value: str) -> Column:
    """Neither null nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def weighted_count(condition: Column) -> Column:
    """Rows that satisfy a condition, as a BIGINT aggregate (null counts as no)."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
