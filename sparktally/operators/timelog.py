"""Completion, daily average and burndown tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _exact(c: Column) -> Column:
    """Decimal form, so that sums do not depend on the order of the rows."""
    return c.cast("decimal(28,6)")


def weighted_completion(df: DataFrame, weight: Column, done: Column, actual: Column) -> DataFrame:
    """pct_done (whole percent), total and remaining = total - whole units spent, at least 0."""
    sums = df.agg(
        F.coalesce(F.sum(_exact(weight)), F.lit(0)).cast("double").alias("total"),
        F.coalesce(F.sum(F.when(done, _exact(weight))), F.lit(0)).cast("double").alias("_done"),
        F.coalesce(F.sum(actual.cast("bigint")), F.lit(0)).cast("double").alias("_spent"),
    )
    pct = F.coalesce(F.rint(F.col("_done") * 100 / F.nullif("total", F.lit(0.0))), F.lit(0.0))
    return sums.select(
        pct.cast("bigint").alias("pct_done"), "total",
        F.greatest(F.lit(0.0), F.col("total") - F.col("_spent")).alias("remaining"),
    )


def avg_daily(log: DataFrame, day: str = "date", minutes: str = "minutes") -> DataFrame:
    """Minutes per logged day, 0.0 for an empty log."""
    return log.where(F.col(minutes).isNotNull()).agg(
        F.coalesce(F.sum(minutes) / F.nullif(F.count_distinct(day), F.lit(0)), F.lit(0.0)).alias("avg_minutes")
    )


def burndown(log: DataFrame, start: datetime.date, end: datetime.date, total: float,
             day: str = "date", minutes: str = "minutes") -> DataFrame:
    """Ideal and actual remaining hours for every calendar day from start to end.

    Minutes are summed per day first. The ordered window then sees one row per
    calendar day, so its single task is bounded by the length of the calendar.
    """
    days = max(1, (end - start).days)
    last = start + datetime.timedelta(days=days)
    per_day = (
        log.where(F.col(day).between(F.lit(start), F.lit(last)))
        .groupBy(F.col(day).alias("day")).agg(F.sum(minutes).alias("minutes"))
    )
    span = log.sparkSession.range(0, days + 1).select(
        F.col("id").alias("i"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("day")
    )
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.coalesce("minutes", F.lit(0))).over(so_far) / 60.0
    return span.join(per_day, "day", "left").select(
        "day",
        (F.lit(float(total)) * (1 - F.col("i") / days)).alias("ideal"),
        F.greatest(F.lit(0.0), F.lit(float(total)) - spent).alias("actual"),
    )
