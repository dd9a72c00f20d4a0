"""Completion, daily average and burndown."""

import datetime

from pyspark.sql import functions as F

from sparktally.operators import timelog as L
from sparktally.plans.fixtures import table
from sparktally.plans.registry import query


def minutes_log(spark, sf):
    return table(spark, sf, "events").select(
        F.to_date("ts").alias("date"), F.floor("value").cast("bigint").alias("minutes"))


@query("weighted_completion", """
WITH s AS (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS total,
  CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(28,6)) END) AS DOUBLE) AS done,
  CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(trunc(o_totalprice) AS BIGINT) END) AS DOUBLE) AS spent FROM orders)
SELECT CAST(round_even(done * 100 / total, 0) AS BIGINT) AS pct_done, total, greatest(0.0, total - spent) AS remaining FROM s""")
def weighted_completion(spark, sf):
    done = F.col("o_orderstatus") == "F"
    price = F.col("o_totalprice")
    return L.weighted_completion(table(spark, sf, "orders"), price, done, F.when(done, price))


@query("avg_daily", """
SELECT CAST(SUM(CAST(floor(value) AS BIGINT)) AS DOUBLE) / COUNT(DISTINCT CAST(ts AS DATE)) AS avg_minutes FROM events""")
def avg_daily(spark, sf):
    return L.avg_daily(minutes_log(spark, sf))


@query("burndown", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, SUM(CAST(floor(value) AS BIGINT)) AS m FROM events GROUP BY 1),
c AS (SELECT i, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(0, 41) t(i))
SELECT c.day AS day, CAST(9000 AS DOUBLE) * (1 - i / CAST(40 AS DOUBLE)) AS ideal,
  greatest(CAST(0 AS DOUBLE), CAST(9000 AS DOUBLE) - CAST(SUM(coalesce(m, 0)) OVER (ORDER BY c.day) AS DOUBLE) / CAST(60 AS DOUBLE)) AS actual
FROM c LEFT JOIN d ON c.day = d.day""")
def burndown(spark, sf):
    return L.burndown(minutes_log(spark, sf), datetime.date(2024, 1, 1), datetime.date(2024, 2, 10), 9000.0)
