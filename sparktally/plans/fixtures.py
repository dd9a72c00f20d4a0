"""Derived inputs shared by the queries: transactions and a gazetteer.

The SQL text runs unchanged on Spark and DuckDB. ``transactions`` has one row per
order, so it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktally.sources.tables import read_table

LABEL_SEED_SQL = """
SELECT * FROM (VALUES
(0,'CB CARREFOUR 75 PARIS','Groceries','carrefour',5411),
(1,'CB INTERMARCHÉ 69 LYON','Groceries','intermarche',5411),
(2,'CASINO  LILLE','Groceries','casino',5411),
(3,'CB MCDO TOULOUSE','Restaurants','mcdonalds',5814),
(4,'BK STRASBOURG','Restaurants','burger king',5814),
(5,'CB CAFÉ DE LA GARE','Restaurants','',5814),
(6,'PRLV RATP 07','Transport','ratp',4111),
(7,'UBER *TRIP PARIS','Transport','uber',4111),
(8,'TOTAL STATION LYON','Transport','totalenergies',4111),
(9,'PRLV EDF FACTURE 07/2025 RUM12345678-4321','Utilities','edf',4900),
(10,'PRLV ORANGE FACTURE 03/2025','Utilities','orange',4900),
(11,'LOYER FONCIA 01/2025','Rent','foncia',6513),
(12,'VIR SALAIRE ACME 02/2025 IBAN FR7612345678901234567890123','Salary','',6011),
(13,'CB ZXQW PLORP STORE 9999 XJ-REF88','Groceries','',5411),
(14,'ACHAT ?????','Restaurants','',5814),
(15,'','Transport','',4111)
) AS t(idx, raw, category, merchant, mcc)
"""

TX_SQL = """
SELECT o_orderkey AS tx_id, CAST(o_orderdate AS DATE) AS tx_date,
  CASE WHEN category = 'Salary' THEN o_totalprice ELSE -o_totalprice END AS amount,
  'EUR' AS currency,
  CASE WHEN o_orderkey % 12 = 0 THEN concat(raw, ' TPE', CAST(1000 + o_orderkey % 9000 AS VARCHAR(8)))
       WHEN o_orderkey % 12 = 5 THEN concat(replace(raw, 'CB ', 'CB TPE '), ' REF', CAST(100000 + o_orderkey % 900000 AS VARCHAR(8)))
       ELSE raw END AS raw_label,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN raw LIKE 'CB %' THEN 'CB'
       WHEN raw LIKE 'PRLV %' THEN 'PRLV' WHEN raw LIKE 'VIR %' THEN 'VIR' END AS channel,
  CASE WHEN o_orderkey % 3 = 0 THEN mcc END AS mcc,
  category AS category_label, merchant AS merchant_label,
  CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'prod' END AS split,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Groceries' ELSE category END AS pred,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS conf
FROM {orders} JOIN {label_seed}
  ON idx = CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 4 = 0 THEN 9 + o_custkey % 3
                ELSE (o_orderkey * 7 + o_custkey * 3) % 16 END
"""

GAZ_SQL = """
SELECT * FROM (VALUES
(0,'carrefour','carrefour','Carrefour'),(1,'intermarché','intermarche','Intermarché'),
(2,'casino','casino','Casino'),(3,'casino','casino2','Casino Bis'),
(4,'mcdo','mcdonalds','McDonald''s'),(5,'bk','burger king','Burger King'),
(6,'ratp','ratp','RATP'),(7,'uber *trip','uber','Uber'),(8,'total','totalenergies','TotalEnergies'),
(9,'edf','edf','EDF'),(10,'orange','orange','Orange'),(11,'loyer foncia','foncia','Foncia')
) AS t(alias_idx, alias, merchant_id, display_name)
"""

#: Leading part of the SQL side of every query on the derived tables.
WITH_TX = (
    f"WITH label_seed AS ({LABEL_SEED_SQL}),\n"
    f"tx AS ({TX_SQL.format(orders='orders', label_seed='label_seed')}),\n"
    f"gaz AS ({GAZ_SQL})"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        TX_SQL, orders=table(spark, sf_dir, "orders"), label_seed=spark.sql(LABEL_SEED_SQL)
    )


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.sql(GAZ_SQL)
