"""The shared input of the rule, report and remediation queries: one merchant row per order.

The SQL text runs unchanged in Spark and in the checking database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercalith.session import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TARGET_SQL = """
SELECT
  o_orderkey AS row_id,
  400000 + n_nationkey AS ProcessorBINCIB,
  'Processor ' || r_name AS ProcessorName,
  n_nationkey AS LocationCountry,
  CASE WHEN o_orderkey % 97 = 0 THEN 400000 + n_nationkey ELSE 500000 + n_regionkey END AS AcquirerBID,
  'Bank of ' || r_name AS AcquirerName,
  CASE WHEN o_orderkey % 10 = 3 THEN 'm ' || CAST(o_orderkey - 1 AS STRING)
       ELSE 'M' || CAST(o_orderkey AS STRING) END AS AcquirerMerchantID,
  CASE WHEN o_orderkey % 101 = 0 THEN 500000 + n_regionkey ELSE 600000 + n_regionkey END AS AcquirerBIN,
  CASE WHEN o_orderkey % 4 = 0 THEN 'AGG' || CAST(o_custkey % 20 AS STRING) END AS AggregatorID,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Aggregator ' || CAST(o_custkey % 20 AS STRING) END AS AggregatorName,
  CASE WHEN o_orderkey % 4 = 0 THEN 'p' END AS AggregatorType,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL
       WHEN o_orderkey % 223 = 0 THEN '--'
       WHEN o_orderkey % 10 = 3 THEN 'CA ' || CAST(o_orderkey - 1 AS STRING)
       WHEN o_orderkey % 10 = 7 THEN 'ca' || CAST(o_orderkey - 1 AS STRING)
       ELSE 'CA' || CAST(o_orderkey AS STRING) END AS CAID,
  CASE WHEN o_orderkey % 113 = 0 THEN 'Bank of ' || r_name
       WHEN o_orderkey % 127 = 0 THEN ' bank of ' || lower(r_name) || 'N'
       WHEN o_orderkey % 20 = 3 THEN 'Shop ' || CAST(o_orderkey - 1 AS STRING)
       ELSE 'Shop ' || CAST(o_orderkey AS STRING) END AS DBAName,
  CASE WHEN o_orderkey % 131 = 0 THEN 'BANK OF ' || r_name
       ELSE c_name || ' LLC' END AS LegalName,
  CAST(o_custkey % 2 AS INT) AS CorporateStatus,
  CAST(NULL AS STRING) AS CorporateName,
  CAST(o_orderdate AS DATE) AS DateSigned,
  CASE WHEN o_orderkey % 4 <> 0 THEN NULL
       WHEN o_orderkey % 28 = 0 THEN NULL
       WHEN o_orderkey % 36 = 0 THEN 'shop ' || CAST(o_orderkey AS STRING)
       ELSE 'Aggregator ' || CAST(o_custkey % 20 AS STRING) || ' - Shop ' || CAST(o_orderkey AS STRING) END AS BASEIIName,
  CASE WHEN o_orderkey % 137 = 0 THEN 'PO Box 12'
       WHEN o_orderkey % 139 = 0 THEN 'xxx'
       WHEN o_orderkey % 149 = 0 THEN '12, ' || n_name
       WHEN o_orderkey % 151 = 0 THEN 'Nation ' || CAST(n_nationkey AS STRING)
       WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey AS STRING) || ' main street'
       ELSE CAST(o_orderkey AS STRING) || ' Main Street' END AS Street,
  CASE WHEN o_orderkey % 151 = 0 THEN 'nation ' || CAST(n_nationkey AS STRING)
       WHEN o_orderkey % 157 = 0 THEN 'N/A'
       ELSE n_name END AS City,
  CAST(NULL AS STRING) AS StateProvinceCode,
  CASE WHEN o_orderkey % 163 = 0 THEN NULL ELSE 'Z' || CAST(o_custkey % 1000 AS STRING) END AS PostalCode,
  CAST(5000 + o_custkey % 100 AS INT) AS MCC1,
  CAST(NULL AS INT) AS MCC2, CAST(NULL AS INT) AS MCC3, CAST(NULL AS INT) AS MCC4, CAST(NULL AS INT) AS MCC5,
  CAST(NULL AS INT) AS MCC6, CAST(NULL AS INT) AS MCC7, CAST(NULL AS INT) AS MCC8, CAST(NULL AS INT) AS MCC9,
  CASE WHEN o_orderkey % 5 = 1 THEN NULL
       WHEN o_orderkey % 4 = 0 AND o_custkey % 20 < 3 THEN 'TAX-SHARED-' || CAST(o_custkey % 20 AS STRING)
       WHEN o_orderkey % 167 = 0 THEN 'n/a'
       WHEN o_orderkey % 173 = 0 THEN '9999999'
       WHEN o_orderkey % 179 = 0 THEN '---'
       ELSE 'TAX' || CAST(o_custkey AS STRING) END AS BusinessRegistrationID
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


_written: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def target_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a lazy plan over the given tables."""
    for name in ("orders", "customer", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(TARGET_SQL)


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a written table, built on first use.

    A master table is built once and then read by every rule, so the rules scan just the
    columns they need of a columnar dataset and not the joins behind it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = scratch_path(spark, "target")
        target_plan(spark, sf_dir).write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
