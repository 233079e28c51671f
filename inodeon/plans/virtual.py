"""A virtual volume and a virtual change journal over the relational test tables.

The volume is a forest under the root: regions, their nations, their customers as directories and orders as files. The journal
has one entry for each event. Both as Spark frames and as DuckDB text, so that the same query runs in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGION, NATION, CUSTOMER, ORDER = 1000, 2000, 1_000_000, 1_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nodes(df: DataFrame, number: F.Column, parent: F.Column, flags: int, name: F.Column) -> DataFrame:
    return df.select(
        number.cast("long").alias("record_number"),
        parent.cast("long").alias("parent_record_number"),
        F.lit(flags).alias("flags"),
        F.lit(0x10 if flags & 2 else 0x20).cast("long").alias("file_attributes"),
        name.alias("file_name"),
    )


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_number, parent_record_number, flags, file_attributes, file_name)``."""
    c = F.col
    root = _nodes(spark.range(1), F.lit(5), F.lit(5), 3, F.lit("."))
    regions = _nodes(read(spark, sf_dir, "region"), c("r_regionkey") + REGION, F.lit(5), 3, c("r_name"))
    nations = _nodes(read(spark, sf_dir, "nation"), c("n_nationkey") + NATION, c("n_regionkey") + REGION, 3, c("n_name"))
    customers = _nodes(read(spark, sf_dir, "customer"), c("c_custkey") + CUSTOMER, c("c_nationkey") + NATION, 3, c("c_name"))
    orders = _nodes(read(spark, sf_dir, "orders"), c("o_orderkey") + ORDER, c("o_custkey") + CUSTOMER, 1, F.concat(F.lit("Order#"), c("o_orderkey").cast("string")))
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(orders)


REASON_OF = {"signup": 0x100, "click": 0x2, "view": 0x8000, "purchase": 0x80002000, "error": 0x80000200}


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(usn, record_number, parent_record_number, reason, file_name, ts)``; entries are about customers' files."""
    c = F.col
    reason = F.lit(0)
    for kind, value in REASON_OF.items():
        reason = F.when(c("event_type") == kind, F.lit(value)).otherwise(reason)
    return read(spark, sf_dir, "events").select(
        c("event_id").cast("long").alias("usn"),
        (c("user_id") + CUSTOMER).cast("long").alias("record_number"),
        (c("user_id") + CUSTOMER).cast("long").alias("parent_record_number"),
        reason.cast("long").alias("reason"),
        F.concat(c("event_type"), F.lit(".log")).alias("file_name"),
        c("ts"),
    )


VOL_SQL = f"""vol AS (
  SELECT 5::BIGINT AS record_number, 5::BIGINT AS parent_record_number, 3 AS flags, 16::BIGINT AS file_attributes, '.' AS file_name
  UNION ALL SELECT ({REGION} + r_regionkey)::BIGINT, 5::BIGINT, 3, 16::BIGINT, r_name FROM region
  UNION ALL SELECT ({NATION} + n_nationkey)::BIGINT, ({REGION} + n_regionkey)::BIGINT, 3, 16::BIGINT, n_name FROM nation
  UNION ALL SELECT ({CUSTOMER} + c_custkey)::BIGINT, ({NATION} + c_nationkey)::BIGINT, 3, 16::BIGINT, c_name FROM customer
  UNION ALL SELECT ({ORDER} + o_orderkey)::BIGINT, ({CUSTOMER} + o_custkey)::BIGINT, 1, 32::BIGINT, 'Order#' || o_orderkey::VARCHAR FROM orders
)"""

PATHS_SQL = """paths AS (
  SELECT record_number, file_name AS path FROM vol WHERE parent_record_number = 5 AND record_number <> 5
  UNION ALL
  SELECT v.record_number, p.path || chr(92) || v.file_name FROM vol v JOIN paths p ON v.parent_record_number = p.record_number
)"""

JRN_SQL = f"""jrn AS (
  SELECT event_id::BIGINT AS usn, ({CUSTOMER} + user_id)::BIGINT AS record_number, ({CUSTOMER} + user_id)::BIGINT AS parent_record_number,
         (CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in REASON_OF.items())} ELSE 0 END)::BIGINT AS reason,
         event_type || '.log' AS file_name, ts
  FROM events
)"""
