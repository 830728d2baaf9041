"""Versioned data derived from ``orders``: a transaction log, row versions and cell deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.plans.registry import table

SNAPSHOT = 80

#: The same three tables for SQL.
CTE = """
WITH txn_log AS (
  SELECT DISTINCT CAST(o_orderkey % 120 AS BIGINT) + 1 AS txn_id,
    CASE WHEN (o_orderkey % 120 + 1) % 17 = 0 THEN 'active'
         WHEN (o_orderkey % 120 + 1) % 13 = 0 THEN 'aborted' ELSE 'committed' END AS status,
    CASE WHEN (o_orderkey % 120 + 1) % 17 = 0 OR (o_orderkey % 120 + 1) % 13 = 0 THEN NULL
         ELSE CAST((o_orderkey % 120 + 1) + (o_orderkey % 120 + 1) % 5 AS BIGINT) END AS commit_seq
  FROM orders),
orders_v AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
    CAST(o_orderkey % 120 AS BIGINT) + 1 AS created_txn,
    CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 120 AS BIGINT) + 11 END AS deleted_txn
  FROM orders),
orders_delta AS (
  SELECT o_orderkey AS pk, 'o_totalprice' AS col, CAST(o_orderkey % 120 AS BIGINT) + 5 AS txn_id,
         o_totalprice AS before_v, CASE WHEN o_orderkey % 45 = 0 THEN NULL ELSE o_totalprice + 100.0 END AS after_v
  FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL
  SELECT o_orderkey, 'o_totalprice', CAST(o_orderkey % 120 AS BIGINT) + 25,
         CASE WHEN o_orderkey % 30 = 0 THEN NULL ELSE o_totalprice + 100.0 END, o_totalprice + 200.0
  FROM orders WHERE o_orderkey % 10 = 0)
"""


def seen(snapshot: int) -> str:
    """SQL for ids that count at a snapshot."""
    return f"SELECT txn_id FROM txn_log WHERE status = 'committed' AND commit_seq <= {snapshot} AND txn_id <= {snapshot}"


def visible_sql(snapshot: int, columns: str = "*") -> str:
    return f"SELECT {columns} FROM orders_v WHERE created_txn IN ({seen(snapshot)}) AND (deleted_txn IS NULL OR deleted_txn NOT IN ({seen(snapshot)}))"


def _group():
    return (F.col("o_orderkey") % 120).cast("long")


def txn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select((_group() + 1).alias("txn_id")).distinct()
    active, aborted = F.col("txn_id") % 17 == 0, F.col("txn_id") % 13 == 0
    return t.select("txn_id", F.when(active, "active").when(aborted, "aborted").otherwise("committed").alias("status"), F.when(~active & ~aborted, F.col("txn_id") + F.col("txn_id") % 5).alias("commit_seq"))


def orders_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.when(F.col("o_orderkey") % 7 == 0, _group() + 11)
    return table(spark, sf_dir, "orders").withColumns({"created_txn": _group() + 1, "deleted_txn": deleted})


def orders_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    first = o.where(k % 5 == 0).select(k.alias("pk"), F.lit("o_totalprice").alias("col"), (_group() + 5).alias("txn_id"), p.alias("before_v"), F.when(k % 45 != 0, p + 100.0).alias("after_v"))
    second = o.where(k % 10 == 0).select(k.alias("pk"), F.lit("o_totalprice").alias("col"), (_group() + 25).alias("txn_id"), F.when(k % 30 != 0, p + 100.0).alias("before_v"), (p + 200.0).alias("after_v"))
    return first.unionByName(second)
