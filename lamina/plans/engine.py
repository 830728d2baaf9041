"""The engine end to end: tables in the shared folder, written, changed, compacted and exported."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamina.operators.engine import Engine
from lamina.plans.registry import query, table as t
from lamina.sources.export import export, read_export
from lamina.sources.shared import shared_folder


def _root(spark) -> str:
    return f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}"


def _customers(spark, sf_dir):
    """A table after an insert, an update, a delete and an aborted delete; commit numbers of the first three."""
    e, c = Engine(spark, _root(spark)), t(spark, sf_dir, "customer")
    k = e.create("customer", c.schema, "c_custkey")
    at = []
    for change in (lambda x: k.insert(c, x), lambda x: k.update("c_nationkey = 3", {"c_acctbal": F.lit(0.0)}, x), lambda x: k.delete('c_mktsegment = "BUILDING"', x)):
        x = e.begin()
        change(x)
        at.append(e.commit(x))
    x = e.begin()
    k.delete("c_custkey > 10", x)
    e.rollback(x)
    return e, k, at


_UPDATED = "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"


@query(f"{_UPDATED} WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL")
def dml_current(spark, sf_dir):
    _, k, _ = _customers(spark, sf_dir)
    return k.scan(columns=["c_custkey", "c_nationkey", "c_acctbal"])


@query(_UPDATED)
def dml_as_of(spark, sf_dir):
    _, k, at = _customers(spark, sf_dir)
    return k.scan(as_of=at[1], columns=["c_custkey", "c_nationkey", "c_acctbal"])


@query(f"SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM ({_UPDATED})")
def sql_as_of(spark, sf_dir):
    e, _, at = _customers(spark, sf_dir)
    return e.sql(f"SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer AS OF TxnId {at[1]}")


@query(f"{_UPDATED} WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL")
def compacted(spark, sf_dir):
    _, k, _ = _customers(spark, sf_dir)
    k.compact(files=2)
    return k.scan(columns=["c_custkey", "c_nationkey", "c_acctbal"])


@query("SELECT 'insert' AS op, count(*) * 5 AS n FROM customer UNION ALL SELECT 'update', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'delete', count(*) * 5 FROM customer WHERE c_mktsegment = 'BUILDING'")
def dml_changes(spark, sf_dir):
    _, k, _ = _customers(spark, sf_dir)
    return k.changes().groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def export_round_trip(spark, sf_dir):
    root = _root(spark)
    export(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), root)
    return read_export(spark, root)


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def export_partitioned(spark, sf_dir):
    root = _root(spark)
    export(t(spark, sf_dir, "part").select("p_partkey", "p_size"), root, partition_by=("p_size",))
    return read_export(spark, root).groupBy(F.col("p_size").cast("int").alias("p_size")).agg(F.count("*").alias("n"))
