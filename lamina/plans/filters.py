"""Filter language and scan filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import predicate as P
from lamina.plans.fixtures import CTE, orders_v
from lamina.plans.registry import query, table

#: name, table, columns, filter text, the same in SQL
CASES = [
    ("filter_int_eq", "nation", "n_nationkey, n_name", "n_regionkey = 1", "n_regionkey = 1"),
    ("filter_int_range", "customer", "c_custkey, c_acctbal", "c_custkey >= 100 AND c_custkey < 200", "c_custkey >= 100 AND c_custkey < 200"),
    ("filter_float_gt", "customer", "c_custkey, c_acctbal", "c_acctbal > 9000.5", "c_acctbal > 9000.5"),
    ("filter_negative", "supplier", "s_suppkey, s_acctbal", "s_acctbal <= -0.5 || s_acctbal > 9900", "s_acctbal <= -0.5 OR s_acctbal > 9900"),
    ("filter_string", "orders", "o_orderkey", 'o_orderstatus = "F" && o_orderpriority != "1-URGENT"', "o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'"),
    ("filter_word_ops", "part", "p_partkey", "p_size gte 40 AND p_size lt 45 AND p_retailprice gt 950", "p_size >= 40 AND p_size < 45 AND p_retailprice > 950"),
    ("filter_not", "nation", "n_nationkey", "NOT (n_regionkey = 1 OR n_regionkey = 2)", "NOT (n_regionkey = 1 OR n_regionkey = 2)"),
    ("filter_precedence", "nation", "n_nationkey", "n_regionkey = 0 OR n_regionkey = 1 AND n_nationkey > 10", "n_regionkey = 0 OR (n_regionkey = 1 AND n_nationkey > 10)"),
    ("filter_is_not_null", "documents", "doc_id, n_chars", "text != null AND n_chars > 5000", "text IS NOT NULL AND n_chars > 5000"),
    ("filter_not_null_logic", "documents", "doc_id", 'NOT (source = "src1") AND ! (lang == "en")', "NOT (source = 'src1') AND NOT (lang = 'en')"),
    ("filter_or_same_column", "part", "p_partkey, p_size", "p_size = 1 OR p_size = 7 OR p_size > 49", "p_size = 1 OR p_size = 7 OR p_size > 49"),
]


def _case(name, t, cols, text, sql):
    @query(f"SELECT {cols} FROM {t} WHERE {sql}", name=name)
    def run(spark, sf_dir):
        return P.apply(table(spark, sf_dir, t), text).select(*cols.split(", "))


for case in CASES:
    _case(*case)


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
def scan_filter_between(spark, sf_dir):
    return table(spark, sf_dir, "part").where(P.between("p_size", 10, 12)).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring')")
def scan_filter_like(spark, sf_dir):
    return table(spark, sf_dir, "part").where(P.contains("p_name", "%ring%")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def scan_filter_in(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS flag FROM documents) WHERE flag IS NOT TRUE")
def scan_filter_is_not_true(spark, sf_dir):
    flag = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1)
    return table(spark, sf_dir, "documents").select("doc_id", flag.alias("flag")).where(P.is_not_true("flag")).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)")
def delete_mask(spark, sf_dir):
    from lamina.functions.merge import delete_mask as mask

    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return mask(o, o.where("o_orderkey % 4 = 0"), key="o_orderkey")


@query(f"{CTE} SELECT o_orderkey FROM orders_v WHERE deleted_txn IS NULL AND created_txn < 20")
def filter_is_null(spark, sf_dir):
    return P.apply(orders_v(spark, sf_dir), "deleted_txn = null AND created_txn < 20").select("o_orderkey")


@query(f"{CTE} SELECT o_orderkey FROM orders_v WHERE NOT (deleted_txn > 60 AND created_txn < 100) OR o_orderkey = 7")
def filter_three_valued(spark, sf_dir):
    """NOT over a comparison with null stays null, unless the other side of AND is false."""
    return P.apply(orders_v(spark, sf_dir), "NOT (deleted_txn > 60 AND created_txn < 100) OR o_orderkey = 7").select("o_orderkey")
