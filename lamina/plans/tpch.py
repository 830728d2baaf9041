"""Decision-support queries in the shapes of TPC-H 1, 3, 5, 6, 7, 10 and 18, on the columns that there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.plans.registry import query, table as t

_REV = "l_extendedprice * (1 - l_discount)"


def day(x: str):
    return F.lit(x).cast("timestamp_ntz")


@query(f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({_REV}), 2) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus")
def q1(s, d):
    rev = F.expr(_REV)
    return (
        t(s, d, "lineitem").where(F.col("l_shipdate") <= day("2000-09-02")).groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(rev), 2).alias("sum_disc_price"),
            F.round(F.sum(rev * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
        )
    )


@query(f"SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
def q3(s, d):
    c = t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t(s, d, "orders").where(F.col("o_orderdate") < day("1998-03-15")).select("o_orderkey", "o_custkey", "o_orderdate")
    l = t(s, d, "lineitem").where(F.col("l_shipdate") > day("1998-03-15"))
    j = l.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.expr(_REV)), 2).alias("revenue")).orderBy(F.col("revenue").desc(), "l_orderkey").limit(10)


@query(f"SELECT n_name, round(sum({_REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name")
def q5(s, d):
    n = t(s, d, "nation").join(t(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    sup = t(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t(s, d, "orders").where((F.col("o_orderdate") >= day("1997-01-01")) & (F.col("o_orderdate") < day("1998-01-01")))
    o = o.join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    l = t(s, d, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    j = l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(F.expr(_REV)), 2).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6(s, d):
    l = t(s, d, "lineitem").where((F.col("l_shipdate") >= day("1997-01-01")) & (F.col("l_shipdate") < day("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return l.agg(F.round(F.sum(F.expr("l_extendedprice * l_discount")), 2).alias("revenue"))


@query(f"SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, round(sum({_REV}), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey = 1 AND b.n_regionkey = 2 GROUP BY 1, 2, 3")
def q7(s, d):
    n = t(s, d, "nation")
    sup = t(s, d, "supplier").join(n.where("n_regionkey = 1").select("n_nationkey", F.col("n_name").alias("supp_nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "supp_nation")
    cust = t(s, d, "customer").join(n.where("n_regionkey = 2").select("n_nationkey", F.col("n_name").alias("cust_nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "cust_nation")
    o = t(s, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation")
    j = t(s, d, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(F.round(F.sum(F.expr(_REV)), 2).alias("revenue"))


@query(f"SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
def q10(s, d):
    o = t(s, d, "orders").where((F.col("o_orderdate") >= day("1996-10-01")) & (F.col("o_orderdate") < day("1997-01-01"))).select("o_orderkey", "o_custkey")
    j = t(s, d, "lineitem").where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.groupBy("o_custkey").agg(F.sum(F.expr(_REV)).alias("r"))
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", F.round("r", 2).alias("revenue"), "n_name").orderBy(F.col("revenue").desc(), "c_custkey").limit(20)


@query("SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q18(s, d):
    big = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 200")
    j = t(s, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("c_name", "c_custkey", "o_orderkey", "o_totalprice", F.round("q", 2).alias("qty")).orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)
