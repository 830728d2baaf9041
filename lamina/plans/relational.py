"""The relational surface: joins, aggregates, grouping, windows, ordering, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators.joins import asof_join, range_join
from lamina.plans.registry import query, table as t


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(s, d):
    c = t(s, d, "customer").where("c_mktsegment = 'BUILDING'")
    return t(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(s, d):
    return t(s, d, "supplier").where("s_acctbal > 5000").join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query("SELECT a.k AS a, b.k AS b FROM (SELECT c_nationkey AS k, count(*) FROM customer WHERE c_acctbal > 9800 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def join_full(s, d):
    a = t(s, d, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("a")).distinct()
    b = t(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(s, d):
    return t(s, d, "region").crossJoin(F.broadcast(t(s, d, "nation"))).select("r_name", "n_name")  # fixed tables of 5 and 25 rows


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(s, d):
    a, b = t(s, d, "nation").alias("a"), t(s, d, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("SELECT s_suppkey, n FROM (SELECT s_suppkey, s_acctbal FROM supplier) JOIN (VALUES (1, 0.0, 2000.0), (2, 2000.0, 6000.0), (3, 6000.0, 10000.0)) b(n, lo, hi) ON s_acctbal >= lo AND s_acctbal < hi")
def join_theta(s, d):
    bands = s.createDataFrame([(1, 0.0, 2000.0), (2, 2000.0, 6000.0), (3, 6000.0, 10000.0)], "n int, lo double, hi double")
    return t(s, d, "supplier").join(F.broadcast(bands), (F.col("s_acctbal") >= F.col("lo")) & (F.col("s_acctbal") < F.col("hi"))).select("s_suppkey", "n")


@query("SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, CAST(floor(value) AS BIGINT) * 100 AS v FROM events WHERE value IS NOT NULL) e JOIN (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) o ON o.p >= e.v AND o.p < e.v + 50")
def join_range(s, d):
    # the bounds meet in buckets of the range's width or more, so that this is an equi-join and shuffles like one
    e = t(s, d, "events").where("value is not null").select("event_id", (F.floor("value").cast("long") * 100).alias("v"))
    o = t(s, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("p"))
    return range_join(o, e.withColumn("hi", F.col("v") + 50), point="p", low="v", high="hi", bucket=50).select("event_id", "o_orderkey")


@query("SELECT e.event_id, e.user_id, p.event_id AS before_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND p.ts <= e.ts")
def join_asof(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "ts")
    p = t(s, d, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("before_id"))
    return asof_join(e, p, by="user_id", on="ts", take=["before_id"]).select("event_id", "user_id", "before_id")


@query("SELECT c_custkey, x.o_orderkey, x.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x")
def join_lateral(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    top = t(s, d, "orders").withColumn("i", F.row_number().over(w)).where("i <= 2")
    return top.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def subquery_scalar(s, d):
    o = t(s, d, "orders")
    mean = o.agg((F.avg("o_totalprice") * 1.8).alias("m"))
    return o.join(F.broadcast(mean), F.col("o_totalprice") > F.col("m")).select("o_orderkey")  # one row


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_correlated(s, d):
    t(s, d, "orders").createOrReplaceTempView("lamina_orders")
    return s.sql("SELECT o_orderkey FROM lamina_orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM lamina_orders i WHERE i.o_custkey = o.o_custkey)")


@query("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def subquery_in(s, d):
    return t(s, d, "nation").join(t(s, d, "customer").where("c_acctbal > 9900"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_name")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag")
def agg_basic(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(corr(c_acctbal, c_custkey), 6) AS r, round(covar_samp(c_acctbal, c_nationkey), 4) AS cv FROM customer GROUP BY c_mktsegment")
def agg_spread(s, d):
    return t(s, d, "customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.var_pop("c_acctbal"), 2).alias("vp"), F.round(F.corr("c_acctbal", "c_custkey"), 6).alias("r"), F.round(F.covar_samp("c_acctbal", "c_nationkey"), 4).alias("cv"))


@query("SELECT o_orderstatus, round(median(o_totalprice), 3) AS med, round(quantile_cont(o_totalprice, 0.9), 3) AS p90 FROM orders GROUP BY o_orderstatus")
def agg_quantile(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.median("o_totalprice"), 3).alias("med"), F.round(F.percentile("o_totalprice", 0.9), 3).alias("p90"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, sum(DISTINCT user_id) AS ids FROM events GROUP BY event_type")
def agg_distinct(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.sum_distinct("user_id").alias("ids"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, bool_and(o_totalprice > 1000) AS all_over, bool_or(o_totalprice > 300000) AS any_big, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS top, arg_min(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS low FROM orders GROUP BY o_custkey")
def agg_filter_arg(s, d):
    rank = F.col("o_totalprice") * 1000000 + F.col("o_orderkey")
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_over"), F.bool_or(F.col("o_totalprice") > 300000).alias("any_big"), F.max_by("o_orderkey", rank).alias("top"), F.min_by("o_orderkey", rank).alias("low"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(list(n_nationkey)), '-') AS keys FROM nation GROUP BY n_regionkey")
def agg_lists(s, d):
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string")), "-")
    return t(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), keys.alias("keys"))


@query("SELECT p_brand, mode(p_size % 3) AS m FROM (SELECT p_brand, p_size FROM part UNION ALL SELECT p_brand, 3 FROM part) GROUP BY p_brand")
def agg_mode(s, d):
    p = t(s, d, "part").select("p_brand", "p_size")
    return p.unionByName(p.select("p_brand", F.lit(3).alias("p_size"))).groupBy("p_brand").agg(F.mode(F.col("p_size") % 3).alias("m"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND sum(o_totalprice) > 1000000")
def agg_having(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v")).where("n > 14 AND v > 1000000").drop("v")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(s, d):
    return t(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
def group_sets(s, d):
    a, b = F.col("c_nationkey"), F.col("c_mktsegment")
    return t(s, d, "customer").groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, row_number() {_W} AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) {_W} AS nt FROM orders")
def window_rank(s, d):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t(s, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(3).over(w).alias("nt"))


@query(f"SELECT o_orderkey, round(percent_rank() {_W}, 6) AS pr, round(cume_dist() {_W}, 6) AS cd FROM orders")
def window_distribution(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(s, d, "orders").select("o_orderkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query(f"SELECT o_orderkey, lag(o_orderkey) {_W} AS before, lead(o_orderkey, 2, -1) {_W} AS after, first_value(o_orderkey) {_W} AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(o_orderkey, 2) {_W} AS second FROM orders")
def window_offset(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = "o_orderkey"
    return t(s, d, "orders").select(k, F.lag(k).over(w).alias("before"), F.lead(k, 2, -1).over(w).alias("after"), F.first(k).over(w).alias("first"), F.last(k).over(whole).alias("last"), F.nth_value(k, 2).over(w).alias("second"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def window_running(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(s, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS BIGINT) RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lineitem")
def window_range(s, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_quantity").cast("long")).rangeBetween(-2, 2)
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("near"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(s, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t(s, d, "orders").withColumn("i", F.row_number().over(w)).where("i <= 3").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20")
def sort_top_k(s, d):
    return t(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(20)


@query("SELECT doc_id FROM documents ORDER BY source NULLS FIRST, doc_id LIMIT 15 OFFSET 5")
def sort_offset(s, d):
    return t(s, d, "documents").orderBy(F.col("source").asc_nulls_first(), "doc_id").offset(5).limit(15).select("doc_id")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_intersect(s, d):
    return t(s, d, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k")).intersect(t(s, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(t(s, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(s, d):
    return t(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(t(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(t(s, d, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(s, d):
    return t(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
def cte_recursive(s, d):
    return s.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")


@query("SELECT x, y FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(x, y)")
def values_rows(s, d):
    return s.sql("SELECT x, y FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS v(x, y)")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query("SELECT c_custkey, 'c_acctbal' AS name, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'twice', c_acctbal * 2 FROM customer")
def unpivot(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") * 2).alias("twice"))
    return c.unpivot("c_custkey", ["c_acctbal", "twice"], "name", "v")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 < 3")
def sample_share(s, d):
    """A repeatable sample is one by key: the same rows on every engine."""
    return t(s, d, "orders").where("o_orderkey % 10 < 3").agg(F.count("*").alias("n"))


@query()
def sample_random(s, d):
    return t(s, d, "orders").sample(0.1, seed=7).select("o_orderkey")


@query("SELECT l_returnflag, TRUE AS parts_near, TRUE AS median_near FROM lineitem GROUP BY l_returnflag")
def approx_aggregates(s, d):
    """Sketches, mergeable on the map side, held against exact counts: within four of their standard errors, the median by its rank.

    A distinct count beside sketches would keep a sketch for each key. So sketches come first, a
    handful of rows; a second pass counts keys and the prices below and up to the median, plain numbers.
    """
    l = t(s, d, "lineitem").select("l_returnflag", "l_partkey", F.col("l_extendedprice").alias("price"))
    got = l.groupBy(F.col("l_returnflag").alias("flag")).agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("price", 0.5, 1000).alias("med"))
    held = l.join(F.broadcast(got), F.col("l_returnflag").eqNullSafe(F.col("flag"))).groupBy("l_returnflag", "parts", "med").agg(
        F.count_distinct("l_partkey").alias("exact"), F.count("price").alias("n"),
        F.count_if(F.col("price") < F.col("med")).alias("below"), F.count_if(F.col("price") <= F.col("med")).alias("upto"),
    )
    near = F.abs(F.col("parts") - F.col("exact")) <= 0.08 * F.col("exact")
    # a value is the quantile p if at most that share lies below it and at least that share not above it; no prices have none to miss
    median = (F.col("below") <= 0.51 * F.col("n")) & (F.col("upto") >= 0.49 * F.col("n"))
    return held.select("l_returnflag", near.alias("parts_near"), median.alias("median_near"))


@query("SELECT l_returnflag, sum(l_quantity * 2 + 1) AS s FROM lineitem GROUP BY l_returnflag")
def udf_scalar(s, d):
    """A function of the user's in SQL text, in Arrow batches."""
    import pyarrow.compute as pc

    s.udf.register("twice_and_one", F.arrow_udf(lambda x: pc.add(pc.multiply(x, 2.0), 1.0), "double"))
    t(s, d, "lineitem").createOrReplaceTempView("lamina_lineitem")
    return s.sql("SELECT l_returnflag, sum(twice_and_one(l_quantity)) AS s FROM lamina_lineitem GROUP BY l_returnflag")


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def udf_table(s, d):
    """A table function of the user's, in SQL text with LATERAL."""

    @F.udtf(returnType="word string")
    class SplitWords:
        def eval(self, text: str):
            for word in text.split(" "):
                yield (word,)

    s.udtf.register("split_words", SplitWords)
    t(s, d, "nation").createOrReplaceTempView("lamina_nation")
    return s.sql("SELECT n_nationkey, w.word FROM lamina_nation, LATERAL split_words(n_name) w")
