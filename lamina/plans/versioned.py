"""Snapshot reads, delta overlay, time travel and change feeds on the derived fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import merge as M
from lamina.functions import policy as PO
from lamina.functions import predicate
from lamina.functions.visibility import add_versions, mark_deleted, retained, visible
from lamina.operators import changes as C
from lamina.operators import engine as E
from lamina.operators import timetravel as TT
from lamina.plans.fixtures import CTE, SNAPSHOT, orders_delta, orders_v, seen, txn_log, visible_sql
from lamina.plans.registry import query, table

ROW = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(f"{CTE} SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ({visible_sql(SNAPSHOT)}) WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def visible_orders(spark, sf_dir):
    """Flagship: visible orders at a snapshot above a price, by status."""
    v = predicate.apply(visible(orders_v(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT), "o_totalprice > 100000")
    return v.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"{CTE} {visible_sql(SNAPSHOT, ROW)}")
def scan_visible(spark, sf_dir):
    return visible(orders_v(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT)


@query(f"{CTE} {visible_sql(30, ROW)} AND o_orderstatus = 'O'")
def scan_as_of(spark, sf_dir):
    return TT.scan_as_of(orders_v(spark, sf_dir), txn_log(spark, sf_dir), 30, 'o_orderstatus = "O"')


@query(f"{CTE} SELECT count(*) AS n FROM ({visible_sql(SNAPSHOT)})")
def count_visible(spark, sf_dir):
    return visible(orders_v(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT).agg(F.count("*").alias("n"))


@query(f"{CTE} SELECT round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM ({visible_sql(SNAPSHOT)}) WHERE o_orderkey BETWEEN 100 AND 5000")
def range_aggregate(spark, sf_dir):
    v = visible(orders_v(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT).where(predicate.between("o_orderkey", 100, 5000))
    return v.agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT o_orderkey, CAST(42 AS BIGINT) AS created_txn, CASE WHEN o_orderstatus = 'F' THEN CAST(50 AS BIGINT) END AS deleted_txn FROM orders")
def version_columns(spark, sf_dir):
    v = add_versions(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 42)
    return mark_deleted(v, F.col("o_orderstatus") == "F", 50).drop("o_orderstatus")


@query(f"{CTE} SELECT status, count(*) AS n, max(commit_seq) AS last FROM txn_log GROUP BY status")
def txn_summary(spark, sf_dir):
    return txn_log(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.max("commit_seq").alias("last"))


_NEWEST = "SELECT min(commit_seq) FROM (SELECT commit_seq FROM txn_log WHERE commit_seq IS NOT NULL ORDER BY commit_seq DESC LIMIT 40)"


@query(f"{CTE} SELECT txn_id, commit_seq FROM txn_log WHERE commit_seq >= ({_NEWEST}) AND commit_seq >= 100 OR commit_seq >= 95")
def history_retention(spark, sf_dir):
    """By number, by age, and never what replay still needs."""
    return retained(txn_log(spark, sf_dir), keep=40, ttl=20, now=120, floor=95).select("txn_id", "commit_seq")


_KEYS = "SELECT o_orderkey % 40 + 1 AS txn_id, CAST(o_custkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'w' ELSE 'r' END AS mode FROM orders"


@query(f"WITH k AS (SELECT *, txn_id AS b, txn_id + 3 AS e FROM ({_KEYS})) SELECT DISTINCT x.txn_id AS first, y.txn_id AS second, x.key FROM k x JOIN k y ON x.key = y.key AND x.txn_id < y.txn_id AND x.b <= y.e AND y.b <= x.e AND (x.mode = 'w' OR y.mode = 'w')")
def conflict_audit(spark, sf_dir):
    mode = F.when(F.col("o_orderkey") % 3 == 0, "w").otherwise("r")
    k = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40 + 1).alias("txn_id"), F.col("o_custkey").cast("string").alias("key"), mode.alias("mode"))
    lives = k.select("txn_id").distinct().select("txn_id", F.col("txn_id").alias("begin_seq"), (F.col("txn_id") + 3).alias("end_seq"))
    return E.audit(k, lives)


_CELLS = f"SELECT * FROM orders_delta WHERE txn_id IN ({seen(SNAPSHOT)})"
_LWW = f"SELECT pk, col, arg_max(struct_pack(v := after_v), txn_id).v AS after_v, max(txn_id) AS txn_id FROM ({_CELLS}) GROUP BY pk, col"


@query(f"{CTE} {_LWW}")
def last_writer_wins(spark, sf_dir):
    return M.collapse(M.visible_cells(orders_delta(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT))


@query(f"{CTE}, newest AS ({_LWW}) SELECT o.o_orderkey, CASE WHEN d.pk IS NOT NULL THEN d.after_v ELSE o.o_totalprice END AS o_totalprice, o_orderstatus FROM ({visible_sql(SNAPSHOT)}) o LEFT JOIN newest d ON o.o_orderkey = d.pk")
def overlay(spark, sf_dir):
    base = visible(orders_v(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT).select("o_orderkey", "o_totalprice", "o_orderstatus")
    cells = M.collapse(M.visible_cells(orders_delta(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT))
    return M.overlay(base, cells, key="o_orderkey", columns=["o_totalprice"])


@query(f"{CTE} SELECT pk, after_v AS o_totalprice FROM ({_LWW})")
def delta_only_rows(spark, sf_dir):
    cells = M.collapse(M.visible_cells(orders_delta(spark, sf_dir), txn_log(spark, sf_dir), SNAPSHOT))
    return M.pivot_cells(cells, ["o_totalprice"]).select("pk", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS o_totalprice FROM orders")
def dense_patch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return M.replace_column(o, o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice") * 2), key="o_orderkey", column="o_totalprice")


@query(f"{CTE} SELECT pk, count(*) AS n FROM (SELECT * FROM orders_delta UNION ALL SELECT * FROM orders_delta WHERE pk % 100 = 0) GROUP BY pk")
def delta_layers(spark, sf_dir):
    d = orders_delta(spark, sf_dir)
    return M.layers(d, d.where("pk % 100 = 0")).groupBy("pk").agg(F.count("*").alias("n"))


@query(f"{CTE} SELECT arg_max(after_v, txn_id) AS after_v, max(txn_id) AS txn_id FROM ({_CELLS}) WHERE pk = 50")
def cell_lookup(spark, sf_dir):
    d = M.visible_cells(orders_delta(spark, sf_dir).where("pk = 50"), txn_log(spark, sf_dir), SNAPSHOT)
    return d.agg(F.max_by("after_v", "txn_id").alias("after_v"), F.max("txn_id").alias("txn_id"))


@query(f"{CTE} SELECT {ROW} FROM ({visible_sql(SNAPSHOT)}) WHERE o_orderkey = 8")
def point_get(spark, sf_dir):
    return visible(orders_v(spark, sf_dir).where("o_orderkey = 8"), txn_log(spark, sf_dir), SNAPSHOT)


@query(f"{CTE} SELECT {ROW}, created_txn FROM ({visible_sql(60)}) WHERE o_orderkey = 35")
def point_get_as_of(spark, sf_dir):
    """A read by key: the filter on the key reaches the Parquet reader."""
    v = orders_v(spark, sf_dir)
    return TT.point_as_of(v, txn_log(spark, sf_dir), 60, "o_orderkey", 35).select(*ROW.split(", "), "created_txn")


@query(f"{CTE} SELECT o_custkey, arg_max(o_orderkey, created_txn * 1000000 + o_orderkey) AS o_orderkey FROM ({visible_sql(60)}) GROUP BY o_custkey")
def newest_as_of(spark, sf_dir):
    v = orders_v(spark, sf_dir).select("o_custkey", "o_orderkey", (F.col("created_txn") * 1000000 + F.col("o_orderkey")).alias("rank"), "created_txn", "deleted_txn")
    seen_rows = visible(v, txn_log(spark, sf_dir), 60)
    return seen_rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", "rank").alias("o_orderkey"))


@query(f"{CTE} SELECT o_orderpriority, count(*) AS n FROM ({visible_sql(31)}) GROUP BY o_orderpriority")
def as_of_sql(spark, sf_dir):
    text, txn = TT.parse_as_of("SELECT o_orderpriority, count(*) AS n FROM versioned_orders AS OF TxnId 0x1F GROUP BY o_orderpriority")
    TT.scan_as_of(orders_v(spark, sf_dir), txn_log(spark, sf_dir), txn).createOrReplaceTempView("versioned_orders")
    return spark.sql(text)


_OP = "CASE WHEN before_v IS NULL THEN 'insert' WHEN after_v IS NULL THEN 'delete' ELSE 'update' END"
_FEED = f"SELECT *, {_OP} AS op FROM orders_delta WHERE txn_id > 20 AND txn_id IN ({seen(90)})"


def _feed(spark, sf_dir):
    return C.cell_changes(orders_delta(spark, sf_dir), txn_log(spark, sf_dir), 20, 90)


@query(f"{CTE} {_FEED}")
def cdc_cells(spark, sf_dir):
    return _feed(spark, sf_dir)


_CENTS = "coalesce(CAST(CAST(round({} * 100) AS BIGINT) AS VARCHAR), '-')"


@query(f"{CTE} SELECT txn_id, pk, count(*) AS n_cells, string_agg(col || ':' || {_CENTS.format('before_v')} || ':' || {_CENTS.format('after_v')}, ',' ORDER BY col) AS cells FROM ({_FEED}) GROUP BY txn_id, pk")
def cdc_rows(spark, sf_dir):
    cents = lambda x: F.coalesce(F.round(x * 100).cast("long").cast("string"), F.lit("-"))
    cells = F.transform("cells", lambda c: F.concat_ws(":", c["col"], cents(c["before_v"]), cents(c["after_v"])))
    return C.row_changes(_feed(spark, sf_dir)).withColumn("cells", F.array_join(cells, ","))


@query(f"{CTE}, f AS ({_FEED}) SELECT DISTINCT txn_id, 0 AS kind, CAST(NULL AS BIGINT) AS pk, CAST(NULL AS VARCHAR) AS col, 'begin' AS op FROM f UNION ALL SELECT txn_id, 1, pk, col, op FROM f UNION ALL SELECT DISTINCT txn_id, 2, NULL, NULL, 'commit' FROM f")
def cdc_boundaries(spark, sf_dir):
    return C.boundaries(_feed(spark, sf_dir))


@query(f"{CTE} SELECT count(*) AS pending FROM orders_delta WHERE txn_id > 50 AND txn_id IN ({seen(100)})")
def cdc_pending(spark, sf_dir):
    return C.pending(orders_delta(spark, sf_dir), txn_log(spark, sf_dir), 50, 100)


@query(f"{CTE} SELECT d.pk, d.txn_id, t.commit_seq FROM orders_delta d JOIN txn_log t USING (txn_id) WHERE t.status = 'committed' AND t.commit_seq <= 60 AND d.txn_id > 10")
def cdc_at_commit(spark, sf_dir):
    return C.changes_at(orders_delta(spark, sf_dir), txn_log(spark, sf_dir), 10, 60).select("pk", "txn_id", "commit_seq")


@query(f"{CTE}, f AS ({_FEED}) SELECT pk, arg_max(struct_pack(v := after_v), txn_id).v AS after_v, max(txn_id) AS txn_id FROM f GROUP BY pk, col")
def cdc_net(spark, sf_dir):
    return C.net_changes(orders_delta(spark, sf_dir), txn_log(spark, sf_dir), 20, 90).select("pk", "after_v", "txn_id")


@query(f"{CTE} SELECT pk, txn_id, CASE {_OP} WHEN 'insert' THEN 'c' WHEN 'delete' THEN 'd' ELSE 'u' END AS op, before_v AS before, after_v AS after, CAST(txn_id AS VARCHAR) AS key, CASE WHEN pk % 2 = 0 THEN 'even-orders' ELSE 'changes' END AS topic FROM ({_FEED})")
def cdc_envelopes(spark, sf_dir):
    e = C.envelopes(_feed(spark, sf_dir), "t").withColumn("table", F.when(F.col("pk") % 2 == 0, "even").otherwise("odd"))
    e = C.routed(e, {"even": "even-orders"}, "changes")
    image = lambda k: F.get_json_object("value", f"$.{k}.o_totalprice").cast("double").alias(k)
    return e.select("pk", "txn_id", F.get_json_object("value", "$.op").alias("op"), image("before"), image("after"), F.col("key").cast("string").alias("key"), "topic")


@query(f"{CTE} SELECT txn_id, pk, CAST(txn_id AS VARCHAR) AS t, CAST(pk AS VARCHAR) AS p, col, before_v, after_v, op FROM ({_FEED})")
def cdc_json(spark, sf_dir):
    j = C.as_json(_feed(spark, sf_dir))
    part = lambda k: F.get_json_object("json", f"$.{k}")
    images = [part(c).cast("double").alias(c) for c in ("before_v", "after_v")]
    return j.select("txn_id", "pk", part("txn_id").alias("t"), part("pk").alias("p"), part("col").alias("col"), *images, part("op").alias("op"))


@query(f"{CTE}, ops AS (SELECT created_txn AS txn_id, o_orderkey AS pk, o_orderstatus, o_orderpriority FROM orders_v), k AS (SELECT ops.* FROM ops JOIN txn_log t USING (txn_id) WHERE t.status = 'committed' AND txn_id > 30) SELECT txn_id, 'insert' AS op, pk, 'o_orderstatus' AS col, o_orderstatus AS value FROM k UNION ALL SELECT txn_id, 'insert', pk, 'o_orderpriority', o_orderpriority FROM k")
def wal_replay(spark, sf_dir):
    ops = orders_v(spark, sf_dir).select(F.col("created_txn").alias("txn_id"), F.lit(1).alias("stmt"), F.lit("insert").alias("op"), F.col("o_orderkey").alias("pk"), "o_orderstatus", "o_orderpriority")
    return C.replay(ops, txn_log(spark, sf_dir), 30, ["o_orderstatus", "o_orderpriority"]).drop("stmt")


@query("SELECT *, CASE WHEN heat >= 5 THEN 'hot' WHEN heat <= 1 THEN 'cold' ELSE 'warm' END AS kind FROM (SELECT o_custkey, count(*) AS writes, round((1 - power(0.875, count(*))) * 8, 6) AS heat FROM orders GROUP BY o_custkey)")
def write_heat(spark, sf_dir):
    return PO.write_heat(table(spark, sf_dir, "orders"), "o_custkey").withColumn("heat", F.round("heat", 6))
