"""Snapshots, layers, feeds, places in files and the engine's further operators, each on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.errors import ConflictError
from lamina.functions import merge as M
from lamina.functions import predicate
from lamina.functions.visibility import alive_at, not_active, visible
from lamina.operators import changes as C
from lamina.operators import timetravel as TT
from lamina.operators.engine import Engine
from lamina.plans.engine import _customers, _root
from lamina.plans.fixtures import CTE, SNAPSHOT, orders_delta, orders_v, seen, txn_log
from lamina.plans.registry import query, table as t
from lamina.plans.versioned import _FEED, _feed
from lamina.sources import columns as places
from lamina.sources import iceberg
from lamina.sources.export import export, export_schema, read_export, read_stats

# snapshots

_REST = f"SELECT txn_id FROM txn_log WHERE status <> 'active' AND txn_id <= {SNAPSHOT}"


@query(f"{CTE} SELECT o_orderkey, o_totalprice FROM orders_v WHERE created_txn IN ({_REST}) AND (deleted_txn IS NULL OR deleted_txn NOT IN ({_REST}))")
def snapshot_active_only(s, d):
    """Where no commit numbers are known: all that isn't active counts."""
    return visible(orders_v(s, d), txn_log(s, d), SNAPSHOT, count=not_active).select("o_orderkey", "o_totalprice")


@query(f"{CTE} SELECT o_orderkey, created_txn, deleted_txn FROM orders_v WHERE created_txn NOT IN (SELECT txn_id FROM txn_log WHERE status = 'aborted') AND (deleted_txn IS NULL OR deleted_txn NOT IN ({seen(60)}))")
def snapshot_for_compaction(s, d):
    return alive_at(orders_v(s, d), txn_log(s, d), 60).select("o_orderkey", "created_txn", "deleted_txn")


@query("SELECT 'snapshot' AS isolation, 0 AS zeros UNION ALL SELECT 'repeatable_read', 0 UNION ALL SELECT 'read_committed', count(*) FROM customer WHERE c_nationkey = 3")
def isolation_levels(s, d):
    """What each level's second statement reads after another transaction has committed an update."""
    e, c = Engine(s, _root(s)), t(s, d, "customer").where("c_acctbal <> 0")
    k = e.create("customer", c.schema, "c_custkey")
    x = e.begin()
    k.insert(c, x)
    e.commit(x)
    readers = {name: e.begin(name) for name in ("snapshot", "repeatable_read", "read_committed")}
    x = e.begin()
    k.update("c_nationkey = 3", {"c_acctbal": F.lit(0.0)}, x)
    e.commit(x)
    each = [k.scan(as_of=e.reads_at(r)).agg(F.lit(n).alias("isolation"), F.count_if(F.col("c_acctbal") == 0).alias("zeros")) for n, r in readers.items()]
    return each[0].union(each[1]).union(each[2])


# the engine


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 1.0 ELSE c_acctbal END AS c_acctbal, TRUE AS refused FROM customer")
def dml_conflict(s, d):
    """Of two transactions that change the same rows the second to commit is refused, and nothing of it is seen."""
    e, c = Engine(s, _root(s)), t(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    k = e.create("customer", c.schema, "c_custkey")
    x = e.begin()
    k.insert(c, x)
    e.commit(x)
    one, two = e.begin(), e.begin()
    k.update("c_nationkey = 3", {"c_acctbal": F.lit(1.0)}, one)
    e.commit(one)
    k.update("c_nationkey = 3", {"c_acctbal": F.lit(2.0)}, two)
    try:
        e.commit(two)
        refused = False
    except ConflictError:
        refused = True
    return k.scan(columns=["c_custkey", "c_acctbal"]).withColumn("refused", F.lit(refused))


_WRITTEN = """SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL
 UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier"""


@query(f"{_WRITTEN} UNION ALL SELECT 5000000, 'new', 1.5")
def sql_dml(s, d):
    """INSERT, UPDATE, DELETE and MERGE as SQL text."""
    e, c = Engine(s, _root(s)), t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    e.create("customer", c.schema, "c_custkey")
    c.createOrReplaceTempView("customer_rows")
    t(s, d, "supplier").createOrReplaceTempView("supplier_rows")
    e.execute("INSERT INTO customer SELECT * FROM customer_rows")
    e.execute("UPDATE customer SET c_acctbal = c_acctbal * (1 + 1) WHERE c_nationkey = 3")
    e.execute("DELETE FROM customer WHERE c_mktsegment = 'BUILDING'")
    e.execute("INSERT INTO customer (c_custkey, c_name, c_acctbal) VALUES (5000000, 'old', 0.5)")
    e.execute("""MERGE INTO customer USING (SELECT s_suppkey + 1000000 AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal, '-' AS c_mktsegment FROM supplier_rows
        UNION ALL SELECT 5000000, 'new', NULL, 1.5, NULL) s ON customer.c_custkey = s.c_custkey WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *""")
    return e.table("customer").scan(columns=["c_custkey", "c_name", "c_acctbal"])


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
def scan_call(s, d):
    """The scan as a table function in SQL text, with a filter in the filter language."""
    e, _, _ = _customers(s, d)
    return e.sql("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM versioned_scan('customer', 'c_acctbal > 5000')")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 7, 30, 31) AND c_mktsegment <> 'BUILDING'")
def engine_get(s, d):
    """Keyed reads, of keys that are there, deleted or unknown."""
    _, k, _ = _customers(s, d)
    found = [r for i in (1, 7, 30, 31, 999_999_999) if (r := k.get(i))]
    return s.createDataFrame([(r["c_custkey"], r["c_name"]) for r in found], "c_custkey long, c_name string")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND (c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL)")
def engine_get_many(s, d):
    _, k, _ = _customers(s, d)
    return k.get_many(t(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey")).select("c_custkey", "c_name")


def _batches(s, d, n: int = 3):
    """A table of so many base files with ranges of keys of their own."""
    e, c = Engine(s, _root(s)), t(s, d, "customer").select("c_custkey", "c_acctbal")
    k = e.create("customer", c.schema, "c_custkey")
    for i in range(n):
        x = e.begin()
        k.insert(c.where(F.least(F.floor(F.col("c_custkey") / 50), F.lit(n - 1)) == i), x)
        e.commit(x)
    return e, k


@query("SELECT count(*) AS n, 1 AS skipped FROM customer WHERE c_custkey < 100")
def scan_bounded(s, d):
    """At most two of three files; what is left out is reported."""
    _, k = _batches(s, d)
    rows, skipped = k.scan_bounded(2)
    return rows.agg(F.count("*").alias("n"), F.lit(len(skipped)).alias("skipped"))


@query("SELECT count(*) AS n, 1 AS files FROM customer WHERE c_custkey >= 60 AND c_custkey < 90")
def segment_skip(s, d):
    """Files whose minima and maxima rule the filter out are not read."""
    _, k = _batches(s, d)
    rows = k.scan("c_custkey >= 60 AND c_custkey < 90")
    folders = {f.rsplit("/", 2)[-2] for f in rows.inputFiles()}
    return rows.agg(F.count("*").alias("n"), F.lit(len(folders)).alias("files"))


@query("SELECT 'customer' AS \"table\", 3 AS commits, count(*) + count(*) FILTER (c_nationkey = 3) AS versions FROM customer")
def engine_info(s, d):
    e, _, at = _customers(s, d)
    return e.info().select("table", F.lit(len(at)).alias("commits"), "versions")


@query("SELECT count(*) AS n, 4 AS folded FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL")
def engine_checkpoint(s, d):
    """The log folded into one file; an engine that opens afterwards reads the same."""
    e, _, _ = _customers(s, d)
    folded = e.checkpoint()
    return Engine(s, e.store.root).table("customer").scan().agg(F.count("*").alias("n"), F.lit(folded).alias("folded"))


@query("SELECT count(*) AS before, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL) AS after FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL")
def compaction_swap(s, d):
    """A scan that was planned before a compaction and one after it give the same rows."""
    _, k, _ = _customers(s, d)
    planned = k.scan()
    k.compact(files=2)
    return planned.agg(F.count("*").alias("before")).crossJoin(F.broadcast(k.scan().agg(F.count("*").alias("after"))))  # two single rows


# layers of deltas

_OLD = "SELECT pk, col, arg_max(struct_pack(v := after_v), txn_id).v AS after_v, max(txn_id) AS txn_id FROM orders_delta WHERE txn_id <= 70 GROUP BY pk, col"


@query(f"{CTE} {_OLD} UNION ALL SELECT pk, col, after_v, txn_id FROM orders_delta WHERE txn_id > 70")
def layer_flush(s, d):
    return M.flushed(orders_delta(s, d), 70)


@query(f"{CTE} SELECT txn_id, count(*) AS affected, CASE WHEN (SELECT count(*) FROM orders) <= 1000000 AND (count(*) < 1000 OR count(*) < 0.01 * (SELECT count(*) FROM orders)) THEN 'sparse' ELSE 'dense' END AS kind FROM orders_delta GROUP BY txn_id")
def patch_kinds(s, d):
    total = t(s, d, "orders").agg(F.count("*").alias("total"))  # one row
    per = orders_delta(s, d).groupBy("txn_id").agg(F.count("*").alias("affected")).crossJoin(F.broadcast(total))
    return per.select("txn_id", "affected", M.patch_kind(F.col("total"), F.col("affected")).alias("kind"))


@query(f"{CTE} SELECT pk % 8 AS patch, min(txn_id) AS least, max(txn_id) AS most, count(*) AS n FROM orders_delta GROUP BY 1 HAVING max(txn_id) > 100 AND min(txn_id) <= 110")
def patch_ranges(s, d):
    """Patches that may hold cells of transactions 101 to 110, by their least and greatest."""
    per = orders_delta(s, d).groupBy((F.col("pk") % 8).alias("patch")).agg(F.min("txn_id").alias("least"), F.max("txn_id").alias("most"), F.count("*").alias("n"))
    return per.where("most > 100 AND least <= 110")


_CLASSES = "SELECT l_orderkey AS pk, l_returnflag || l_linestatus AS col, l_orderkey * 10 + l_linenumber AS txn_id FROM lineitem"


@query(f"""WITH n AS (SELECT col FROM ({_CLASSES}) ORDER BY txn_id DESC, pk, col LIMIT 256), x AS (SELECT col, count(*) / 256.0 AS share FROM n GROUP BY col)
 SELECT col, round(share, 6) AS share, CASE WHEN share > 0.7 THEN 'hot' WHEN share < 0.1 THEN 'cold' ELSE 'warm' END AS heat, CASE WHEN share > 0.7 THEN 'hot' WHEN share < 0.1 THEN 'cold' ELSE 'normal' END AS flush FROM x""")
def column_heat(s, d):
    cells = t(s, d, "lineitem").select(F.col("l_orderkey").alias("pk"), F.concat("l_returnflag", "l_linestatus").alias("col"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("txn_id"))
    return M.column_heat(cells).withColumn("share", F.round("share", 6))


# time travel and feeds


@query("SELECT o_custkey, o_orderkey AS created_txn, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS until FROM orders")
def version_index(s, d):
    v = t(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("created_txn"))
    return TT.version_index(v, "o_custkey")


@query(f"{CTE} SELECT kind, count(*) AS n, CAST(sum(n_cells) AS BIGINT) AS cells FROM (SELECT 'cell' AS kind, 1 AS n_cells FROM ({_FEED}) UNION ALL SELECT 'row', count(*) FROM ({_FEED}) GROUP BY txn_id, pk) GROUP BY kind")
def cdc_granularity(s, d):
    return C.feed(_feed(s, d), "both").groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_cells").alias("cells"))


_STEPS = "SELECT l_suppkey AS txn_id, l_orderkey AS pk, l_returnflag AS col, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS stmt, l_quantity AS before_v, l_tax AS after_v FROM lineitem"


@query(f"SELECT txn_id, pk, col, arg_min(before_v, stmt) AS before_v, arg_max(after_v, stmt) AS after_v FROM ({_STEPS}) GROUP BY txn_id, pk, col")
def txn_collector(s, d):
    """The statements of a transaction as one cell for each place."""
    c = F.col
    stmt = F.round(c("l_extendedprice") * 100).cast("long") * 10 + c("l_linenumber")
    steps = t(s, d, "lineitem").select(c("l_suppkey").alias("txn_id"), c("l_orderkey").alias("pk"), c("l_returnflag").alias("col"), stmt.alias("stmt"), c("l_quantity").alias("before_v"), c("l_tax").alias("after_v"))
    return M.collected(steps)


#: events as an operation log: some transactions lack a begin or an end, some have two ends.
_OPS = """SELECT o_custkey AS txn_id, 0 AS seq, 'begin' AS op FROM orders WHERE o_custkey % 11 <> 0 GROUP BY 1 UNION ALL SELECT o_custkey, o_orderkey, 'insert' FROM orders
 UNION ALL SELECT o_custkey, 100000000, 'commit' FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT o_custkey, 100000001, 'rollback' FROM orders WHERE o_custkey % 5 IN (0, 1) AND o_custkey % 7 <> 0 GROUP BY 1"""


@query(f"""WITH x AS (SELECT txn_id, count(*) FILTER (op = 'begin') AS b, count(*) FILTER (op = 'commit') AS c, count(*) FILTER (op = 'rollback') AS r FROM ({_OPS}) GROUP BY 1)
 SELECT txn_id, CASE WHEN c + r > 1 THEN 'ambiguous' WHEN b <> 1 THEN 'corrupt' WHEN c + r = 0 THEN 'open' WHEN c = 1 THEN 'committed' ELSE 'rolled_back' END AS ending FROM x""")
def wal_endings(s, d):
    k = F.col("txn_id")
    o = t(s, d, "orders").select(F.col("o_custkey").alias("txn_id"), F.col("o_orderkey").alias("seq"))
    ids = o.select("txn_id").distinct()
    mark = lambda where, seq, op: ids.where(where).select("txn_id", F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"))
    ops = o.withColumn("op", F.lit("insert")).unionByName(mark(k % 11 != 0, 0, "begin"))
    ops = ops.unionByName(mark(k % 5 != 0, 100_000_000, "commit")).unionByName(mark((k % 5).isin(0, 1) & (k % 7 != 0), 100_000_001, "rollback"))
    return C.endings(ops)


@query(f"""{CTE}, k AS (SELECT created_txn AS txn_id, o_orderkey AS pk, o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'checkpoint' END AS op FROM orders_v)
 SELECT txn_id, op, pk, 'o_orderstatus' AS col, o_orderstatus AS value FROM k JOIN txn_log USING (txn_id) WHERE status = 'committed' AND txn_id > 30 AND op <> 'checkpoint'""")
def wal_operations(s, d):
    """Replay of inserts, updates and deletes; checkpoints and the like carry no cells."""
    m = F.col("o_orderkey") % 4
    op = F.when(m == 0, "insert").when(m == 1, "update").when(m == 2, "delete").otherwise("checkpoint")
    ops = orders_v(s, d).select(F.col("created_txn").alias("txn_id"), F.lit(1).alias("stmt"), op.alias("op"), F.col("o_orderkey").alias("pk"), "o_orderstatus")
    return C.replay(ops, txn_log(s, d), 30, ["o_orderstatus"]).drop("stmt")


# places in files


@query("SELECT o_orderkey, o_totalprice, row_number() OVER () - 1 AS place FROM orders")
def scan_in_order(s, d):
    """Rows with their place in the file, which is the order they were written in, whatever tasks read them."""
    return places.with_place(t(s, d, "orders").select("o_orderkey", "o_totalprice", "_metadata")).select("o_orderkey", "o_totalprice", F.col("row_index").alias("place"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER () - 1 AS place FROM orders) WHERE place IN (0, 17, 1000)")
def row_at(s, d):
    return places.row_at(t(s, d, "orders").select("o_orderkey", "o_custkey", "_metadata"), 0, 17, 1000).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name, p_size FROM part")
def columns_reassembled(s, d):
    path = f"{d}/part.parquet"
    return places.reassembled(s, {path: ["p_partkey", "p_name"], f"{d}/./part.parquet": ["p_size"]})


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def arrow_ipc(s, d):
    part = t(s, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return places.from_ipc(places.to_ipc(part), part.schema)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 3")
def scan_pushed(s, d):
    """Filters and columns reach the Parquet reader; ``tests`` read them off the plan."""
    return t(s, d, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01 00:00:00' and l_quantity < 3").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND NOT (o_custkey % 3 = 0)")
def filter_bool(s, d):
    o = t(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("even"), (F.col("o_custkey") % 3 == 0).alias("third"))
    return predicate.apply(o, "even = true AND third != true").select("o_orderkey")


# export


@query("SELECT p_partkey, p_size, 2 AS tracks FROM part")
def export_two_formats(s, d):
    """Each row is in both formats of the version."""
    root = _root(s)
    export(t(s, d, "part").select("p_partkey", "p_size"), root, second="orc")
    both = read_export(s, root).unionByName(read_export(s, root, second=True))
    return both.groupBy("p_partkey", "p_size").agg(F.count("*").cast("int").alias("tracks"))


@query("""SELECT 'o_orderkey' AS "column", count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS nulls, 0 AS nans, CAST(min(o_orderkey) AS DOUBLE) AS lower, CAST(max(o_orderkey) AS DOUBLE) AS upper FROM orders
 UNION ALL SELECT 'o_totalprice', count(*), count(*) FILTER (o_totalprice IS NULL), count(*) FILTER (isnan(o_totalprice)), min(o_totalprice), max(o_totalprice) FROM orders""")
def export_statistics(s, d):
    root = _root(s)
    export(t(s, d, "orders").select("o_orderkey", "o_totalprice"), root)
    least, most = F.min(F.col("lower").cast("double")), F.max(F.col("upper").cast("double"))
    return read_stats(s, root).groupBy("column").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("nans").alias("nans"), least.alias("lower"), most.alias("upper"))


@query("SELECT 1 AS version, count(*) AS n FROM part UNION ALL SELECT 2, count(*) FROM part WHERE p_size > 25")
def export_versions(s, d):
    """Publication: both versions can be read, the newest is the default."""
    root, part = _root(s), t(s, d, "part").select("p_partkey", "p_size")
    first, second = export(part, root), export(part.where("p_size > 25"), root)
    count = lambda df, v: df.agg(F.lit(v).alias("version"), F.count("*").alias("n"))
    return count(read_export(s, root, first), first).union(count(read_export(s, root), second))


@query("SELECT p_partkey, p_name, p_size, 1 AS snapshot FROM part UNION ALL SELECT p_partkey, p_name, p_size, 2 FROM part WHERE p_size > 25")
def export_iceberg(s, d):
    """Both snapshots of a table, found through its Iceberg metadata alone."""
    root, part = _root(s), t(s, d, "part").select("p_partkey", "p_name", "p_size")
    export(part, root)
    first = iceberg.publish(s, root)
    export(part.where("p_size > 25"), root)
    iceberg.publish(s, root)
    return iceberg.read(s, root, first).withColumn("snapshot", F.lit(1)).union(iceberg.read(s, root).withColumn("snapshot", F.lit(2)))


@query("SELECT ordinal_position AS id, column_name AS name FROM information_schema.columns WHERE table_name = 'part'")
def export_fields(s, d):
    return s.createDataFrame([(f["id"], f["name"]) for f in export_schema(t(s, d, "part").schema)], "id int, name string")
