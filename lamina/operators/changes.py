"""Change feeds over cells (pk, col, txn_id, before_v, after_v) and a transaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.errors import InvalidParameterError
from lamina.functions.merge import collapse, op_of, visible_cells


def cell_changes(cells: DataFrame, txn_log: DataFrame, since: int, until: int) -> DataFrame:
    """Cells of transactions after ``since`` that count at ``until``, with what they do. Order by (txn_id, pk, col) to replay."""
    return visible_cells(cells.where(F.col("txn_id") > since), txn_log, until).withColumn("op", op_of())


def net_changes(cells: DataFrame, txn_log: DataFrame, since: int, until: int) -> DataFrame:
    """The last change of each cell in the range."""
    return collapse(cell_changes(cells, txn_log, since, until))


def row_changes(changes: DataFrame) -> DataFrame:
    """One row for each transaction and key, its cells in order of column."""
    cell = F.struct("col", "before_v", "after_v")
    return changes.groupBy("txn_id", "pk").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.count("*").alias("n_cells"))


GRANULARITY = ("cell", "row", "both")


def feed(changes: DataFrame, granularity: str = "cell") -> DataFrame:
    """(txn_id, pk, kind, n_cells) of cell changes as cells, as rows, or as both, told apart by ``kind``."""
    if granularity not in GRANULARITY:
        raise InvalidParameterError(f"granularity is one of {', '.join(GRANULARITY)}")
    cells = changes.select("txn_id", "pk", F.lit("cell").alias("kind"), F.lit(1).cast("long").alias("n_cells"))
    rows = changes.groupBy("txn_id", "pk").agg(F.count("*").alias("n_cells")).select("txn_id", "pk", F.lit("row").alias("kind"), "n_cells")
    return {"cell": lambda: cells, "row": lambda: rows, "both": lambda: cells.unionByName(rows)}[granularity]()


def endings(ops: DataFrame) -> DataFrame:
    """(txn_id, ending) of an operation log with begin, commit, rollback and row operations.

    committed; rolled_back; open (no end: dropped at replay); ambiguous (more than one end);
    corrupt (operations or an end without a begin, or after the end).
    """
    has = lambda op: F.count_if(F.col("op") == op)
    end = F.col("op").isin("commit", "rollback")
    per = ops.groupBy("txn_id").agg(
        has("begin").alias("begins"), has("commit").alias("commits"), has("rollback").alias("rollbacks"),
        F.min(F.when(F.col("op") == "begin", F.col("seq"))).alias("first"), F.min("seq").alias("least"), F.max("seq").alias("last"), F.max(F.when(end, F.col("seq"))).alias("ended"),
    )
    corrupt = (F.col("begins") != 1) | (F.col("first") > F.col("least")) | (F.col("ended") < F.col("last"))
    ends = F.col("commits") + F.col("rollbacks")
    ending = F.when(ends > 1, "ambiguous").when(corrupt, "corrupt").when(ends == 0, "open").when(F.col("commits") == 1, "committed").otherwise("rolled_back")
    return per.select("txn_id", ending.alias("ending"))


def boundaries(changes: DataFrame) -> DataFrame:
    """(txn_id, kind, pk, col, op): begin 0, cells 1, commit 2 of each transaction."""
    ends = changes.select("txn_id").distinct()
    kinds = F.explode(F.array(F.lit(0), F.lit(2))).alias("kind")
    ends = ends.select("txn_id", kinds).selectExpr("txn_id", "kind", "cast(null as bigint) as pk", "cast(null as string) as col", "case kind when 0 then 'begin' else 'commit' end as op")
    return ends.unionByName(changes.select("txn_id", F.lit(1).alias("kind"), F.col("pk").cast("long"), "col", "op"))


def pending(cells: DataFrame, txn_log: DataFrame, since: int, until: int) -> DataFrame:
    return visible_cells(cells.where(F.col("txn_id") > since), txn_log, until).agg(F.count("*").alias("pending"))


def changes_at(cells: DataFrame, txn_log: DataFrame, since: int, commit: int) -> DataFrame:
    """Cells after ``since`` whose transaction had committed by a commit number, first image of each row."""
    log = txn_log.where((F.col("status") == "committed") & (F.col("commit_seq") <= commit)).select("txn_id", "commit_seq")
    return cells.where(F.col("txn_id") > since).join(log, "txn_id")


def as_json(changes: DataFrame) -> DataFrame:
    return changes.select("txn_id", "pk", F.to_json(F.struct(*changes.columns)).alias("json"))


def envelopes(changes: DataFrame, table: str, ts_ms: int = 0) -> DataFrame:
    """Debezium-shaped messages: op c, u or d with before and after images by column."""
    code = F.create_map(*(F.lit(x) for pair in (("insert", "c"), ("update", "u"), ("delete", "d")) for x in pair))[F.col("op")]
    image = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.col("col"), F.col(c).cast("string")))
    body = F.struct(code.alias("op"), F.lit(ts_ms).cast("long").alias("ts_ms"), image("before_v").alias("before"), image("after_v").alias("after"))
    return changes.select(F.lit(table).alias("table"), "txn_id", "pk", F.col("txn_id").cast("string").cast("binary").alias("key"), F.to_json(body).alias("value"))


def routed(messages: DataFrame, topics: dict[str, str], default: str) -> DataFrame:
    """Messages with the topic of their table, or the default one."""
    known = F.create_map(*(F.lit(x) for pair in topics.items() for x in pair)) if topics else F.create_map().cast("map<string,string>")
    return messages.withColumn("topic", F.coalesce(known[F.col("table")], F.lit(default)))


def replay(ops: DataFrame, txn_log: DataFrame, since: int, columns: list[str]) -> DataFrame:
    """Cells rebuilt from a row-level operation log (txn_id, stmt, op, pk, columns...): committed only, every column."""
    done = txn_log.where("status = 'committed'").select("txn_id", "commit_seq")
    kept = ops.where((F.col("txn_id") > since) & F.col("op").isin("insert", "update", "delete")).join(done, "txn_id")
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns))
    return kept.select("txn_id", "stmt", "op", "pk", F.inline(pairs))
