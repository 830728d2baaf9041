"""Cell deltas: last writer wins, and overlay on base rows.

A delta is a DataFrame of cells (pk, col, txn_id, before_v, after_v [, stmt]). A cell whose after
is null either sets null or deletes the row, told apart by ``op``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.visibility import committed, small


def visible_cells(cells: DataFrame, txn_log: DataFrame, snapshot: int) -> DataFrame:
    ids = small(committed(txn_log, snapshot, "seen_txn"))
    return cells.where(F.col("txn_id") <= snapshot).join(ids, F.col("txn_id") == F.col("seen_txn"), "left_semi")


def collapse(cells: DataFrame) -> DataFrame:
    """The newest cell for each (pk, col); statements of one transaction in their order.

    ``max_by`` combines on the map side, so a hot key is one row a task before it is shuffled.
    """
    order = F.struct("txn_id", "stmt") if "stmt" in cells.columns else F.struct("txn_id")
    last = lambda c: F.max_by(c, order).alias(c)
    extra = [c for c in ("op",) if c in cells.columns]
    return cells.groupBy("pk", "col").agg(last("after_v"), *map(last, extra), F.max("txn_id").alias("txn_id"))


def pivot_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row a key: for each column its value and whether there is one at all (has_<column>)."""
    aggs = []
    for c in columns:
        own = F.col("col") == c
        aggs += [F.max(F.when(own, F.col("after_v"))).alias(c), F.coalesce(F.bool_or(own), F.lit(False)).alias(f"has_{c}")]
    return cells.where(F.col("col").isin(columns)).groupBy("pk").agg(*aggs)


def overlay(base: DataFrame, cells: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """Base rows with collapsed cells put over them; a cell that holds null sets null. Keys without base rows are ignored."""
    new = pivot_cells(cells, columns).withColumnsRenamed({c: f"new_{c}" for c in columns})
    joined = base.join(new, base[key] == new["pk"], "left")
    put = lambda c: F.when(F.col(f"has_{c}"), F.col(f"new_{c}").cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return joined.select(*(put(c) if c in columns else F.col(c) for c in base.columns))


def delete_mask(base: DataFrame, deleted: DataFrame, *, key: str) -> DataFrame:
    """Base rows whose key isn't among the deleted ones."""
    return base.join(deleted.select(F.col(deleted.columns[0]).alias("gone")).distinct(), F.col(key) == F.col("gone"), "left_anti")


def replace_column(base: DataFrame, values: DataFrame, *, key: str, column: str) -> DataFrame:
    """A dense patch: the column takes its values from (key, value) pairs, null where there is none."""
    v = values.select(F.col(values.columns[0]).alias("at"), F.col(values.columns[1]).alias("put"))
    out = base.join(v, F.col(key) == F.col("at"), "left")
    return out.select(*(F.col("put").cast(base.schema[c].dataType).alias(c) if c == column else F.col(c) for c in base.columns))


def layers(*parts: DataFrame) -> DataFrame:
    """Cells of all delta layers together; columns that a layer lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flushed(cells: DataFrame, until: int) -> DataFrame:
    """Cells of one layer as the next one holds them: up to a transaction only the newest of each (pk, col), later ones as they are."""
    old = collapse(cells.where(F.col("txn_id") <= until))
    rest = cells.where(F.col("txn_id") > until).select("pk", "col", "after_v", "txn_id")
    return old.select("pk", "col", "after_v", "txn_id").unionByName(rest)


def collected(cells: DataFrame) -> DataFrame:
    """A transaction's cells as one each (txn_id, pk, col): the first image before and the last one after its statements."""
    return cells.groupBy("txn_id", "pk", "col").agg(F.min_by("before_v", "stmt").alias("before_v"), F.max_by("after_v", "stmt").alias("after_v"))


#: Share of rows and numbers of rows that decide how a patch is kept.
SPARSE_SHARE = 0.01
SPARSE_ROWS = 1000
DENSE_ROWS = 1_000_000


def patch_kind(total, affected):
    """sparse or dense, for a patch of ``affected`` of ``total`` rows."""
    few = (affected / total < SPARSE_SHARE) | (affected < SPARSE_ROWS)
    known = (total > 0) & (affected > 0) & (total <= DENSE_ROWS) & (affected < DENSE_ROWS)
    return F.when(known & few, "sparse").otherwise("dense")


#: Recent writes that are looked at, and shares of them that make a column hot or cold.
HEAT_WINDOW = 256
HOT_SHARE = 0.7
COLD_SHARE = 0.1


def column_heat(cells: DataFrame) -> DataFrame:
    """(col, share, heat, flush): a column's share of the newest writes, and the flush policy that follows."""
    recent = cells.select("txn_id", "col", "pk").orderBy(F.col("txn_id").desc(), "pk", "col").limit(HEAT_WINDOW)
    n = recent.groupBy("col").agg(F.count("*").alias("n"))
    total = recent.agg(F.count("*").alias("total"))  # one row
    share = F.col("n") / F.col("total")
    heat = F.when(share > HOT_SHARE, "hot").when(share < COLD_SHARE, "cold").otherwise("warm")
    out = n.crossJoin(F.broadcast(total)).select("col", share.alias("share"), heat.alias("heat"))
    return out.withColumn("flush", F.when(F.col("heat") == "warm", "normal").otherwise(F.col("heat")))


def op_of(before: str = "before_v", after: str = "after_v"):
    """insert, delete or update, by which images there are."""
    return F.when(F.col(before).isNull(), "insert").when(F.col(after).isNull(), "delete").otherwise("update")
