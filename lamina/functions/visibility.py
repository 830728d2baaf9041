"""Snapshot visibility of row versions.

A transaction log has (txn_id, status, commit_seq); ids, snapshots and commit numbers are one
sequence. A version is visible at a snapshot if its creator committed by then and no deleter did:
aborted, active and unknown transactions neither create nor delete anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a log up to which it is broadcast; a longer one is shuffled. A log row is under 40 bytes.
BROADCAST_ROWS = 200_000


def committed(txn_log: DataFrame, snapshot: int, id_as: str) -> DataFrame:
    """Ids of transactions that count at a snapshot."""
    seen = (F.col("status") == "committed") & (F.col("commit_seq") <= snapshot) & (F.col("txn_id") <= snapshot)
    return txn_log.where(seen).select(F.col("txn_id").alias(id_as)).distinct()


def not_active(txn_log: DataFrame, snapshot: int, id_as: str) -> DataFrame:
    """Ids that count where only the active transactions are known and no commit numbers: all others up to the snapshot."""
    seen = (F.col("status") != "active") & (F.col("txn_id") <= snapshot)
    return txn_log.where(seen).select(F.col("txn_id").alias(id_as)).distinct()


def retained(txn_log: DataFrame, *, keep: int, ttl: int, now: int, floor: int) -> DataFrame:
    """Finished transactions that stay in the history: the newest ``keep``, if not older than ``ttl``, and all from ``floor`` on, which replay still needs."""
    done = txn_log.where("commit_seq is not null")
    least = done.orderBy(F.col("commit_seq").desc()).limit(keep).agg(F.min("commit_seq").alias("least"))  # one row
    young = (F.col("commit_seq") >= F.col("least")) & (F.col("commit_seq") >= now - ttl)
    return done.crossJoin(F.broadcast(least)).where(young | (F.col("commit_seq") >= floor)).drop("least")


def alive_at(df: DataFrame, txn_log: DataFrame, horizon: int, *, created: str = "created_txn", deleted: str = "deleted_txn") -> DataFrame:
    """Versions that a compaction keeps: all whose deleter, if any, doesn't count at the horizon, and whose creator wasn't aborted."""
    dead = small(committed(txn_log, horizon, "seen_txn"))
    never = small(txn_log.where("status = 'aborted'").select(F.col("txn_id").alias("never_txn")).distinct())
    out = df.join(dead, F.col(deleted) == F.col("seen_txn"), "left_anti")
    return out.join(never, F.col(created) == F.col("never_txn"), "left_anti")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint, if it has few rows; counts at most ``rows`` + 1 of them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def visible(df: DataFrame, txn_log: DataFrame, snapshot: int, *, created: str = "created_txn", deleted: str = "deleted_txn", keep_versions: bool = False, count=committed) -> DataFrame:
    """Versions of ``df`` that are visible at ``snapshot``; the version columns go unless asked for.

    A semi join on the creator and an anti join on the deleter, both against ids that count.
    Versions from beyond the snapshot are dropped before either, where Parquet statistics help.
    """
    ids = small(count(txn_log, snapshot, "seen_txn"))
    out = df.where(F.col(created) <= snapshot)
    out = out.join(ids, F.col(created) == F.col("seen_txn"), "left_semi")
    out = out.join(ids, F.col(deleted) == F.col("seen_txn"), "left_anti")
    return out if keep_versions else out.drop(created, deleted)


def add_versions(df: DataFrame, txn: int, *, created: str = "created_txn", deleted: str = "deleted_txn") -> DataFrame:
    """``df`` as versions that a transaction creates."""
    return df.withColumns({created: F.lit(txn).cast("long"), deleted: F.lit(None).cast("long")})


def mark_deleted(df: DataFrame, mask: Column, txn: int, *, deleted: str = "deleted_txn") -> DataFrame:
    """Versions under the mask get their deleter; a null mask marks nothing."""
    return df.withColumn(deleted, F.when(mask, F.lit(txn).cast("long")).otherwise(F.col(deleted)))


def row_is_visible(snapshot: int, created: int, deleted: int | None, active: set[int], commits: dict[int, int]) -> bool:
    """The rule for one version, given transactions that are active and commit numbers."""
    counts = lambda t: t not in active and commits.get(t, snapshot + 1) <= snapshot
    return created <= snapshot and counts(created) and not (deleted is not None and counts(deleted))
