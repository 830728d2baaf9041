"""Reads as of a transaction: the clause in SQL text, and reads of versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.errors import HistoryUnavailableError, TimeTravelSyntaxError
from lamina.functions.visibility import visible

_CLAUSE = re.compile(r"\bAS\s+OF\s+TXNID\s*(?P<id>0[xX][0-9A-Fa-f]+|\d+)?(?P<rest>\w*)", re.IGNORECASE)
_GLUED = re.compile(r"\w(?=AS\s+OF\s+TXNID)", re.IGNORECASE)


def parse_as_of(sql: str) -> tuple[str, int | None]:
    """The text without its ``AS OF TxnId n`` clause, and n (decimal or 0x hexadecimal), or None."""
    if _GLUED.search(sql):
        raise TimeTravelSyntaxError("AS OF must stand apart from what comes before")
    found = list(_CLAUSE.finditer(sql))
    if not found:
        return sql, None
    if len(found) > 1:
        raise TimeTravelSyntaxError("only one AS OF clause can be given")
    m = found[0]
    if m["id"] is None:
        raise TimeTravelSyntaxError("AS OF TxnId needs a transaction id")
    if m["rest"]:
        raise TimeTravelSyntaxError(f"unexpected {m['rest']!r} after the transaction id")
    return (sql[: m.start()].rstrip() + " " + sql[m.end() :].lstrip()).strip(), int(m["id"], 0)


def scan_as_of(versions: DataFrame, txn_log: DataFrame | None, txn: int, where: str | None = None) -> DataFrame:
    """Rows visible at a transaction. Without commit history there is no answer, and that is an error."""
    from lamina.functions.predicate import apply

    if txn_log is None:
        raise HistoryUnavailableError("the transaction log is missing")
    return apply(visible(versions, txn_log, txn), where)


def version_index(versions: DataFrame, key: str, *, created: str = "created_txn") -> DataFrame:
    """(key, created, until): from which transaction on a version is the newest of its key, and up to which."""
    later = F.lead(created).over(Window.partitionBy(key).orderBy(created))
    return versions.select(key, F.col(created), later.alias("until"))


def point_as_of(versions: DataFrame, txn_log: DataFrame, txn: int, key: str, value) -> DataFrame:
    """The newest version of one key visible at a transaction; the key is looked for before anything else is done."""
    return get_as_of(versions.where(F.col(key) == F.lit(value)), txn_log, txn, key)


def get_as_of(versions: DataFrame, txn_log: DataFrame, txn: int, key: str) -> DataFrame:
    """For each key the newest version visible at a transaction."""
    seen = visible(versions, txn_log, txn, keep_versions=True)
    rest = [c for c in seen.columns if c not in (key, "deleted_txn")]
    newest = F.max_by(F.struct(*rest), "created_txn").alias("v")
    return seen.groupBy(key).agg(newest).select(key, "v.*")
