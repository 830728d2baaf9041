"""Transactions and versioned tables on Parquet.

A table is a folder of immutable files and a manifest that names them: row versions (``base``, with
created_txn and a statement number), tombstones (key, txn, statement) and cell changes. A commit
writes its files first, then publishes a new manifest by rename; readers take one manifest and see
nothing that comes later. Transaction ids and commit numbers are drawn from one counter, so a
snapshot is a number that compares with both.

Cell changes lie in ``staged`` until their transaction has committed and are then renamed into
``change``, the folder that streams read; an engine that opens finishes or drops what a crash left.
A transaction can't commit if another that committed after its begin wrote what it read or wrote:
the keys that a transaction wrote are part of its log entry.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import ConflictError, DuplicateKeyError, HistoryUnavailableError, InvalidParameterError, KeyNotFoundError
from lamina.functions import predicate
from lamina.functions.visibility import BROADCAST_ROWS, committed
from lamina.sources.files import Store

TRACKED_KEYS = 10_000  # beyond so many keys a transaction counts as using the whole table
ISOLATION = ("snapshot", "repeatable_read", "read_committed")
LOG_SCHEMA = "txn_id long, status string, commit_seq long"
_SCAN_CALL = re.compile(r"\bversioned_scan\(\s*'(?P<table>\w+)'\s*(?:,\s*'(?P<where>(?:[^']|'')*)'\s*)?\)", re.IGNORECASE)
CHANGE_SCHEMA = "txn_id long, stmt int, pk string, col string, op string, before_v string, after_v string"


@dataclass
class Transaction:
    """A transaction that is open; keys are tracked for conflict checks."""

    txn_id: int
    begin_seq: int
    reads: set[tuple[str, str]] = field(default_factory=set)
    writes: set[tuple[str, str]] = field(default_factory=set)
    files: list[tuple[str, dict]] = field(default_factory=list)
    statements: int = 0
    status: str = "active"
    isolation: str = "snapshot"

    def record_read(self, table: str, *keys) -> None:
        self.reads |= {(table, str(k)) for k in keys}

    def record_write(self, table: str, *keys) -> None:
        self.writes |= {(table, str(k)) for k in keys}


def _meet(a: set[tuple[str, str]], b: set[tuple[str, str]]) -> tuple[str, str] | None:
    """A key in both sets; ``*`` stands for every key of its table."""
    if hit := a & b:
        return min(hit)
    for x, y in ((a, b), (b, a)):
        whole = {t for t, k in x if k == "*"}
        if hit := [p for p in y if p[0] in whole]:
            return min(hit)
    return None


def conflicts(txn: Transaction, others: list[Transaction], committed: dict[int, set[tuple[str, str]]] | None = None) -> str | None:
    """Why a transaction can't commit: it read what active ones write, or wrote what they read or write, or
    one that committed since it began (``committed``: what they wrote) wrote what it read or wrote."""
    for i, writes in (committed or {}).items():
        if i != txn.txn_id and (hit := _meet(txn.reads | txn.writes, writes)):
            return f"used {hit} that transaction {i} wrote meanwhile"
    for o in others:
        if o is txn or o.status != "active":
            continue
        if hit := _meet(txn.reads, o.writes):
            return f"read {hit} that transaction {o.txn_id} writes"
        if hit := _meet(txn.writes, o.reads | o.writes):
            return f"wrote {hit} that transaction {o.txn_id} uses"
    return None


def audit(keys: DataFrame, lifetimes: DataFrame, *, bucket: int = 16) -> DataFrame:
    """Pairs (first, second, key) of transactions whose lifetimes overlap and that use a key, at least one of them writing.

    ``keys``: (txn_id, key, mode); ``lifetimes``: (txn_id, begin_seq, end_seq). A transaction uses a
    key once, however often. Of two that overlap one begins while the other lives, so lifetimes meet
    begins by key and bucket of time: a hot key is spread over its buckets, and transactions that
    are apart in time never meet.
    """
    from lamina.operators.joins import range_join

    k = keys.groupBy("txn_id", "key").agg(F.bool_or(F.col("mode") == "w").alias("w")).join(lifetimes, "txn_id")
    begins = k.select("key", F.col("txn_id").alias("b"), F.col("w").alias("bw"), F.col("begin_seq").alias("at"))
    lives = k.select(F.col("key").alias("a_key"), F.col("txn_id").alias("a"), F.col("w").alias("aw"), F.col("begin_seq").alias("lo"), (F.col("end_seq") + 1).alias("hi"))
    met = range_join(begins, lives, point="at", low="lo", high="hi", bucket=bucket, by=[("key", "a_key")])
    met = met.where("a <> b and (aw or bw) and (lo < at or a < b)")  # of two that begin together, once
    return met.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "key")


class Engine:
    """Tables under one folder. One engine writes at a time; any number read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.active: dict[int, Transaction] = {}
        found = [self.store.read_json(f"_txn/{n}") for n in self.store.names("_txn") if n.endswith(".json")]
        done = [d for f in found for d in f.get("log", [f])]
        self.finished: dict[int, tuple[str, int | None]] = {}
        self.wrote: dict[int, set[tuple[str, str]]] = {}  # of committed transactions, for those that began before
        self._read = set(self.store.names("_txn"))
        for d in done:
            self._note(d)
        self.counter = max([0, *(f.get("counter", 0) for f in found), *self.finished, *(s or 0 for _, s in self.finished.values())])

        for name in self.tables():
            self._expose(name)

    # transactions

    def _note(self, entry: dict) -> None:
        self.finished[entry["txn_id"]] = (entry["status"], entry["commit_seq"])
        if entry.get("wrote"):
            self.wrote[entry["txn_id"]] = {tuple(w) for w in entry["wrote"]}

    def _refresh(self) -> None:
        """Log entries that other engines have written since."""
        for name in self.store.names("_txn"):
            if name.endswith(".json") and name not in self._read:
                self._read.add(name)
                found = self.store.read_json(f"_txn/{name}")
                for d in found.get("log", [found]):
                    self._note(d)
                    self.counter = max(self.counter, d["txn_id"], d["commit_seq"] or 0)

    def _expose(self, name: str) -> None:
        """Staged changes of committed transactions go where streams read; those of unknown ones are left of a crash and go."""
        for folder in self.store.names(f"{name}/staged"):
            txn = int(folder[4:16])
            if self.finished.get(txn, ("",))[0] == "committed":
                self.store.rename(f"{name}/staged/{folder}", f"{name}/change/{folder}")
            elif txn not in self.active:
                self.store.remove(f"{name}/staged/{folder}")

    def begin(self, isolation: str = "snapshot") -> Transaction:
        """``read_committed`` statements see what has been committed before each; the others see the start of the transaction."""
        if isolation not in ISOLATION:
            raise InvalidParameterError(f"isolation is one of {', '.join(ISOLATION)}")
        self.counter += 1
        t = self.active[self.counter] = Transaction(self.counter, self.counter, isolation=isolation)
        return t

    def reads_at(self, txn: Transaction) -> int:
        """The snapshot that the transaction's next statement reads."""
        return self.snapshot() if txn.isolation == "read_committed" else txn.begin_seq

    def commit(self, txn: Transaction) -> int:
        """Commit number. Files become visible with the manifest and the log entry, in this order."""
        if txn.txn_id not in self.active:
            raise InvalidParameterError(f"transaction {txn.txn_id} isn't active")
        self._refresh()
        since = {i: w for i, w in self.wrote.items() if self.finished[i][1] > txn.begin_seq}
        if txn.isolation == "read_committed":
            since = {}
        if why := conflicts(txn, list(self.active.values()), since):
            self.rollback(txn)
            raise ConflictError(f"transaction {txn.txn_id} {why}")
        self.counter += 1
        seq = self.counter
        for name in sorted({n for n, _ in txn.files}):
            Table(self, name)._publish([f | {"commit_seq": seq} for n, f in txn.files if n == name])
        self._finish(txn, "committed", seq)
        for name in sorted({n for n, _ in txn.files}):
            self._expose(name)
        return seq

    def rollback(self, txn: Transaction) -> None:
        for name, f in txn.files:
            self.store.remove(f"{name}/{_staged(f)}")
        self._finish(txn, "aborted", None)

    def _finish(self, txn: Transaction, status: str, seq: int | None) -> None:
        entry = {"txn_id": txn.txn_id, "status": status, "commit_seq": seq}
        if status == "committed" and txn.writes:
            entry["wrote"] = sorted(txn.writes)
        if not self.store.write_json(f"_txn/{txn.txn_id:012d}.json", entry):
            raise ConflictError(f"transaction {txn.txn_id} was finished by another writer")
        txn.status = status
        self.active.pop(txn.txn_id, None)
        self._read.add(f"{txn.txn_id:012d}.json")
        self._note(entry)
        oldest = min((t.begin_seq for t in self.active.values()), default=self.counter)
        self.wrote = {i: w for i, w in self.wrote.items() if self.finished[i][1] > oldest}

    def snapshot(self) -> int:
        return self.counter

    def checkpoint(self, keep: int = 100_000) -> int:
        """Fold the log's files into one; returns how many transactions it holds.

        Beyond ``keep`` finished transactions the oldest go until four fifths are left, except those
        whose files a table still has: without its entry a version would vanish.
        """
        if len(self.finished) > keep:
            used = {f["txn_id"] for n in self.tables() for f in self.table(n).manifest["files"]}
            idle = [i for i in sorted(self.finished) if i not in used]
            for i in idle[: len(self.finished) - keep * 4 // 5]:
                del self.finished[i]
        old = [n for n in self.store.names("_txn") if n.endswith(".json")]
        log = [{"txn_id": i, "status": s, "commit_seq": c, "wrote": sorted(self.wrote.get(i, ()))} for i, (s, c) in sorted(self.finished.items())]
        name = f"log-{uuid.uuid4().hex}.json"
        self._read.add(name)
        self.store.write_json(f"_txn/{name}", {"log": log, "counter": self.counter})
        for n in old:
            self.store.remove(f"_txn/{n}")
        return len(log)

    def log(self) -> DataFrame:
        rows = [(i, s, c) for i, (s, c) in self.finished.items()] + [(i, "active", None) for i in self.active]
        return self.spark.createDataFrame(rows, LOG_SCHEMA)

    def seen(self, at: int, id_as: str = "seen_txn") -> DataFrame:
        """Ids of transactions that count at a snapshot; the log's length is known, so that no job counts them."""
        ids = committed(self.log(), at, id_as)
        return F.broadcast(ids) if len(self.finished) <= BROADCAST_ROWS else ids

    def info(self) -> DataFrame:
        """A row for each table."""
        rows = []
        for name in self.tables():
            m = self.table(name).manifest
            rows.append((name, m["version"], len(m["files"]), sum(f["rows"] for f in m["files"] if f["kind"] == "base"), m["horizon"]))
        return self.spark.createDataFrame(rows, "table string, version long, files long, versions long, horizon long")

    # tables

    def create(self, name: str, schema: T.StructType, key: str) -> Table:
        if key not in schema.names:
            raise InvalidParameterError(f"{key} isn't a column of {name}")
        if not self.store.write_json(f"{name}/manifest/v{0:012d}.json", {"key": key, "schema": schema.jsonValue(), "files": [], "horizon": 0}):
            raise InvalidParameterError(f"{name} exists")
        return self.table(name)

    def table(self, name: str) -> Table:
        if not name.replace("_", "").isalnum():
            raise InvalidParameterError(f"not a table name: {name!r}")
        return Table(self, name)

    def tables(self) -> list[str]:
        return [n for n in self.store.names("") if n != "_txn" and self.store.names(f"{n}/manifest")]

    def execute(self, text: str, txn: Transaction | None = None) -> int:
        """INSERT INTO, UPDATE, DELETE FROM or MERGE INTO in SQL, see ``lamina.operators.dml``; commits if no transaction is given.

        Returns the number of rows that the statement wrote.
        """
        from lamina.operators import dml

        own = txn or self.begin()
        try:
            n = dml.execute(self, text, own)
        except Exception:
            if txn is None:
                self.rollback(own)
            raise
        if txn is None:
            self.commit(own)
        return n

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables; ``AS OF TxnId n`` reads all of them at that snapshot.

        ``versioned_scan('table', 'filter')`` in the FROM clause reads a table through the filter language.
        """
        from lamina.operators.timetravel import parse_as_of

        query, at = parse_as_of(text)

        def view(m: re.Match) -> str:
            name = f"versioned_scan_{uuid.uuid4().hex}"
            self.table(m["table"]).scan(m["where"].replace("''", "'") if m["where"] else None, as_of=at).createOrReplaceTempView(name)
            return name

        query = _SCAN_CALL.sub(view, query)
        for name in self.tables():
            self.table(name).scan(as_of=at).createOrReplaceTempView(name)
        return self.spark.sql(query)


def _staged(f: dict) -> str:
    """Where a file group lies before its commit."""
    return f["path"].replace("change/", "staged/", 1) if f["kind"] == "change" else f["path"]


class Table:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.name, self.spark = engine, name, engine.spark

    @property
    def manifest(self) -> dict:
        found = [n for n in self.engine.store.names(f"{self.name}/manifest") if n.endswith(".json")]
        if not found:
            raise InvalidParameterError(f"no table {self.name}")
        return self.engine.store.read_json(f"{self.name}/manifest/{found[-1]}") | {"version": int(found[-1][1:-5])}

    @property
    def key(self) -> str:
        return self.manifest["key"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest["schema"])

    def _publish(self, add: list[dict], drop: tuple[str, ...] = (), **more) -> None:
        m = self.manifest
        version = m.pop("version")
        m["files"] = [f for f in m["files"] if f["path"] not in drop] + add
        if not self.engine.store.write_json(f"{self.name}/manifest/v{version + 1:012d}.json", m | more):
            raise ConflictError(f"{self.name} was changed by another writer")

    def _write(self, df: DataFrame, kind: str, txn: int) -> dict:
        """A file group with the statistics that pruning needs, observed while it is written."""
        path = f"{kind}/txn={txn:012d}-{uuid.uuid4().hex}"
        place = _staged({"kind": kind, "path": path})
        bloom = {f"parquet.bloom.filter.enabled#{self.key}": "true"} if kind == "base" else {}  # for reads by key
        plain = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))] if kind == "base" else []
        ends = [g(F.col(c)).alias(f"{c}:{end}") for c in plain for end, g in (("min", F.min), ("max", F.max))]
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *ends).write.options(**bloom).parquet(f"{self.engine.store.root}/{self.name}/{place}")
        got = seen.get
        stats = {c.lower(): (got[f"{c}:min"], got[f"{c}:max"]) for c in plain}
        return {"path": path, "kind": kind, "txn_id": txn, "rows": got["rows"], "stats": stats}

    # reads

    def _files(self, kind: str, keep=lambda f: True) -> list[str]:
        return [f"{self.engine.store.root}/{self.name}/{f['path']}" for f in self.manifest["files"] if f["kind"] == kind and keep(f)]

    def versions(self, as_of: int | None = None, where: str | None = None, only: set[str] | None = None) -> DataFrame:
        """Visible row versions with created_txn and stmt. Files whose statistics rule the filter out aren't read."""
        at = self.engine.snapshot() if as_of is None else as_of
        if at < self.manifest["horizon"]:
            raise HistoryUnavailableError(f"{self.name} keeps no history before {self.manifest['horizon']}")
        prune = predicate.pruning(predicate.parse(where)) if where else predicate.Pruning()
        base = self._files("base", lambda f: f["txn_id"] <= at and (only is None or f["path"] in only) and prune.may_hold({k: tuple(v) for k, v in f["stats"].items()}))
        schema = T.StructType([*self.schema.fields, T.StructField("created_txn", T.LongType()), T.StructField("stmt", T.IntegerType())])
        if not base:
            return self.spark.createDataFrame([], schema)
        ids = self.engine.seen(at)
        rows = self.spark.read.schema(schema).parquet(*base).where(F.col("created_txn") <= at)
        if where:
            rows = predicate.apply(rows, where)
        rows = rows.join(ids, F.col("created_txn") == F.col("seen_txn"), "left_semi")
        gone = self._files("tombstone", lambda f: f["txn_id"] <= at)
        if gone:
            dead = self.spark.read.parquet(*gone).join(ids, F.col("gone_txn") == F.col("seen_txn"), "left_semi")
            after = F.struct("gone_txn", "gone_stmt") > F.struct("created_txn", "stmt")
            rows = rows.join(dead, (F.col(self.key) == F.col("gone_key")) & after, "left_anti")
        return rows

    def scan(self, where: str | None = None, *, as_of: int | None = None, columns: list[str] | None = None) -> DataFrame:
        return self.versions(as_of, where).select(*(columns or self.schema.names))

    def scan_bounded(self, segments: int, where: str | None = None) -> tuple[DataFrame, list[str]]:
        """A scan of at most so many base files, and the files it leaves out; nothing is left out unsaid."""
        base = [f["path"] for f in self.manifest["files"] if f["kind"] == "base"]
        keep, skipped = set(base[:segments]), base[segments:]
        return self.versions(None, where, keep).select(*self.schema.names), skipped

    def batches(self, where: str | None = None, *, as_of: int | None = None):
        """Rows one by one, fetched partition by partition."""
        return self.scan(where, as_of=as_of).toLocalIterator()

    def get(self, key, *, as_of: int | None = None) -> dict[str, Any] | None:
        """The row of a key. Files are left out by their minima and maxima, row groups by Parquet's and by the key's Bloom filter."""
        value = f'"{key}"' if isinstance(key, str) else key
        rows = self.scan(f"{self.key} = {value}", as_of=as_of).limit(1).collect()
        return rows[0].asDict() if rows else None

    def get_many(self, keys: DataFrame, *, as_of: int | None = None) -> DataFrame:
        """The rows of many keys (one column): a semi join, whose smaller side Spark broadcasts if it is known to be small."""
        return self.scan(as_of=as_of).join(keys.toDF("asked_key").distinct(), F.col(self.key) == F.col("asked_key"), "left_semi")

    def count(self, *, as_of: int | None = None) -> int:
        return self.versions(as_of).count()

    def manifest_count(self) -> int:
        """Rows in files, from the manifest alone: versions, not visible rows."""
        return sum(f["rows"] for f in self.manifest["files"] if f["kind"] == "base")

    def range_aggregate(self, column: str, low, high, *aggregates: Column, as_of: int | None = None) -> DataFrame:
        return self.scan(as_of=as_of).where(predicate.between(column, low, high)).agg(*aggregates)

    # writes

    def _stage(self, txn: Transaction, df: DataFrame, kind: str) -> None:
        txn.files.append((self.name, self._write(df, kind, txn.txn_id)))

    def _changes(self, txn: Transaction, rows: DataFrame, op: str, images: dict[str, tuple[Column | None, Column | None]]) -> DataFrame:
        """Cells of a statement: for each column its image before and after, both from the same row."""
        text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
        cells = F.array(*(F.struct(F.lit(c).alias("col"), text(b).alias("before_v"), text(a).alias("after_v")) for c, (b, a) in images.items()))
        out = rows.select(F.col(self.key).cast("string").alias("pk"), F.inline(cells))
        return out.select(F.lit(txn.txn_id).cast("long").alias("txn_id"), F.lit(txn.statements).alias("stmt"), "pk", "col", F.lit(op).alias("op"), "before_v", "after_v")

    def insert(self, df: DataFrame, txn: Transaction, *, check_keys: bool = True) -> None:
        """Append rows; columns that ``df`` lacks are null.

        A key that occurs twice, or is visible already, is refused. The check reads the keys of the
        table once; a load that is known to bring new keys can do without.
        """
        txn.statements += 1
        keys = df.select(F.col(self.key).alias("new_key"))
        if check_keys:
            twice = keys.groupBy("new_key").count().where("count > 1").select("new_key")
            there = self.scan(as_of=self.engine.reads_at(txn), columns=[self.key])
            there = keys.join(there, F.col("new_key") == F.col(self.key), "left_semi")
            if bad := [r[0] for r in twice.union(there).limit(5).collect()]:
                raise DuplicateKeyError(f"{self.name} has or would have these keys twice: {', '.join(map(str, bad))}")
        few = [r[0] for r in keys.limit(TRACKED_KEYS + 1).collect()]
        txn.record_write(self.name, *(few if len(few) <= TRACKED_KEYS else ["*"]))
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in df.columns}
        rows = df.withColumns(missing).select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        self._stage(txn, rows.withColumns({"created_txn": F.lit(txn.txn_id).cast("long"), "stmt": F.lit(txn.statements)}), "base")
        self._stage(txn, self._changes(txn, rows, "insert", {c: (None, F.col(c)) for c in rows.columns}), "change")

    def upsert(self, df: DataFrame, txn: Transaction) -> int:
        """Rows of known keys become new versions, others are inserted; returns how many rows there are."""
        df = df.select(*(F.col(c) for c in self.schema.names)).persist()
        try:
            known = self.scan(as_of=self.engine.reads_at(txn), columns=[self.key])
            old = known.join(df.select(F.col(self.key).alias("new_key")), F.col(self.key) == F.col("new_key"), "left_semi").persist()
            if not old.isEmpty():
                there = self.get_many(old.select(self.key), as_of=self.engine.reads_at(txn))
                new = df.select(F.col(self.key).alias("put_key"), *(F.col(c).alias(f"put_{c}") for c in self.schema.names if c != self.key))
                paired = there.join(new, F.col(self.key) == F.col("put_key"))
                self._replace(paired, self.name, {c: F.col(f"put_{c}") for c in self.schema.names if c != self.key}, txn)
            fresh = df.join(old.select(F.col(self.key).alias("old_key")), F.col(self.key) == F.col("old_key"), "left_anti")
            if not fresh.isEmpty():
                self.insert(fresh, txn)
            return df.count()
        finally:
            df.unpersist()

    def _replace(self, old: DataFrame, what: str, new: dict[str, Column], txn: Transaction) -> int:
        """New versions of rows, with some columns replaced."""
        txn.statements += 1
        names = self.schema.names
        old = old.persist()
        try:
            n = self._lock(old, what, txn)
            self._stage(txn, self._tombstones(old, txn), "tombstone")
            rows = old.select(*(new.get(c, F.col(c)).cast(self.schema[c].dataType).alias(c) for c in names))
            self._stage(txn, rows.withColumns({"created_txn": F.lit(txn.txn_id).cast("long"), "stmt": F.lit(txn.statements)}), "base")
            self._stage(txn, self._changes(txn, old, "update", {c: (F.col(c), v.cast(self.schema[c].dataType)) for c, v in new.items()}), "change")
        finally:
            old.unpersist()
        return n

    def update(self, where: str | Column, values: dict[str, Any], txn: Transaction) -> int:
        """New versions of the rows that the filter finds at the transaction's start; returns how many.

        ``where`` is a text of the filter language, which also leaves files out, or a column.
        """
        new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(self.schema[c].dataType) for c, v in values.items()}
        return self._replace(self._found(where, txn), str(where), new, txn)

    def _found(self, where: str | Column, txn: Transaction) -> DataFrame:
        at = self.engine.reads_at(txn)
        return self.scan(where, as_of=at) if isinstance(where, str) else self.scan(as_of=at).where(where)

    def delete(self, where: str | Column, txn: Transaction) -> int:
        txn.statements += 1
        old = self._found(where, txn).persist()
        try:
            n = self._lock(old, str(where), txn)
            self._stage(txn, self._tombstones(old, txn), "tombstone")
            self._stage(txn, self._changes(txn, old, "delete", {c: (F.col(c), None) for c in old.columns}), "change")
        finally:
            old.unpersist()
        return n

    def _lock(self, rows: DataFrame, where: str, txn: Transaction) -> int:
        """Track the keys that a statement writes, up to a bound; returns how many rows there are."""
        n = rows.count()
        if not n:
            raise KeyNotFoundError(where)
        few = n <= TRACKED_KEYS
        keys = [r[0] for r in rows.select(self.key).collect()] if few else ["*"]
        txn.record_write(self.name, *keys)
        txn.record_read(self.name, *keys)
        return n

    def _tombstones(self, rows: DataFrame, txn: Transaction) -> DataFrame:
        # the statement's own versions carry its number and so come after what it removes
        return rows.select(F.col(self.key).alias("gone_key"), F.lit(txn.txn_id).cast("long").alias("gone_txn"), F.lit(txn.statements - 1).alias("gone_stmt"))

    def changes(self) -> DataFrame:
        """All committed cell changes with their commit number."""
        files = self._files("change")
        cells = self.spark.read.schema(CHANGE_SCHEMA).parquet(*files) if files else self.spark.createDataFrame([], CHANGE_SCHEMA)
        log = self.engine.log().where("status = 'committed'").select("txn_id", "commit_seq")
        return cells.join(F.broadcast(log) if len(self.engine.finished) <= BROADCAST_ROWS else log, "txn_id")

    # maintenance

    def compact(self, horizon: int | None = None, *, files: int = 1, by: str | None = None) -> None:
        """Rewrite all versions into ``files`` sorted by key, or by the column that queries filter on, without those that are dead at the horizon.

        Reads at or after the horizon give the same rows as before; earlier ones are refused.
        """
        at = self.engine.snapshot() if horizon is None else horizon
        m = self.manifest
        base = [f for f in m["files"] if f["kind"] == "base"]
        gone = [f for f in m["files"] if f["kind"] == "tombstone"]
        if not base:
            return
        root = f"{self.engine.store.root}/{self.name}"
        rows = self.spark.read.parquet(*(f"{root}/{f['path']}" for f in base))
        ids = self.engine.seen(at)
        if gone:
            dead = self.spark.read.parquet(*(f"{root}/{f['path']}" for f in gone)).join(ids, F.col("gone_txn") == F.col("seen_txn"), "left_semi")
            after = F.struct("gone_txn", "gone_stmt") > F.struct("created_txn", "stmt")
            rows = rows.join(dead, (F.col(self.key) == F.col("gone_key")) & after, "left_anti")
        order = [by, self.key] if by else [self.key]
        new = self._write(rows.repartitionByRange(files, *order).sortWithinPartitions(*order), "base", min(f["txn_id"] for f in base))
        # a tombstone may go if all it could hide was rewritten and its transaction counts at the horizon
        counted = {i for i, (s, c) in self.engine.finished.items() if s == "committed" and c <= at}
        drop = [f["path"] for f in base] + [f["path"] for f in gone if f["txn_id"] in counted]
        self._publish([new], tuple(drop), horizon=max(at, m["horizon"]))

    def segments(self) -> DataFrame:
        """The manifest's base files as rows, for compaction policies."""
        rows = [(f["path"], f["rows"], f["txn_id"]) for f in self.manifest["files"] if f["kind"] == "base"]
        return self.spark.createDataFrame(rows, "segment string, rows long, txn_id long")
