import random

import pytest
from pyspark.sql import functions as F

from lamina.errors import ConflictError, DuplicateKeyError, HistoryUnavailableError, InvalidParameterError, KeyNotFoundError, QueryError, TimeTravelSyntaxError
from lamina.functions import merge as M
from lamina.functions.visibility import row_is_visible, visible
from lamina.operators import changes as C
from lamina.operators import timetravel as TT
from lamina.operators.engine import Engine
from lamina.plans.streams import drain
from lamina.sources.shared import shared_folder
from lamina.streaming import feeds

#: snapshot, created, deleted, active, commits, visible
TRUTH = [
    (10, 11, None, set(), {11: 11}, False), (10, 8, None, {8}, {8: 8}, False), (10, 8, None, set(), {}, False),
    (10, 8, None, set(), {8: 12}, False), (10, 8, None, set(), {8: 8}, True), (10, 8, 9, set(), {8: 8, 9: 9}, False),
    (10, 8, 9, {9}, {8: 8}, True), (10, 8, 12, set(), {8: 8, 12: 12}, True), (10, 8, 9, set(), {8: 8}, True), (2, 1, None, set(), {}, False),
]


@pytest.mark.parametrize("case", TRUTH)
def test_visibility_of_a_row(case):
    assert row_is_visible(*case[:5]) is case[5]


def test_visibility_of_tables(spark):
    for snapshot, created, deleted, active, commits, want in TRUTH:
        rows = [(t, "active", None) for t in active] + [(t, "committed", c) for t, c in commits.items() if t not in active]
        log = spark.createDataFrame(rows, "txn_id long, status string, commit_seq long")
        df = spark.createDataFrame([(1, created, deleted)], "k int, created_txn long, deleted_txn long")
        assert visible(df, log, snapshot).count() == int(want)


def test_collapse_is_a_fold(spark):
    r = random.Random(1)
    cells = [(r.randrange(5), r.choice("ab"), t, s, None, None if r.random() < 0.2 else float(r.randrange(100))) for t in range(1, 30) for s in range(r.randrange(3))]
    df = spark.createDataFrame(cells, "pk int, col string, txn_id long, stmt int, before_v double, after_v double")
    want = {}
    for pk, col, t, s, _, a in sorted(cells, key=lambda c: (c[2], c[3])):
        want[pk, col] = (a, t)
    assert {(x.pk, x.col): (x.after_v, x.txn_id) for x in M.collapse(df).collect()} == want


def test_overlay_tells_null_from_absent(spark):
    base = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k int, v double")
    cells = spark.createDataFrame([(1, "v", 5, None, None), (2, "v", 5, None, 99.0), (9, "v", 5, None, 1.0)], "pk int, col string, txn_id long, before_v double, after_v double")
    assert sorted(map(tuple, M.overlay(base, cells, key="k", columns=["v"]).collect())) == [(1, None), (2, 99.0), (3, 30.0)]


def test_change_feed(spark):
    log = spark.createDataFrame([(1, "committed", 2), (3, "aborted", None), (4, "active", None), (5, "committed", 6)], "txn_id long, status string, commit_seq long")
    cells = spark.createDataFrame([(1 << 40, "a", 1, None, "x"), (2, "a", 3, "x", "y"), (3, "b", 4, "x", "y"), (4, "a", 5, "x", None), (4, "b", 5, "x", "y")], "pk long, col string, txn_id long, before_v string, after_v string")
    feed = C.cell_changes(cells, log, 0, 10)
    assert sorted((r.pk, r.col, r.op) for r in feed.collect()) == [(4, "a", "delete"), (4, "b", "update"), (1 << 40, "a", "insert")]
    assert C.cell_changes(cells, log, 1, 10).count() == 2 and C.cell_changes(cells, log, 0, 5).count() == 1
    assert [(r.txn_id, r.kind) for r in C.boundaries(feed).orderBy("txn_id", "kind", "pk", "col").collect()] == [(1, 0), (1, 1), (1, 2), (5, 0), (5, 1), (5, 1), (5, 2)]
    rows = {(r.txn_id, r.pk): r.n_cells for r in C.row_changes(feed).collect()}
    assert rows == {(1, 1 << 40): 1, (5, 4): 2}


def test_replay_discards_what_was_not_committed(spark):
    log = spark.createDataFrame([(1, "committed", 2), (3, "aborted", None)], "txn_id long, status string, commit_seq long")
    ops = spark.createDataFrame([(1, 1, "insert", 7, 1.5, "F"), (3, 1, "insert", 8, 2.5, "O"), (9, 1, "insert", 9, 2.5, "O"), (1, 2, "commit", None, None, None)], "txn_id long, stmt int, op string, pk long, price double, status string")
    assert sorted((r.pk, r.col, r.value) for r in C.replay(ops, log, 0, ["price", "status"]).collect()) == [(7, "price", "1.5"), (7, "status", "F")]


@pytest.mark.parametrize(("text", "want"), [("SELECT * FROM t AS OF TxnId 12345", ("SELECT * FROM t", 12345)), ("SELECT * FROM t AS OF TxnId12345", ("SELECT * FROM t", 12345)), ("select 1 from t as of txnid 0x1F3A where a = 1", ("select 1 from t where a = 1", 0x1F3A)), ("SELECT 1", ("SELECT 1", None))])
def test_as_of_clause(text, want):
    assert TT.parse_as_of(text) == want


@pytest.mark.parametrize("text", ["SELECT * FROM t AS OF TxnId", "SELECT * FROM tAS OF TxnId 1", "SELECT * FROM t AS OF TxnId 12x", "SELECT * FROM t AS OF TxnId 1 JOIN u AS OF TxnId 2"])
def test_as_of_clause_errors(text):
    with pytest.raises(TimeTravelSyntaxError):
        TT.parse_as_of(text)


def test_history_must_exist(spark):
    with pytest.raises(HistoryUnavailableError):
        TT.scan_as_of(spark.range(1), None, 1)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    t = e.create("t", spark.createDataFrame([], "id long, name string, v double").schema, "id")
    x = e.begin()
    t.insert(spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(10)], "id long, name string, v double"), x)
    e.commit(x)
    return e


def test_engine_life(spark, engine):
    t, s1 = engine.table("t"), engine.snapshot()
    x = engine.begin()
    assert t.update("id >= 8", {"v": F.col("v") + 100}, x) == 2
    assert t.get(9)["v"] == 9.0  # not before the commit
    engine.commit(x)
    s2 = engine.snapshot()
    x = engine.begin()
    t.delete('name = "n0"', x)
    engine.commit(x)
    x = engine.begin()
    t.delete("id > 0", x)
    engine.rollback(x)
    assert t.get(9) == {"id": 9, "name": "n9", "v": 109.0} and t.get(9, as_of=s1)["v"] == 9.0
    assert t.get(0) is None and t.get(0, as_of=s2) is not None and t.get(77) is None
    assert (t.count(), t.count(as_of=s1), t.manifest_count()) == (9, 10, 12)
    assert t.range_aggregate("id", 3, 5, F.sum("v")).first()[0] == 12.0
    assert engine.sql(f"SELECT sum(v) FROM t AS OF TxnId {s1}").first()[0] == 45.0
    x = engine.begin()
    t.insert(spark.createDataFrame([(0,)], "id long"), x)  # a deleted key may come again
    engine.commit(x)
    before = sorted(map(str, t.scan().collect()))
    horizon = engine.snapshot()
    t.compact()
    assert sorted(map(str, t.scan().collect())) == before and t.manifest_count() == 10
    with pytest.raises(HistoryUnavailableError):
        t.count(as_of=s1)
    assert t.count(as_of=horizon) == 10
    again = Engine(spark, engine.store.root)
    assert sorted(map(str, again.table("t").scan().collect())) == before
    assert {r.op: r["count"] for r in t.changes().groupBy("op").count().collect()} == {"insert": 33, "update": 2, "delete": 3}
    assert drain(feeds.change_stream(t, 2)).count() == 8


def test_engine_errors(spark, engine):
    t = engine.table("t")
    x = engine.begin()
    with pytest.raises(KeyNotFoundError):
        t.delete("id = 1000", x)
    with pytest.raises(InvalidParameterError):
        engine.table("../x")
    with pytest.raises(InvalidParameterError):
        engine.create("t", t.schema, "id")
    engine.rollback(x)
    with pytest.raises(InvalidParameterError):
        engine.commit(x)


def test_conflicts(engine):
    a, b = engine.begin(), engine.begin()
    a.record_read("t", 1)
    b.record_write("t", 1)
    with pytest.raises(ConflictError):
        engine.commit(a)
    assert engine.finished[a.txn_id][0] == "aborted"
    engine.commit(b)
    c, d = engine.begin(), engine.begin()
    c.record_write("t", 1)
    d.record_write("t", 2)
    engine.commit(c), engine.commit(d)


def test_files_are_pruned(spark, engine):
    t = engine.table("t")
    x = engine.begin()
    t.insert(spark.createDataFrame([(1000, "z", 1.0)], "id long, name string, v double"), x)
    engine.commit(x)
    assert len(t.scan("id > 500").inputFiles()) < len(t.scan().inputFiles())
    assert t.scan("id > 500").count() == 1


def test_scan_call_and_bounded_scan(spark, engine):
    t = engine.table("t")
    x = engine.begin()
    t.insert(spark.createDataFrame([(50, "it's", 1.0)], "id long, name string, v double"), x)
    engine.commit(x)
    assert engine.sql("SELECT count(*) FROM versioned_scan('t', 'id >= 5 AND id < 50')").first()[0] == 5
    assert engine.sql("SELECT id FROM versioned_scan('t', 'name = \"it''s\"')").first()[0] == 50
    rows, skipped = t.scan_bounded(1)
    assert rows.count() == 10 and len(skipped) == 1


def test_log_checkpoint(spark, engine):
    t = engine.table("t")
    for i in range(6):
        x = engine.begin()
        t.insert(spark.createDataFrame([(100 + i,)], "id long"), x)
        engine.commit(x)
    for _ in range(4):
        engine.rollback(engine.begin())
    assert engine.checkpoint() == 11
    again = Engine(spark, engine.store.root)
    assert again.finished == engine.finished and again.table("t").count() == 16
    t.compact()
    assert engine.checkpoint(keep=4) == 7  # what files refer to stays
    again = Engine(spark, engine.store.root)
    assert again.table("t").count() == 16 and again.table("t").changes().select("txn_id").distinct().count() == 7


def test_large_statements_lock_the_table(engine, monkeypatch):
    from lamina.operators import engine as module

    monkeypatch.setattr(module, "TRACKED_KEYS", 3)
    a, b = engine.begin(), engine.begin()
    engine.table("t").delete("id < 5", a)
    b.record_write("t", 9)
    with pytest.raises(ConflictError):
        engine.commit(a)


def test_command_line(engine, capsys):
    from lamina.__main__ import main

    assert main(["info", engine.store.root]) == 0 and "10 row versions" in capsys.readouterr().out
    assert main([]) == 2


def test_lost_updates_are_refused(spark, engine):
    """Whichever of two transactions commits second is refused: it didn't see what the first has written."""
    t = engine.table("t")
    for first, second in ((0, 1), (1, 0)):
        x = [engine.begin(), engine.begin()]
        t.update("id = 1", {"v": 111.0 + first}, x[first])
        engine.commit(x[first])
        t.update("id = 1", {"v": 222.0}, x[second])
        with pytest.raises(ConflictError):
            engine.commit(x[second])
        assert t.get(1)["v"] == 111.0 + first
    x = engine.begin()
    t.update("id = 1", {"v": 5.0}, x)
    engine.commit(x)
    assert t.get(1)["v"] == 5.0
    a, b = engine.begin(), engine.begin("read_committed")
    t.update("id = 2", {"v": 1.0}, a)
    engine.commit(a)
    t.update("id = 2", {"v": F.col("v") + 1}, b)  # sees what was committed, so nothing is lost
    engine.commit(b)
    assert t.get(2)["v"] == 2.0


def test_another_engine_sees_what_was_written(spark, engine):
    other = Engine(spark, engine.store.root)
    mine, theirs = engine.begin(), other.begin()
    engine.table("t").update("id = 3", {"v": 1.0}, mine)
    engine.commit(mine)
    other.counter += 10
    theirs.txn_id += 10
    other.active = {theirs.txn_id: theirs}
    other.table("t").update("id = 3", {"v": 2.0}, theirs)
    with pytest.raises(ConflictError):
        other.commit(theirs)


def test_open_changes_are_not_streamed(spark, engine):
    t = engine.table("t")
    x = engine.begin()
    t.update("id = 1", {"v": 999.0}, x)
    assert drain(feeds.change_stream(t)).where("after_v = '999.0'").count() == 0
    y = engine.begin()
    t.update("id = 2", {"v": 5.0}, y)
    engine.rollback(x)
    engine.commit(y)
    got = drain(feeds.change_stream(t, 2))
    assert [(r.pk, r.after_v) for r in got.collect()] == [("2", "5.0")] and t.changes().where("op = 'update'").count() == 1


def test_drained_rows_lie_in_the_shared_folder(spark, engine, sf):
    """Rows of a stream, or of a whole result that batches replace, are not collected by the driver."""
    cells = feeds.change_stream(engine.table("t"))
    for stream, mode in ((cells, "append"), (feeds.tumbling(feeds.events(spark, sf), "1 day"), "complete"), (cells.groupBy("op").count(), "complete")):
        got = drain(stream, mode)
        files = got.inputFiles()
        assert files and all(shared_folder(spark).split(":")[-1] in f for f in files) and got.count() > 0 and got.columns == stream.columns
    empty = drain(feeds.change_stream(engine.table("t"), 10**6))
    assert empty.count() == 0 and empty.columns == cells.columns
    engine.create("u", engine.table("t").schema, "id")
    assert drain(feeds.change_stream(engine.table("u"))).count() == 0  # nothing was ever committed


def test_a_crash_leaves_no_changes_behind(spark, engine):
    t = engine.table("t")
    x = engine.begin()
    t.update("id = 1", {"v": 999.0}, x)
    y = engine.begin()
    t.update("id = 2", {"v": 5.0}, y)
    staged = engine.store.names("t/staged")
    engine._expose = lambda name: None  # the engine dies between its log entry and the rename
    engine.active.pop(x.txn_id)
    engine.commit(y)
    assert len(staged) == 2 and engine.store.names("t/staged") == staged
    again = Engine(spark, engine.store.root)
    assert again.store.names("t/staged") == [] and again.table("t").changes().where("op = 'update'").count() == 1


def test_keys_are_unique(spark, engine):
    t, x = engine.table("t"), engine.begin()
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "id long")
    for bad in ((5,), (70, 70)):
        with pytest.raises(DuplicateKeyError):
            t.insert(rows(*bad), x)
    t.insert(rows(70, 71), x)
    engine.commit(x)
    assert t.count() == 12
    a, b = engine.begin(), engine.begin()
    t.insert(rows(80), a)
    engine.commit(a)
    t.insert(rows(80), b)  # not visible to it yet
    with pytest.raises(ConflictError):
        engine.commit(b)


def test_statements_in_sql(spark, engine):
    assert engine.execute("UPDATE t SET v = v + 1, name = 'a, b = c' WHERE id IN (1, 2) AND name LIKE 'n%'") == 2
    assert engine.execute("DELETE FROM t WHERE id > 7;") == 2
    assert engine.execute("INSERT INTO t (id, v) SELECT id + 100, v FROM t WHERE id < 2") == 2
    assert engine.execute("MERGE INTO t USING (SELECT id + 1 AS id, 'm' AS name, 0.0 AS v FROM t WHERE id >= 7) x ON t.id = x.id WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *") == 3
    got = {r.id: (r.name, r.v) for r in engine.table("t").scan().collect()}
    assert got[1] == ("a, b = c", 2.0) and got[100] == (None, 0.0) and got[101] == ("m", 0.0) and got[102] == ("m", 0.0) and got[8] == ("m", 0.0) and len(got) == 12
    for text in ("UPDATE t SET nothing = 1", "SELECT 1", "INSERT INTO t (id) SELECT 1, 2", "MERGE INTO t USING (SELECT 1 AS id) x ON t.v = x.v WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"):
        with pytest.raises(QueryError):
            engine.execute(text)
    assert not engine.active


def test_filters_reach_the_reader(spark, sf):
    from lamina.plans.registry import load

    plan = load()[0]["scan_pushed"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity), GreaterThanOrEqual(l_shipdate" in plan and "l_extendedprice" not in plan


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    from lamina.sources.columns import read_ipc

    table = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    with pa.ipc.new_file(str(tmp_path / "one.arrow"), table.schema) as w:
        w.write_table(table)
    with pa.ipc.new_stream(str(tmp_path / "two.arrow"), table.schema) as w:
        w.write_table(table.slice(1))
    got = read_ipc(spark, str(tmp_path), spark.createDataFrame([], "b string, a long").schema)
    assert sorted(r.a for r in got.collect()) == [1, 2, 2, 3, 3]


def test_hot_keys_are_cut(spark):
    """As-of joins, features and range joins give the same whatever the number of pieces, gaps and ties."""
    from lamina.functions.stats import column_features
    from lamina.operators.joins import asof_join, range_join

    r = random.Random(4)
    left = [(r.choice("ab"), r.randrange(300), i) for i in range(400)]
    right = [(k, t, f"{k}{t}") for k, t in {(r.choice("abc"), r.randrange(300)) for _ in range(60)}]
    a, b = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, w string")
    for pieces in (1, 7, 64):
        got = {x.i: x.w for x in asof_join(a, b, by="k", on="t", take=["w"], pieces=pieces).collect()}
        assert got == {i: max(((u, w) for m, u, w in right if m == k and u <= t), default=(0, None))[1] for k, t, i in left}
    rows = [(r.choice("xy"), i, r.choice([None, 1, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    seen = [sorted(map(str, column_features(df, "v", ["o"], group="g", pieces=p).select("g", "n", "run_avg", "run_max", "sortedness", "null_ratio").collect())) for p in (1, 3, 400)]
    assert seen[0] == seen[1] == seen[2]
    ranges = [(i, s, s + r.choice([0, 1, 3, 50, 2000])) for i, s in enumerate(r.sample(range(-500, 3000), 80))]
    points = [(i, r.randrange(-500, 3000)) for i in range(200)]
    got = range_join(spark.createDataFrame(points, "p int, at int"), spark.createDataFrame(ranges, "r int, lo int, hi int"), point="at", low="lo", high="hi", bucket=4)
    assert sorted((x.p, x.r) for x in got.collect()) == sorted((p, i) for p, at in points for i, lo, hi in ranges if lo <= at < hi)


def test_compaction_by_a_filtered_column(spark, tmp_path):
    """A rewrite in the order of another column reads the same, by key too, and its files hold ranges of that column."""
    e = Engine(spark, str(tmp_path / "db"))
    t = e.create("t", spark.range(1).select("id", F.lit(1).cast("int").alias("g")).schema, "id")
    x = e.begin()
    t.insert(spark.range(400).select("id", F.when(F.col("id") != 7, F.col("id") * 37 % 40).cast("int").alias("g")), x)
    e.commit(x)
    x = e.begin()
    t.delete("g = 5", x)
    e.commit(x)
    want = sorted(map(tuple, t.scan().collect()), key=str)
    t.compact(files=4, by="g")
    assert sorted(map(tuple, t.scan().collect()), key=str) == want
    assert t.get(7)["g"] is None and t.get(8)["g"] == 296 % 40
    files = spark.read.parquet(*t._files("base")).groupBy(F.input_file_name()).agg(F.min("g").alias("lo"), F.max("g").alias("hi")).collect()
    ends = sorted((r.lo, r.hi) for r in files)
    assert len(ends) > 1 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
