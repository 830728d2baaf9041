"""Streams drained to tables: the change feed, and event-time operators over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.plans.engine import _customers
from lamina.plans.registry import query
from lamina.sources.files import Store
from lamina.sources.shared import shared_folder
from lamina.streaming import feeds


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream holds now, as a table that executors write to the shared folder; none of it passes through the driver.

    A batch that is tried again replaces what it wrote. In mode ``complete`` each batch is the whole result and replaces the last.
    """
    spark = stream.sparkSession
    store = Store(spark, f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}")
    store.fs.mkdirs(store.path("rows"))  # a stream may hold nothing

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store.root}/rows/{0 if mode == 'complete' else batch}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    store.remove("checkpoint")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{store.root}/rows")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return drain(feeds.tumbling(feeds.events(spark, sf_dir), "1 day"), "complete")


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS start FROM events) GROUP BY start")
def stream_sliding(spark, sf_dir):
    return drain(feeds.sliding(feeds.events(spark, sf_dir), "12 hours", "6 hours"), "complete")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '1 day' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, sf_dir):
    return drain(feeds.sessions(feeds.events(spark, sf_dir), "1 day"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    e = feeds.events(spark, sf_dir, late="3650 days")
    return drain(feeds.deduplicated(e, "user_id", "event_type").select("user_id", "event_type"))


_UPDATED = "SELECT c_custkey, 'update' AS op, 'c_acctbal' AS col, c_acctbal AS before_v, 0.0 AS after_v FROM customer WHERE c_nationkey = 3"
_DELETED = """SELECT c_custkey, 'delete' AS op, 'c_acctbal' AS col, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS before_v, NULL AS after_v
 FROM customer WHERE c_mktsegment = 'BUILDING'"""


@query(f"SELECT c_custkey, op, col, CAST(before_v AS DOUBLE) AS before_v, CAST(after_v AS DOUBLE) AS after_v FROM ({_UPDATED} UNION ALL {_DELETED})")
def stream_changes(spark, sf_dir):
    """All that was committed after the insert; a transaction that was rolled back is not in it."""
    _, k, _ = _customers(spark, sf_dir)
    double = lambda c: F.col(c).cast("double").alias(c)
    cells = drain(feeds.change_stream(k, 1)).where("col = 'c_acctbal' and op <> 'insert'")
    return cells.select(F.col("pk").cast("long").alias("c_custkey"), "op", "col", double("before_v"), double("after_v"))


@query("SELECT 'insert' AS op, count(*) * 5 AS n FROM customer UNION ALL SELECT 'update', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'delete', count(*) * 5 FROM customer WHERE c_mktsegment = 'BUILDING'")
def stream_committed(spark, sf_dir):
    """A stream that is read while a transaction is open sees nothing of it."""
    e, k, _ = _customers(spark, sf_dir)
    x = e.begin()
    k.update("c_custkey < 100", {"c_name": "open"}, x)
    out = drain(feeds.change_stream(k))
    e.rollback(x)
    return out.groupBy("op").agg(F.count("*").alias("n"))
