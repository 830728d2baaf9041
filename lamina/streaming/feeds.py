"""Streams: committed changes as they are published, and event-time operators over ``events``.

Changes are read by Spark's file source from the folder of a table's change files. A transaction's
files come there by a rename after its commit, so what is open or rolled back is never seen and no
transaction is split by a crash. The event-time operators have no counterpart in the versioned
tables; they are Spark's, wired for late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.engine import CHANGE_SCHEMA, Table


def change_stream(table: Table, since: int = 0) -> DataFrame:
    """Cell changes of committed transactions after a transaction, unbounded."""
    root = f"{table.engine.store.root}/{table.name}/change"
    store = table.engine.store
    store.fs.mkdirs(store.path(f"{table.name}/change"))  # a stream may begin before the first commit
    return table.spark.readStream.schema(CHANGE_SCHEMA).option("recursiveFileLookup", "true").parquet(root).where(F.col("txn_id") > since)


def to_kafka(messages: DataFrame, servers: str, checkpoint: str):
    """Routed envelopes to Kafka; needs Spark's Kafka package on the cluster."""
    out = messages.select("topic", "key", "value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return out.option("checkpointLocation", checkpoint).start()


def events(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream reads folders
    return raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling(stream: DataFrame, width: str) -> DataFrame:
    return stream.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str, step: str) -> DataFrame:
    return stream.groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    s = stream.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(list(keys))
