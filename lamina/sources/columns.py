"""Reading Parquet by place: columns apart, rows by number, files in order; and Arrow's own files."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PLACE = ("row_file", "row_index")


def with_place(rows: DataFrame) -> DataFrame:
    """Rows of a Parquet read with their file and their number in it, which is their original order."""
    return rows.select("*", F.col("_metadata.file_name").alias("row_file"), F.col("_metadata.row_index").alias("row_index"))


def row_at(rows: DataFrame, *numbers: int) -> DataFrame:
    """The rows with some numbers in their file; Parquet skips row groups that hold none of them."""
    return with_place(rows).where(F.col("row_index").isin(*numbers))


def reassembled(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """Columns from several sets of files, whose files and rows correspond, side by side. Rows that not all have are an error of the files and go."""
    parts = [with_place(spark.read.parquet(p).select(*columns, "_metadata")).drop("_metadata") for p, columns in paths.items()]
    return reduce(lambda a, b: a.join(b, list(PLACE)), parts).drop(*PLACE)


def to_ipc(df: DataFrame) -> DataFrame:
    """(payload): Arrow IPC files, one for each batch of rows."""

    def run(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["payload"])

    return df.mapInArrow(run, "payload binary")


def from_ipc(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of Arrow IPC files (payload), files or streams."""
    wanted = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for payload in batch.column(0):
                raw = payload.as_buffer()
                reader = pa.ipc.open_file(raw) if bytes(raw[:6]) == b"ARROW1" else pa.ipc.open_stream(raw)
                for b in reader.read_all().select(schema.names).cast(wanted).to_batches():
                    yield b

    return payloads.select("payload").mapInArrow(run, schema)


def read_ipc(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Arrow IPC files under a path that Spark can read; each is one task's."""
    return from_ipc(spark.read.format("binaryFile").load(path).select(F.col("content").alias("payload")), schema)
