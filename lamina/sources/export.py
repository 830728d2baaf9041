"""Parquet export with metadata: versions beside each other, published by one small file."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import ConflictError
from lamina.sources.files import Store

#: How columns are named in export metadata (fixed values).
TYPE_NAMES = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string", "binary": "binary", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}


def export_schema(schema: T.StructType) -> list[dict]:
    """Fields with ids from 1; required where null isn't allowed."""
    return [{"id": i, "name": f.name, "type": TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()), "required": not f.nullable} for i, f in enumerate(schema.fields, 1)]


def file_stats(df: DataFrame) -> DataFrame:
    """(file, column, n, nulls, nans, lower, upper) for every file, in one pass over them."""
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggs = [F.count("*").alias("n")]
    for f in plain:
        floating = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        v = F.when(~F.isnan(f.name), F.col(f.name)) if floating else F.col(f.name)
        aggs += [F.count_if(F.col(f.name).isNull()).alias(f"{f.name}__nulls"), (F.count_if(F.isnan(f.name)) if floating else F.lit(0)).alias(f"{f.name}__nans"), F.min(v).cast("string").alias(f"{f.name}__lower"), F.max(v).cast("string").alias(f"{f.name}__upper")]
    rows = F.array(*(F.struct(F.lit(f.name).alias("column"), *(F.col(f"{f.name}__{k}").alias(k) for k in ("nulls", "nans", "lower", "upper"))) for f in plain))
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(*aggs).select("file", "n", F.inline(rows))


def versions(store: Store) -> list[int]:
    """The numbers of the versions that were published."""
    return [int(m[1]) for n in store.names("metadata") if (m := re.fullmatch(r"v(\d+)\.json", n))]


def export(df: DataFrame, root: str, *, partition_by: tuple[str, ...] = (), compression: str = "zstd", second: str | None = None) -> int:
    """Write a new version under ``root`` and publish it; returns its number. Readers see the old one until then.

    ``second`` names another format, such as orc, in which the version is written too.
    """
    spark = df.sparkSession
    store = Store(spark, root)
    version = 1 + max([0, *versions(store)])
    data = f"data/v{version}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(f"{root}/{data}")
    stats = f"metadata/stats-v{version}-{uuid.uuid4().hex}"  # a row for each file and column stays a table: there may be millions
    file_stats(spark.read.parquet(f"{root}/{data}")).write.parquet(f"{root}/{stats}")
    meta = {"version": version, "data": data, "schema": export_schema(df.schema), "partition_by": list(partition_by), "stats": stats}
    if second:
        meta["second"] = f"second/v{version}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).format(second).save(f"{root}/{meta['second']}")
        meta["second_format"] = second
    if not store.write_json(f"metadata/v{version}.json", meta):
        raise ConflictError(f"version {version} was published by another writer")
    return version


def metadata(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What was published about a version, the newest if none is given."""
    store = Store(spark, root)
    version = version or max(versions(store))
    return store.read_json(f"metadata/v{version}.json")


def read_export(spark: SparkSession, root: str, version: int | None = None, *, second: bool = False) -> DataFrame:
    m = metadata(spark, root, version)
    return spark.read.format(m["second_format"]).load(f"{root}/{m['second']}") if second else spark.read.parquet(f"{root}/{m['data']}")


def read_stats(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(file, column, n, nulls, nans, lower, upper) of a version."""
    return spark.read.parquet(f"{root}/{metadata(spark, root, version)['stats']}")
