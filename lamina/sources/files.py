"""Small files on whatever file system the paths name, through Hadoop's client in the driver."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Store:
    """Metadata files and atomic publication; data never pass through here."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    @property
    def fs(self):
        return self.path().getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read_json(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> bool:
        """Write under another name, then rename; false if the name is taken, so that of two writers one wins."""
        if self.fs.exists(self.path(name)):
            return False
        part = f"{name}.{id(value)}.part"
        stream = self.fs.create(self.path(part), True)
        try:
            stream.write(bytearray(json.dumps(value, default=str).encode()))
        finally:
            stream.close()
        return bool(self.fs.rename(self.path(part), self.path(name)))

    def read_bytes(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, name: str, value: bytes) -> None:
        """Write or replace a file."""
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(value))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"can't publish {new}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
