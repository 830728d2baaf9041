"""Shared pieces: lineage cuts, whole-buffer word hashing and connected components."""

from __future__ import annotations

import atexit
import bisect
import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.sources.shared import shared_folder

SPACE = r"[^\x20\x09-\x0D]+"  # a word: a run without ASCII white space


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the queries run inside go when each query ends; they'd stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage. ``df`` itself isn't to be run again."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables as compressed Parquet in the shared checkpoint folder, each dropped when it is done with.

    Columns of numbers take a fraction of what ``cut`` writes. Whatever is still there goes when the
    interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with tidy(self.spark):
            df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Some tables, or all of them."""
        for name in names or ("",):
            with contextlib.suppress(Exception):  # the session may have ended
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of those names, in any case, which results of the same names replace."""
    taken = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in taken))


def widened(df: DataFrame, more: dict[str, str]) -> T.StructType:
    """The schema of ``df`` and further columns."""
    extra = T.DataType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in more.items()))
    return T.StructType([*df.schema.fields, *extra.fields])


# --- hashing of many short strings in one buffer -----------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_POW = {"f": np.ones(1, dtype=np.uint64), "i": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    if len(_POW["f"]) < n:
        m = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for name, b in (("f", _BASE), ("i", _INV)):
                p = np.full(m, b, dtype=np.uint64)
                p[0] = 1
                _POW[name] = np.multiply.accumulate(p)
    return _POW["f"], _POW["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser: spreads a hash over all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of (buf[j] + 1) * base**j for j < i; spans are hashed from differences."""
    f, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * f[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for every pair, from ``prefix_hash``; the same bytes give the same hash anywhere."""
    _, i = _powers(len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * i[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACES[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, in order."""
    buf = np.frombuffer(text, dtype=np.uint8)
    start, end = word_spans(buf)
    return span_hash(prefix_hash(buf), start, end) if len(start) else np.zeros(0, dtype=np.uint64)


def joined_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of some texts, and which text it is of; one pass over all of them."""
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    start, end = word_spans(buf)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return span_hash(prefix_hash(buf), start, end), np.searchsorted(ends, start, side="right")


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; fewer words give one hash of all of them, none give none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD1B54A32D192ED03) + words[j : n - k + 1 + j]
        return mix64(h)


def text_blocks(column, max_bytes: int = 2_000_000):
    """(first row, list of UTF-8 texts) blocks of an Arrow string column; null is empty. Bounds what numpy holds at once."""
    block, size, first = [], 0, 0
    for i, x in enumerate(column):
        t = x.as_buffer()
        t = t.to_pybytes() if t is not None else b""
        if block and size + len(t) > max_bytes:
            yield first, block
            block, size, first = [], 0, i
        block.append(t)
        size += len(t)
    if block:
        yield first, block


# --- spans of a text -----------------------------------------------------------------------------


class Taken:
    """Places of a text that are taken, as disjoint intervals in order; asked and added to by binary search."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for a, b in sorted((s[0], s[1]) for s in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        """Whether [a, b) has a place in common with an interval."""
        i = bisect.bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        """An interval that meets no other."""
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


# --- connected components -----------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b long) the smallest node that it can reach.

    Alternates large-star and small-star rounds, whose count grows with the logarithm of a
    component's size. Minima come from partial aggregates and are joined back, so that no group of
    neighbours is gathered in one task; each round's edges are cut to the shared folder.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # cut, so that both sides of the join are plain exchanges, whose skewed parts Spark can split
        least = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now[0] == now[3] and seen == now:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: (node, smallest node)."""
    if not len(x):
        return x, y
    nodes, where = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = where[: len(x)], where[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
