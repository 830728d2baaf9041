"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``SIZE`` smallest distinct hashes of a text's five-word shingles. Sketches of parts
merge into the sketch of the whole; two of them estimate resemblance, containment and the number
of distinct shingles, exactly while a text has fewer than ``SIZE``.

The query also fingerprints each text's edited form, which takes its second half from the next
document in descending ids. Ids are dealt to ranges by quantiles, each range is sorted in its
task, and the first document of the range that follows is sent along as a guest, so that every
text is shuffled once and no task sees more than its range.

Defined results. Null text: empty; an empty sketch is like another empty one (1) and unlike any
other (0). Texts of fewer words than a shingle: one shingle of all words. Null ids come last; equal
ids follow the order of their texts. One document is its own next. Empty table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import documents, shingle_hashes, word_hashes

SIZE = 256
SHINGLE = 5
ROWS = 2048  # documents of a range
RANGES = 20_000  # beyond so many, ranges grow; they are streamed


def sketch(text: bytes, size: int = SIZE) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), SHINGLE))[:size]


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:size]


def distinct(s: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < size else (size - 1) / max(float(s[-1]) / 2.0**64, 2.0**-64)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common shingles among those of either text."""
    both = np.union1d(a, b)[:size]
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b has too."""
    j = resemblance(a, b, size)
    union = distinct(merge(a, b, size), size)
    return min(1.0, j * union / max(distinct(a, size), 1.0)) if len(a) else 1.0


def pack(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def unpack(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u8")


LOWEST = -(1 << 63)


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (fp_range, fp_guest, key, text), to be read within partitions in order: own rows by descending key, then guests."""
    place = F.coalesce(F.col(key), F.lit(LOWEST)).cast("long")
    ids = docs.select(place.alias("k"))
    n = ids.count()
    ranges = max(1, min(RANGES, math.ceil(n / ROWS)))
    cuts = ids.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] if ranges > 1 else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def range_of(k: pd.Series) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, k.to_numpy(dtype=np.int64), side="left")  # 0 has the highest keys

    dealt = F.pandas_udf(lambda k: pd.Series(range_of(k)), "int")
    heads = ids.select("k", dealt("k").alias("r")).groupBy("r").agg(F.max("k").alias("k")).orderBy("r").collect()
    before = {h.k: heads[i - 1].r for i, h in enumerate(heads)}  # the first follows the last

    def targets(k: pd.Series) -> pd.Series:
        return pd.Series([[2 * int(r)] if x not in before else [2 * int(r), 2 * before[x] + 1] for x, r in zip(k, range_of(k))])

    sent = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), place.alias("place"))
    sent = sent.withColumn("to", F.explode(F.pandas_udf(targets, "array<int>")("place")))
    sent = sent.select(F.shiftright("to", 1).alias("fp_range"), (F.col("to") % 2).alias("fp_guest"), "place", "key", "text")
    return sent.repartitionById(ranges, "fp_range").sortWithinPartitions("fp_range", "fp_guest", F.col("place").desc(), "text").drop("place")


def fingerprint_with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = docs.schema[key].dataType
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held, rows = None, []  # the row that waits for its next: range, key, text, sketch
        types = None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            types = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for r, guest, k, t in zip(*(batch.column(i) for i in range(4))):
                r, guest, k, t = r.as_py(), guest.as_py(), k.as_py(), t.as_py()
                if guest and held is None:
                    continue
                own = sketch(t.encode())
                if held is not None and held[0] == r:
                    _, hk, ht, hs = held
                    half = len(ht) // 2
                    edited = (ht[: len(ht) - half] + t[:half]).encode()
                    es = sketch(edited)
                    rows.append((hk, len(ht), hashlib.sha256(edited).hexdigest(), pack(hs), pack(es), resemblance(hs, es), resemblance(hs, own)))
                held = None if guest else (r, k, t, own)
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in names[2:5]), *(T.StructField(n, T.DoubleType()) for n in names[5:])])
    return with_next(docs, key=key, text=text).mapInArrow(run, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
SQL: dict[str, str] = {}
