"""Toxicity: boosted trees over dense features, with isotonic calibration.

Lexicons are learned from the labelled training rows: words and word beginnings that toxic
documents use far more often than others, by smoothed log odds. A text's features are densities of
lexicon words and stems (whole text, densest window), their obfuscated forms (digits and signs for
letters, split by marks), distance to second-person words, shares of capitals and of punctuation.
Boosted trees are fitted to a bounded sample of labelled rows (``TRAIN_ROWS``, by a hash), half of
which teach the lexicons and half the trees, then the other way round, so that no row's own words
shape its features while trees are fitted; calibration uses out-of-fold scores. Every whole text
is scored.

Defined results. Null or empty text: features of an empty text, a score like any other. Labels for
unknown documents, null labels and null ids: not used; a null id is not held out. An id with
several labels: the greatest; with several texts: the first in order. Too few labels, or of one
kind only: every score is 0. Repeated rows are scored alike. Empty table: empty result. A column
named like the score is replaced by it; others are passed on.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import accumulate
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.boost import Boosted, fit
from lamina.llm.common import cut, documents, widened, without

TRAIN_ROWS = 6000  # labelled rows to fit with, about
TRAIN_BYTES = 16_000_000  # and of their texts
HELD_OUT = 2
STEMS = (4, 5, 6)
LEXICON = 4000
WINDOW = 24
_WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
_ODD = re.compile(r"[^\W\d_][@$0134578!*]{1,3}[^\W\d_]|(?<!\S)[@$0134578][^\W\d_]{3}", re.UNICODE)
_BLANK = re.compile(r"\s")
_SPLIT = re.compile(r"(?:[^\W\d_][.\-*_]){3,}[^\W\d_]", re.UNICODE)
_PLAIN = str.maketrans("@$0134578!", "asoieastbi")
SECOND = frozenset("you your yours you're u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted vosotros".split())


def held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % 4 == HELD_OUT


def learn_lexicon(words: list[set[str]], toxic: np.ndarray, size: int = LEXICON) -> dict[str, float]:
    """Words, and stems marked by a trailing star, with their log odds of toxic; only clear ones."""
    pos, neg = Counter(), Counter()
    for w, y in zip(words, toxic):
        bag = set(w)
        for k in STEMS:
            bag.update(x[:k] + "*" for x in w if len(x) >= k)
        (pos if y else neg).update(bag)
    np_, nn = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    scored = []
    for t, a in pos.items():
        if a >= 3:
            z = math.log((a + 0.5) / (np_ + 1)) - math.log((neg[t] + 0.5) / (nn + 1))
            if z > 2:
                scored.append((z * math.sqrt(min(a, 50)), t, z))
    scored.sort(key=lambda s: (-s[0], s[1]))
    return {t: z for _, t, z in scored[:size]}


def _weights(words: list[str], lexicon: dict[str, float], memo: dict[str, float]) -> np.ndarray:
    out = np.zeros(len(words))
    for i, w in enumerate(words):
        v = memo.get(w)
        if v is None:
            v = max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "*", 0.0) for k in STEMS if len(w) >= k)])
            if len(memo) < 500_000:
                memo[w] = v
        if v:
            out[i] = v
    return out


def features(text: str, lexicon: dict[str, float], memo: dict[str, float]) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    w = _weights(words, lexicon, memo)
    at = np.flatnonzero(w)
    hits = len(at)
    top = float(w.max()) if n else 0.0
    strong = int((w > 4).sum())
    if hits:
        spread = np.searchsorted(at, at + WINDOW) - np.arange(hits)
        dense = float(spread.max())
        you = np.array([i for i, x in enumerate(words) if x in SECOND]) if hits else at
        if len(you):
            k = np.searchsorted(you, at)
            near = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(at - you[np.maximum(k - 1, 0)]))
            near = float(1 / (1 + near.min()))
        else:
            near = 0.0
    else:
        dense = near = 0.0
    second = sum(x in SECOND for x in words) / max(n, 1)
    odd, done = 0, 0
    for m in _ODD.finditer(low):
        if m.start() < done:
            continue
        a = max(done, *(low.rfind(c, done, m.start()) + 1 for c in " \n\t\r\f\v"))  # from the last blank
        blank = _BLANK.search(low, m.end())
        done = blank.start() if blank else len(low)
        p = low[a:done].strip(".,;:?!\"'()").translate(_PLAIN)
        odd += p in lexicon or any(p[:k] + "*" in lexicon for k in STEMS if len(p) >= k)
    for m in _SPLIT.finditer(low):
        odd += re.sub(r"[.\-*_]", "", m.group()) in lexicon
    chars = max(1, len(text))
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    marks = text.count("!") + text.count("?")
    distinct = len({words[i] for i in at})
    return [
        float(hits), hits / max(n, 1), float(strong), strong / max(n, 1), float(w.sum()), float(w.sum()) / max(n, 1), top, float(distinct), dense, near, second,
        float(odd), odd / max(n, 1), upper / chars, marks / chars, (text.count("!!") + text.count("??")) / chars, math.log1p(n), text.count("*") / chars,
    ]


def train(rows: list[tuple[str, int]], trees: int = 60) -> tuple[Boosted | None, dict[str, float]]:
    """The calibrated trees and the lexicon of all training rows. ``rows``: (text, toxic), bounded by the caller."""
    y = np.array([r[1] for r in rows], dtype=float)
    if len(y) < 20 or not 0 < y.sum() < len(y):
        return None, {}
    one: dict[str, str] = {}  # a string object for each word, however often it occurs
    words = [{one.setdefault(w, w) for w in _WORD.findall((t or "").lower())} for t, _ in rows]
    part = np.arange(len(rows)) % 2
    x = np.zeros((0, 18))
    labels = []
    for k in (0, 1):
        own = np.flatnonzero(part != k)
        lexicon, memo = learn_lexicon([words[i] for i in own], y[own]), {}
        use = np.flatnonzero(part == k)
        x = np.concatenate([x, np.array([features(rows[i][0] or "", lexicon, memo) for i in use])])
        labels.append(y[use])
    return fit(x, np.concatenate(labels), trees=trees), learn_lexicon(words, y)


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """A bounded sample of labelled rows outside the held-out part, by a hash of the key; one row a key.

    A count of keys says which share of the hashes to take, so that no task merges candidates; texts
    come in order of the hash until their bytes reach the bound.
    """
    asked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y"))
    asked = asked.where(F.crc32(F.col("k").cast("string").cast("binary")) % 4 != HELD_OUT)
    keys = asked.agg(F.approx_count_distinct("k", 0.02)).first()[0]
    turn = F.pmod(F.xxhash64("k", F.lit("toxic")), F.lit(10**15))
    asked = asked.where(turn < math.ceil(min(1.0, most / max(keys, 1)) * 10**15)).groupBy("k").agg(F.max("y").alias("y"))
    found = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(asked), "k")  # about ``most`` rows
    found = cut(found.groupBy("k", "y").agg(F.min("t").alias("t")).withColumn("turn", F.xxhash64("k", F.lit("part"))))
    sizes = sorted(tuple(r) for r in found.select("turn", "k", F.octet_length("t")).collect())
    fits = sum(total <= most_bytes for total in accumulate(n for _, _, n in sizes))
    if not fits:
        return []
    last = sizes[fits - 1][:2]
    rows = found.where(F.struct("turn", "k") <= F.struct(F.lit(last[0]).alias("turn"), F.lit(last[1]).alias("k")))
    return [(r.t, int(r.y)) for r in sorted(rows.collect(), key=lambda r: (r.turn, r.k))]


def score(rows: DataFrame, model: Boosted | None, lexicon: dict[str, float], *, text: str = "text", column: str = "tox_score") -> DataFrame:
    """``rows`` without the text, with the probability of toxic."""
    rows = without(rows, column)
    at = rows.columns.index(text)
    shared = rows.sparkSession.sparkContext.broadcast((model, lexicon))  # LEXICON words and the trees

    def run(batches):
        model, lexicon = shared.value
        memo: dict[str, float] = {}
        for batch in batches:
            x = [features(v.as_py() or "", lexicon, memo) for v in batch.column(at)] if model else []
            p = model.predict(np.array(x)) if x else np.zeros(batch.num_rows)
            thin = batch.drop_columns([batch.schema.names[at]])
            yield pa.RecordBatch.from_arrays([*thin.columns, pa.array(p, pa.float64())], names=[*thin.schema.names, column])

    return rows.mapInArrow(run, widened(rows.drop(text), {column: "double"}))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model, lexicon = train(training_rows(docs, labels))
    out = score(docs, model, lexicon)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
