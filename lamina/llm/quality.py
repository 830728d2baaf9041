"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. How far each can be
trusted is estimated without any labels by expectation-maximisation over a latent class: the votes
of the whole corpus enter as counts of vote patterns, of which there are at most 3**labellers, so
the driver holds a bounded table however large the corpus is. The posterior of each pattern then
labels a bounded sample of texts (about ``sample``, chosen by a hash of the text), on which a hashed linear
scorer is trained: runs of character classes hashed to ``DIMS`` weights, averaged over the text,
and hashed levels of repetition. The scorer judges every whole text.

Defined results. Null or empty text: every labeller but that of length abstains, the scorer sees
its bias and the length feature; such documents are judged like any other. Empty table: empty
result. Repeated rows are judged alike, and the sample has a text once. ``keep_good`` passes all
columns on, whatever their names; where ``judge`` adds a column of a name that is taken, its own
replaces the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import documents, prefix_hash, span_hash, text_blocks, widened, without, word_spans

DIMS = 4096
SAMPLE = 3000
GRAM = 5
LABELLERS = ("variety", "capitals", "symbols", "letters", "runs", "length", "phrases", "tables")

#: character classes: 0 space, 1 lower, 2 upper, 3 digit, 4 sentence punctuation, 5 symbol, 6 beyond ASCII, 7 control
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[:128] = 5
_CLASS[:32] = 7
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4


@dataclass
class Profile:
    """What labellers and scorer see of a text."""

    words: int
    variety: float  # distinct words by words, for the expected number at this length
    phrases: float  # repeated runs of three words
    runs: float  # words equal to the one before
    capitals: float
    symbols: float
    letters: float
    bars: float  # cell bars by words
    codes: np.ndarray


def profile(text: bytes) -> Profile:
    buf = np.frombuffer(text, dtype=np.uint8)
    start, end = word_spans(buf)
    n = len(start)
    kinds = _CLASS[buf]
    count = np.bincount(kinds, minlength=8)
    letters = int(count[1] + count[2] + count[6])
    if n:
        w = span_hash(prefix_hash(buf), start, end)
        distinct = len(np.unique(w))
        with np.errstate(over="ignore"):
            three = w[2:] * np.uint64(3) + w[1:-1] * np.uint64(7) + w[:-2] * np.uint64(31)
        phrases = 1 - len(np.unique(three)) / len(three) if len(three) else 0.0
        runs = float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0
    else:
        distinct, phrases, runs = 0, 0.0, 0.0
    m = len(kinds) - GRAM + 1
    codes = np.zeros(max(m, 0), dtype=np.int64)
    for j in range(GRAM if m > 0 else 0):
        codes = codes * 8 + kinds[j : m + j]
    codes = (codes * 2654435761 >> 7) % (DIMS - 64) if m > 0 else codes
    solid = max(1, int(count[1:].sum()))
    return Profile(n, distinct / min(n, 400) if n else 0.0, phrases, runs, int(count[2]) / max(1, int(count[1] + count[2])), int(count[5]) / solid, letters / solid, int((buf == ord("|")).sum()) / max(1, n), codes)


def votes(p: Profile) -> tuple[int, ...]:
    """One vote of each labeller: 1 good, 0 bad, 2 abstains."""
    if p.words < 16:  # too short to tell
        return tuple(0 if p.words < 2 and name == "length" else 2 for name in LABELLERS)
    pick = lambda bad, good: 0 if bad else 1 if good else 2
    return (
        pick(p.variety < 0.15 and p.words >= 20, p.variety > 0.3),
        pick(p.capitals > 0.5, p.capitals < 0.2),
        pick(p.symbols > 0.08, p.symbols < 0.02),
        pick(p.letters < 0.75, p.letters > 0.9),
        pick(p.runs > 0.2, p.runs < 0.05),
        pick(False, p.words >= 30),
        pick(p.phrases > 0.4, p.phrases < 0.1),
        pick(p.bars > 0.2, p.bars < 0.02),
    )


def pattern(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def unpattern(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return tuple(reversed(out))


def estimate(counts: dict[int, int], rounds: int = 200, prior: float = 0.85) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over vote patterns: each pattern's posterior of good, labellers' vote rates (class x labeller x vote) where they vote, share of good.

    It starts from the majority of votes, which also fixes which class is the good one.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    if not len(codes):
        return {}, np.full((2, len(LABELLERS), 2), 0.5), prior
    n = np.array([counts[int(c)] for c in codes], dtype=float)
    v = np.array([unpattern(int(c)) for c in codes])
    good = (1.0 + 2 * (v == 1).sum(1)) / (2.0 + 2 * (v == 1).sum(1) + 4 * (v == 0).sum(1))
    one = np.stack([v == k for k in range(2)], axis=2).astype(float)  # an abstention is no evidence
    rate, share = np.zeros((2, len(LABELLERS), 2)), prior
    for _ in range(rounds):
        for c, p in enumerate((1 - good, good)):
            rate[c] = np.einsum("i,ijk->jk", n * p, one) + 0.5
            rate[c] /= rate[c].sum(axis=1, keepdims=True)
        share = float((n * good).sum() / n.sum())
        share = min(max(share, 1e-3), 1 - 1e-3)
        logs = [np.log(s) + np.einsum("ijk,jk->i", one, np.log(rate[c])) for c, s in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return {int(c): float(g) for c, g in zip(codes, good)}, rate, share


def hashed(p: Profile) -> np.ndarray:
    """The scorer's features: shares of hashed class runs, and one of eight levels for each repetition measure."""
    x = np.zeros(DIMS, dtype=np.float32)
    if len(p.codes):
        x[: DIMS - 64] = np.bincount(p.codes, minlength=DIMS - 64) * (32.0 / len(p.codes))
    x[_levels(p)] = 1
    return x


def _levels(p: Profile) -> list[int]:
    level = lambda value, top: int(min(7, max(0.0, value) / top * 8))
    base = DIMS - 64
    return [base + level(p.variety, 1.0), base + 8 + level(p.phrases, 1.0), base + 16 + level(p.runs, 0.5), base + 24 + level(np.log2(p.words + 1), 12.0), base + 32 + level(p.symbols, 0.2), base + 40 + level(p.capitals, 1.0), base + 48 + level(1 - p.letters, 0.5), base + 56 + level(p.bars, 0.5)]


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-3, rate: float = 0.05) -> np.ndarray:
    """Weights and bias of a logistic model for soft labels, by Adam on the whole sample."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros(x.shape[1], np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / max(len(y), 1) + l2 * w
        m = 0.9 * m + 0.1 * g
        s = 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def score(p: Profile, w: np.ndarray) -> float:
    z = float(w[-1]) + (32.0 * float(w[p.codes].mean()) if len(p.codes) else 0.0) + float(w[_levels(p)].sum())
    return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def fit(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, dict[int, float], np.ndarray]:
    """Scorer weights, pattern posteriors and labellers' vote rates for a corpus."""

    def vote(batches):
        for batch in batches:
            out = [pattern(votes(profile(t))) for _, block in text_blocks(batch.column(0)) for t in block]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["q_pattern"])

    counts = {r[0]: r[1] for r in docs.select(F.col(text).alias("t")).mapInArrow(vote, "q_pattern int").groupBy("q_pattern").count().collect()}
    posterior, rates, _ = estimate(counts)
    total = sum(counts.values())
    share = min(1.0, sample / max(total, 1))
    chosen = F.pmod(F.xxhash64("t", F.lit("quality")), F.lit(10**15)) < math.ceil(share * 10**15)

    def example(batches):
        for batch in batches:
            xs, ps = [], []
            for _, block in text_blocks(batch.column(0)):
                for t in block:
                    p = profile(t)
                    ps.append(pattern(votes(p)))
                    xs.append(hashed(p).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ps, pa.int32())], names=["x", "p"])

    texts = docs.select(F.col(text).alias("t")).where(chosen).distinct()  # of a text that a third of the rows share, one
    rows = texts.mapInArrow(example, "x binary, p int").collect()
    if not rows:
        return np.zeros(DIMS + 1, np.float32), posterior, rates
    x = np.frombuffer(b"".join(bytes(r[0]) for r in rows), dtype=np.float16).reshape(len(rows), DIMS).astype(np.float32)
    return train(x, np.array([posterior[r[1]] for r in rows])), posterior, rates


def judge(rows: DataFrame, w: np.ndarray, posterior: dict[int, float], *, text: str = "text", threshold: float = 0.5, drop_text: bool = True) -> DataFrame:
    """``rows`` with q_votes (one digit a labeller), q_posterior, q_score and q_kept."""
    names = ["q_votes", "q_posterior", "q_score", "q_kept"]
    rows = without(rows, *names)
    at = rows.columns.index(text)
    base = rows.drop(text) if drop_text else rows
    kept = [i for i, c in enumerate(rows.columns) if not (drop_text and i == at)]

    def run(batches):
        for batch in batches:
            v, post, s = [], [], []
            for _, block in text_blocks(batch.column(at)):
                for t in block:
                    p = profile(t)
                    vote = votes(p)
                    v.append("".join(map(str, vote)))
                    post.append(posterior.get(pattern(vote), 0.5))
                    s.append(score(p, w))
            new = [pa.array(v, pa.string()), pa.array(post, pa.float64()), pa.array(s, pa.float64()), pa.array([x >= threshold for x in s], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *new], names=[*(batch.schema.names[i] for i in kept), *names])

    return rows.mapInArrow(run, widened(base, dict(zip(names, ["string", "double", "double", "boolean"]))))


def keep_good(docs: DataFrame, *, text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents that the scorer accepts, columns unchanged."""
    w, _, _ = fit(docs, text=text, sample=sample)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            good = [score(profile(t), w) >= threshold for _, block in text_blocks(batch.column(at)) for t in block]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    w, posterior, _ = fit(docs)
    return judge(docs, w, posterior).select("doc_id", F.col("q_votes").alias("votes"), F.col("q_posterior").alias("posterior"), F.col("q_score").alias("score"), F.col("q_kept").alias("kept"))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
