"""SimHash near-duplicates through pivot distance tables.

A fingerprint's bits are the majority over the XXH64 hashes of a text's word shingles. Equal
fingerprints are one node. Fingerprints within ``radius`` bits of each other agree on at least
``blocks - radius`` of their bit blocks, so each node is sent under every choice of that many
blocks and meets there all nodes it may link with; nothing is lost and a key's bits, 25 of 64,
spread any corpus. A key that many nodes share is cut into salted parts, every two of which meet
in one group of bounded size. In a group, the Hamming distances of all members to fixed reference
fingerprints form a table: by the triangle inequality a pair whose rows differ by more than
``radius`` in any coordinate can't link, which leaves few pairs to verify bit by bit. A group
hands on a spanning forest of its links, not all pairs.

Defined results. Null or wordless text: fingerprint zero, linked like any other. Fewer words than
a shingle: one shingle of all. Repeated rows each get a result; a component's id is its smallest
doc_id, null doc_ids last. An empty table gives an empty result. Other columns play no part; one
named like a column of the result (sh_fp, sh_root, component_id) is replaced by it.

``keep_first`` passes all columns on, whatever their names. All texts without words are alike, so
one of them stays.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import components, cut, documents, forest, mix64, shingle_hashes, text_blocks, widened, without, word_hashes

BLOCKS = (13, 13, 13, 13, 12)  # bits of each block
PIVOTS = 16
PART, LARGEST = 256, 8192  # nodes of a key's part, which grows with the root of all rows; two parts meet in a group
WORDS, SHINGLE = 4, 5  # for documents of a given similarity: 64-bit words of a fingerprint, words of a shingle
BANDS, ROWS = 16, 4


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_digest
    if n <= shingle:
        digests, n = h(b" ".join(words), seed), 1
    else:
        joined, at, starts = b" ".join(words), 0, []
        for w in words:
            starts.append(at)
            at += len(w) + 1
        starts.append(at)
        n -= shingle - 1
        digests = b"".join([h(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])])
    ones = np.zeros(64, dtype=np.int64)
    raw = np.frombuffer(digests, dtype=np.uint8)
    for i in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[i : i + (1 << 16)]).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(rows: DataFrame, *, text: str = "text", column: str = "sh_fp", shingle: int = 3) -> DataFrame:
    """``rows`` with the signed 64-bit fingerprint of their text in place of the text."""
    rows = without(rows, column)
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            out = [int.from_bytes(fingerprint(t, shingle).to_bytes(8, "big"), "big", signed=True) for _, block in text_blocks(batch.column(at)) for t in block]
            thin = batch.drop_columns([batch.schema.names[at]])
            yield pa.RecordBatch.from_arrays([*thin.columns, pa.array(out, pa.int64())], names=[*thin.schema.names, column])

    return rows.mapInArrow(run, widened(rows.drop(text), {column: "long"}))


def pivots(words: int = 1, n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints, of ``words`` times 64 bits: fixed, from a documented seed."""
    return np.random.default_rng(64).integers(0, 1 << 64, (n, words), dtype=np.uint64)


def linked_pairs(group: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int = 3, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of nodes within ``radius`` bits and in the same group, which are ``alike`` (rows a, rows b) if given.

    ``fp`` has a row of 64-bit words for each node. Rows of a group are ordered by their distance to
    the first pivot and compared with ever later ones; pairs that are connected already need no
    more comparison.
    """
    table = np.stack([np.bitwise_count(fp ^ p).sum(axis=1) for p in pivots(fp.shape[1])], axis=1).astype(np.int16)
    order = np.lexsort((table[:, 0], group))
    group, node, fp, table = group[order], node[order], fp[order], table[order]
    end = np.searchsorted(group, group, side="right")
    label = np.arange(len(node))
    left, right, fresh, lag = [node[:0]], [node[:0]], [], 1
    live = np.arange(len(node))
    while True:
        live = live[live + lag < end[live]]
        live = live[table[live + lag, 0] - table[live, 0] <= radius]  # sorted by it: later ones are farther
        if not len(live):
            break
        a = live[label[live] != label[live + lag]]
        for c in range(1, table.shape[1]):
            a = a[np.abs(table[a + lag, c] - table[a, c]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]).sum(axis=1) <= radius]
        if alike is not None:
            a = a[alike(order[a], order[a + lag])]
        left.append(node[a])
        right.append(node[a + lag])
        if len(a):
            fresh.append((a, a + lag))
        if fresh and (lag & (lag - 1) == 0 or sum(len(x) for x, _ in fresh) > 50_000):
            x, y = forest(np.concatenate([label[x] for x, _ in fresh]), np.concatenate([label[y] for _, y in fresh]))
            least = np.arange(len(node))
            least[x] = y
            label, fresh = least[label], []
        lag += 1
    return forest(np.concatenate(left), np.concatenate(right))


def candidate_groups(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Groups in which every two nodes within ``radius`` meet at least once. ``nodes``: distinct fp."""
    shift, at = [], 64
    for bits in BLOCKS:
        at -= bits
        shift.append((at, (1 << bits) - 1, bits))
    keys = []
    for c, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius)):
        key = F.lit(c).cast("long")
        for b in chosen:
            s, mask, bits = shift[b]
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(mask).cast("long")))
        keys.append(key)
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    return bounded_groups(rows.select("key", F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp")))


def bounded_groups(rows: DataFrame) -> DataFrame:
    """(key, i, j, node, fp) of rows (key, node, fp): keys of one node go, large ones are cut into parts, every two of which meet."""
    full = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    part = min(LARGEST, max(PART, math.isqrt(rows.count())))
    parts = F.ceil(F.col("n") / part).cast("int")
    rows = rows.join(full, "key").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node"), parts).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "fp")


def links(groups: DataFrame, radius: int = 3, *, words: int | None = None, similarity: float = 0.0) -> DataFrame:
    """(a, b): links between nodes, enough of them to connect what is connected. ``groups``: key, i, j, node, fp (binary).

    With ``words``, a fingerprint has so many words, and the sorted shingle hashes that follow it
    must resemble each other by ``similarity``.
    """
    groups = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select(F.xxhash64("key", "i", "j").alias("g"), "node", "fp")

    def run(batches):
        kept = None

        def flush(t):
            raw, alike = t["fp"].to_pylist(), None
            if words is not None:
                sets, raw = [np.frombuffer(x, "<u8", offset=8 * words) for x in raw], [x[: 8 * words] for x in raw]
                alike = lambda a, b: np.array([jaccard(sets[x], sets[y], similarity) >= similarity for x, y in zip(a, b)], dtype=bool)
            fp = np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64).reshape(len(t), -1)
            a, b = linked_pairs(t["g"].to_numpy(), t["node"].to_numpy(), fp, radius, alike)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
            g = t["g"].to_numpy()
            held = len(g) - int(np.argmax(g[::-1] != g[-1])) if len(g) and (g != g[-1]).any() else 0
            if held:
                yield flush(t.slice(0, held))
            kept = t.slice(held)
        if kept is not None and len(kept):
            yield flush(kept)

    return groups.mapInArrow(run, "a long, b long")


def clusters(prints: DataFrame, *, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """``prints`` (key, sh_fp) with component_id, the smallest key reachable through links, and sh_root, its smallest fingerprint."""
    prints = without(prints, "sh_root", "component_id")
    nodes = cut(prints.groupBy(F.col("sh_fp").alias("fp")).agg(F.min(key).alias("least")))
    found = components(links(candidate_groups(nodes.select("fp"), radius), radius))
    roots = cut(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    per = roots.select("fp", "root").join(ids, "root").select(F.col("fp").alias("sh_fp"), F.col("root").alias("sh_root"), "component_id")
    return prints.join(per, "sh_fp")


# --- documents of a given similarity ----------------------------------------------------------------


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The resemblance of two sorted sets, 0 where their sizes alone keep it below ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < least * len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, sorted by hash."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), shingle))


def wide_prints(rows: DataFrame, *, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``rows`` with sh_fp, a fingerprint of ``WORDS`` times 64 bits, sh_keys and node, a hash of its shingles, in place of the text.

    All are of distinct shingles, however often a text has them.
    The keys are least hashes of the shingles, ``ROWS`` at a time: texts that share most shingles
    share one of the ``BANDS`` keys almost surely, texts that share none have none in common.
    """
    at = rows.columns.index(text)
    turns = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    spins = np.random.default_rng(6).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)

    def one(t: bytes) -> tuple[bytes, np.ndarray, int]:
        h = shingle_set(t, shingle)
        node = int(np.frombuffer(xxhash.xxh64_digest(h.tobytes()), ">i8")[0])
        if not len(h):
            return bytes(8 * WORDS), np.zeros(1, np.int64), node
        ones = np.zeros(64 * WORDS, np.int64)
        least = np.full(len(turns), np.uint64((1 << 64) - 1))
        for i in range(0, len(h), 4096):
            part = h[i : i + 4096]
            with np.errstate(over="ignore"):
                bits = mix64(part[:, None] * spins[None, :]).astype(">u8")
                least = np.minimum(least, (part[:, None] * turns[None, :]).min(axis=0))
            ones += np.unpackbits(np.frombuffer(bits.tobytes(), np.uint8)).reshape(len(part), -1).sum(axis=0, dtype=np.int32)
        keys = np.zeros(BANDS, np.uint64)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                keys = mix64(keys * np.uint64(31) + least[r::ROWS]) + np.arange(BANDS, dtype=np.uint64)
        return np.packbits(2 * ones > len(h)).tobytes(), keys.view(np.int64), node

    def run(batches):
        for batch in batches:
            fps, keys, nodes = [], [], []
            for _, block in text_blocks(batch.column(at)):
                for t in block:
                    f, k, node = one(t)
                    fps.append(f)
                    keys.append(k)
                    nodes.append(node)
            thin = batch.drop_columns([batch.schema.names[at]])
            new = [pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*thin.columns, *new], names=[*thin.schema.names, "sh_fp", "sh_keys", "node"])

    return rows.mapInArrow(run, widened(rows.drop(text), {"sh_fp": "binary", "sh_keys": "array<long>", "node": "long"}))


def with_sets(rows: DataFrame, *, text: str = "sh_text", fp: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """(key, node, fp) of rows (key, node, fp, text), with the text's distinct shingles behind the fingerprint."""

    def run(batches):
        for batch in batches:
            out, prints = [], batch.column(2).to_pylist()
            for _, block in text_blocks(batch.column(3)):
                out += [prints[len(out) + i] + shingle_set(t, shingle).astype("<u8").tobytes() for i, t in enumerate(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "node", "fp"])

    return rows.select("key", "node", fp, text).mapInArrow(run, "key long, node long, fp binary")


def radius_of(similarity: float) -> int:
    """Bits by which fingerprints of texts of that resemblance differ: the mean, and three and a half standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WORDS
    return math.ceil(n * share + 3.5 * math.sqrt(n * share * (1 - share)))


def keep_first(docs: DataFrame, *, text: str = "text", key: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies: the smallest key, ties by hashes of key and text.

    Near copies resemble each other by ``similarity`` or more in their sets of five-word shingles.
    Wide fingerprints tell what may belong together, in components of which the shingles are then
    read again; only pairs whose sets resemble each other are linked. The choice is made on narrow
    rows; the wide rows are read again and joined to what is kept. Of repeated rows one stays.
    """
    a, b = F.xxhash64(F.col(key), F.col(text)).alias("sh_a"), F.hash(F.col(text)).alias("sh_b")  # together a row's identity
    rows = docs.select(F.col(key).alias("sh_key"), a, b, F.col(text).alias("sh_text"))
    prints = cut(wide_prints(rows, text="sh_text"))
    keyed = prints.select("node", "sh_fp", F.explode("sh_keys").alias("key")).groupBy("key", "node").agg(F.first("sh_fp").alias("fp"))
    radius = radius_of(similarity)
    near = cut(components(links(bounded_groups(keyed), radius)))
    one = F.min(F.struct("sh_a", "sh_b", "sh_fp")).alias("m")  # a row of each node
    asked = cut(prints.join(near, "node").groupBy("node", "root").agg(one).select(F.col("root").alias("key"), "node", "m.*"))
    texts = rows.join(asked.withColumnRenamed("sh_fp", "fp"), ["sh_a", "sh_b"]).select("key", "node", "fp", "sh_text")
    sets = cut(with_sets(texts).dropDuplicates(["node"]))
    found = components(links(bounded_groups(sets), radius, words=WORDS, similarity=similarity))
    first = F.min(F.struct(F.col("sh_key").isNull(), "sh_key", "sh_a", "sh_b")).alias("m")
    nodes = prints.groupBy("node").agg(first).join(found, "node", "left")
    kept = cut(nodes.groupBy(F.coalesce("root", "node")).agg(F.min("m").alias("m")).select("m.sh_a", "m.sh_b"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("sh_row"), a, b)  # so that no names clash
    return whole.join(kept, ["sh_a", "sh_b"], "left_semi").dropDuplicates(["sh_a", "sh_b"]).select("sh_row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(fingerprints(documents(spark, sf_dir).select("doc_id", "text")))
    return clusters(prints).select("doc_id", F.lower(F.lpad(F.hex("sh_fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}
