"""Exact removal of repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus. Equal
strings are brought together by content: of the ``GRAM``-byte strings inside every window of
``LENGTH`` bytes the one with the least hash is the window's anchor, so equal windows have equal
anchors at equal places. Each run of windows with one anchor is an occurrence: the anchor's hash,
a hash of the run's bytes and its place. Anchors that occur once are dropped by a count. Of
occurrences with equal bytes all but the first go whole. What is left are the first occurrences of
anchors whose surroundings differ, the edges of repeats: their bytes are gathered in shards by
anchor, sorted by Larsson-Sadakane refinement in numpy, and windows that share ``LENGTH`` bytes are
read off Kasai's common prefixes.

An anchor with more than ``VARIANTS`` surroundings, such as one near the end of a passage that
countless documents share, is narrowed before it reaches a shard: its surroundings are cut into
blocks of windows by the place of the anchor in them (``WIDTHS``), and a block's key is the string
that all windows of the block have in common. Equal windows lie in blocks of equal keys. Blocks
with equal bytes are again one and its copies, a key of one block has no repeats, and only keys
that still have too many blocks are cut further, down to blocks of one window, of which all with a
key are equal. A surrounding hands on a few blocks at each level, those where its passage ends,
whatever the number of its windows; and since a key's blocks are all in one shard, shards need no
search of each other, work that would grow with the square of the corpus.

Texts cross the network when edges are gathered and when results are written; the first pass reads
them in place. Hot passages only lengthen lists of narrow rows that are aggregated before they are
shuffled or joined in splittable parts.

Defined results. Null text: empty, nothing removed, the hash of no bytes. Texts under ``LENGTH``
bytes stay whole. Rows with equal id and text count as one document and each get its result. Rows
with equal id and different texts follow each other in an order by a hash of the text. Null ids
come last. Empty table: empty result. Only the id and the text are read, so other columns may have
any name, and none of them is in the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import Scratch, cut, documents, prefix_hash, span_hash, text_blocks

LENGTH = 100
GRAM = 24
BLOCK = 250_000  # bytes of texts hashed at once
CHUNK = 1 << 23  # windows of one text hashed at once
SHARD = 1_000_000  # bytes of a suffix array, beyond which the next shard starts another
VARIANTS = 2000  # surroundings of one key in a shard; memory is bounded by it and SHARD, results don't depend on it
WIDTHS = (20, 5, 1)  # windows of a block, level by level; each divides the one before
LAST = (1 << 63) - 1


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, hash of the run's bytes, first window, last window, anchor's offset) of every run of windows with one anchor."""
    sizes = np.array([len(t) for t in texts])
    raw = b"".join(texts)
    parts = []
    if len(texts) == 1 and len(raw) > CHUNK + LENGTH:
        for begin in range(0, len(raw) - LENGTH + 1, CHUNK):
            doc, h, c, lo, hi, at = anchors([raw[begin : begin + CHUNK + LENGTH - 1]])
            parts.append((doc, h, c, lo + begin, hi + begin, at))
        return tuple(np.concatenate(x) for x in zip(*parts))
    empty = np.zeros(0, np.int64)
    none = empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    if len(raw) < LENGTH:
        return none
    buf = np.frombuffer(raw, dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(buf, shape=(len(buf) - 7, 8), strides=(1, 1)).copy().view("<u8").ravel()
    m = len(buf) - GRAM + 1
    with np.errstate(over="ignore"):
        h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
        h += words[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += words[16 : 16 + m] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(m, dtype=np.uint64)  # the leftmost of equal ones
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    end = np.cumsum(sizes)
    whole = np.arange(len(anchor)) + LENGTH <= end[doc]  # windows inside one text
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])) & whole
    first = np.flatnonzero(new)
    if not len(first):
        return none
    owner = doc[first]
    last = np.append(first[1:], len(raw)) - 1
    last = np.minimum(last, end[owner] - LENGTH)
    context = span_hash(prefix_hash(buf), first, last + LENGTH)
    start = (end - sizes)[owner]
    return owner, h[anchor[first]], context, first - start, last - start, anchor[first] - first


def numbered(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """(u, key, text): each document with a number that grows in the order of ids, its id where ids are distinct.

    Otherwise distinct (id, text) pairs are ranked by a range sort and joined to the documents.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("k"), F.col(key).alias("key"), F.col(text).alias("text"))
    many = rows.groupBy("k").count().where("count > 1").limit(1).count()
    if not many:
        return rows.select(F.col("k").alias("u"), "key", "text")
    rows = rows.withColumn("t", F.coalesce(F.xxhash64("text"), F.lit(0)))
    pairs = rows.select("k", "t").distinct()
    ranks = cut(pairs.repartitionByRange("k", "t").sortWithinPartitions("k", "t").withColumn("u", F.monotonically_increasing_id()))
    return rows.join(ranks, ["k", "t"]).select("u", "key", "text")


def occurrences(rows: DataFrame) -> DataFrame:
    """(u, h, c, lo, more, at): lists of the runs of each document; a run has windows lo to lo + more, its anchor starts at lo + at."""
    names = ["u", "h", "c", "lo", "more", "at"]

    def run(batches):
        for batch in batches:
            for first, block in text_blocks(batch.column(1), BLOCK):
                doc, h, c, lo, hi, at = anchors(block)
                offsets = np.searchsorted(doc, np.arange(len(block) + 1)).astype(np.int32)
                values = (h.view(np.int64), c.view(np.int64), lo.astype(np.int32), (hi - lo).astype(np.int8), at.astype(np.int8))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in values]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), *lists], names=names)

    kinds = "u long, h array<long>, c array<long>, lo array<int>, more array<tinyint>, at array<tinyint>"
    return rows.select("u", "text").mapInArrow(run, kinds)


# --- suffix arrays of a shard ---------------------------------------------------------------------


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Larsson and Sadakane: sort by a short prefix, then sort groups that are still equal by the rank
    of what follows, doubling the length that is known; single suffixes are never touched again.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.as_strided(padded, shape=(n, 8), strides=(1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    # seven bytes and, for the last suffixes, how many there are: the end comes before any byte
    key = (key & ~np.uint64(0xFF)) | np.minimum(n - np.arange(n), 7).astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    lead = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    known = 7
    while True:
        single = lead & np.append(lead[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        at = order[open_]
        follows = np.where(at + known < n, rank[np.minimum(at + known, n - 1)] + 1, 0)
        pair = (rank[at] << 32) | follows
        turn = np.argsort(pair)
        order[open_] = at[turn]
        pair = pair[turn]
        lead[open_] = np.append(True, pair[1:] != pair[:-1])
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(lead[open_], np.arange(len(open_)), 0))]
        known *= 2


def common_prefixes(buf: np.ndarray, order: np.ndarray, most: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Kasai: lcp[i] is the common prefix, up to ``most``, of the suffixes at order[i - 1] and order[i].

    Each of the strings [start, end) walks through its own suffixes, all strings in step: the prefix
    of a suffix is at least that of the one before, less one.
    """
    n = len(buf)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    padded = np.concatenate([buf, np.full(most + 1, 0, np.uint8)])
    lcp = np.zeros(n, np.int64)
    now, have = starts.copy(), np.zeros(len(starts), np.int64)
    lane = np.arange(len(starts))
    while True:
        lane = lane[now[lane] < ends[lane]]
        if not len(lane):
            return lcp
        i = now[lane]
        p = place[i]
        j = order[np.maximum(p - 1, 0)]
        h = np.where(p > 0, have[lane], 0)
        grow = np.flatnonzero((p > 0) & (h < most))
        while len(grow):
            same = padded[i[grow] + h[grow]] == padded[j[grow] + h[grow]]
            same &= np.maximum(i[grow], j[grow]) + h[grow] < n
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most]
        lcp[p] = h
        have[lane] = np.maximum(h - 1, 0)
        now[lane] += 1


def repeats(contexts: list[bytes], u: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of some contexts: (context, offset, whether it is the first of its kind, class)."""
    sizes = np.array([len(c) for c in contexts])
    buf = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    end = np.cumsum(sizes)
    start = end - sizes
    order = suffix_array(buf)
    lcp = common_prefixes(buf, order, LENGTH, start, end - LENGTH + 1)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    window = order + LENGTH <= end[owner[order]]
    at = order[window]
    own = _class_of_windows(buf, at, lcp[window], window)
    doc = owner[at]
    off = at - start[doc]
    # runs of one document don't overlap, so contexts in order of place put their windows in order too
    place = np.empty(len(contexts), np.int64)
    place[np.lexsort((lo, u))] = np.arange(len(contexts))
    age = (place[doc] << 32) | off
    if not len(at):
        return doc, off, np.zeros(0, bool), own
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    oldest = np.repeat(np.minimum.reduceat(age, begins), np.diff(np.append(begins, len(own))))
    return doc, off, age == oldest, own


def _class_of_windows(buf: np.ndarray, at: np.ndarray, lcp: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Classes of windows in suffix order: a window belongs with the one before it if both share LENGTH bytes.

    Where nothing stands between the two, the common prefix says so; otherwise their bytes are compared, eight at a time.
    """
    place = np.flatnonzero(window)
    near = np.append(False, np.diff(place) == 1)
    same = near & (lcp >= LENGTH)
    asked = np.flatnonzero(~near)
    asked = asked[asked > 0]
    words = np.lib.stride_tricks.as_strided(buf, shape=(len(buf) - 7, 8), strides=(1, 1)).copy().view("<u8").ravel()
    for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        asked = asked[words[at[asked] + offset] == words[at[asked - 1] + offset]]
    same[asked] = True
    return np.cumsum(~same)


def shard_repeats(edges: DataFrame) -> DataFrame:
    """(u, lo, hi): repeated windows [lo, hi] of the edges (shard, u, lo, ctx), which are sorted by shard."""

    def solve(tables):
        t = pa.concat_tables(tables).combine_chunks()
        at = [t[c].to_numpy() for c in ("shard", "u", "lo")]
        again = np.append(False, np.logical_and.reduce([x[1:] == x[:-1] for x in at]))  # repeated rows
        t = t.filter(pa.array(~again)).combine_chunks() if again.any() else t
        u, lo = t["u"].to_numpy(), t["lo"].to_numpy().astype(np.int64)
        doc, off, first, _ = repeats(t["ctx"].to_pylist(), u, lo)
        turn = np.argsort((doc << 32) | off)
        doc, off, again = doc[turn], off[turn], ~first[turn]
        joint = again[:-1] & again[1:] & (doc[1:] == doc[:-1]) & (off[1:] == off[:-1] + 1)
        runs = np.flatnonzero(again & ~np.append(False, joint))
        stops = np.flatnonzero(again & ~np.append(joint, False))
        d = doc[runs]
        if len(d):
            columns = [pa.array(u[d]), pa.array((lo[d] + off[runs]).astype(np.int32)), pa.array((lo[d] + off[stops]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "lo", "hi"])

    def run(batches):
        held, size = [], 0  # whole shards, several to a suffix array
        for batch in batches:
            t = pa.Table.from_batches([batch])
            shard = t["shard"].to_numpy()
            if not len(shard):
                continue
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            fresh = bool(held) and held[-1]["shard"][-1].as_py() != shard[0]
            if size >= SHARD and fresh:
                yield from solve(held)
                held, size = [], 0
            elif size >= SHARD and len(starts) > 1:
                held.append(t.slice(0, starts[1]))
                yield from solve(held)
                t, held, size = t.slice(starts[1]), [], 0
            held.append(t)
            size += t["ctx"].nbytes
        if held:
            yield from solve(held)

    return edges.mapInArrow(run, "u long, lo int, hi int")


# --- blocks of windows ------------------------------------------------------------------------------

BLOCK_SCHEMA = "key long, s long, u long, lo int, more tinyint, at tinyint, ctx binary"
_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int8(), pa.binary()]


def blocks_of(u: int, lo: int, more: int, at: int, ctx: bytes, width: int):
    """A row for each block of ``width`` windows: its key, a hash of its bytes, and what they are.

    The windows begin at lo to lo + more, the anchor lies ``at`` bytes after the first of them; a
    window's block is the anchor's distance from its start, divided by ``width``.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for b in range((at - more) // width, at // width + 1):
        near, far = b * width, min((b + 1) * width, LENGTH - GRAM + 1) - 1
        first, last = at - min(at, far), at - max(at - more, near)
        core, own = ctx[at - near : at - far + LENGTH], ctx[first : last + LENGTH]
        place = at - first
        yield signed(xxhash.xxh64_intdigest(core, b)), signed(xxhash.xxh64_intdigest(own, place)), u, lo + first, last - first, place, own


def as_batches(rows, names, types, most: int = 4_000_000):
    """Batches of rows whose last column, of bytes, decides their size."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1]) + 40
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """The blocks of ``width`` windows of rows (u, lo, more, at, ctx)."""

    def run(batches):
        for batch in batches:
            each = zip(*(batch.column(i).to_pylist() for i in range(5)))
            yield from as_batches((b for row in each for b in blocks_of(*row, width)), _NAMES, _TYPES)

    return rows.select("u", "lo", "more", "at", "ctx").mapInArrow(run, BLOCK_SCHEMA)


def first_of_each(rows: DataFrame, keys: list[str], rest: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The first row (by u, lo) of each kind, and the windows (u, lo, hi) of all others, which are copies of it."""
    firsts = rows.groupBy(*keys).agg(F.min(F.struct("u", "lo", *rest)).alias("f"), F.count("*").alias("n"))
    firsts = scratch.keep(firsts.select(*keys, "f.*", "n"), f"{name}-firsts")
    several = firsts.where("n > 1").select(*keys, F.col("u").alias("fu"), F.col("lo").alias("flo"))
    others = rows.join(several.hint("shuffle_hash"), keys).where("u <> fu or lo <> flo")
    copies = others.select("u", "lo", (F.col("lo") + F.col("more")).alias("hi"))
    return firsts.drop("n"), scratch.keep(copies, f"{name}-copies")


def narrowed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Blocks that fit shards (shard, u, lo, ctx), and repeated windows found on the way, of blocks of the first width."""
    fit, copies = [], []
    for level, width in enumerate(WIDTHS):
        firsts, others = first_of_each(rows, ["key", "s"], ["more", "at", "ctx"], scratch, f"level-{level}")
        copies.append(others)
        kinds = firsts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")  # one window: always one kind
        firsts = firsts.join(kinds, "key")
        fit.append(firsts.where(F.col("kinds") <= VARIANTS).select(F.col("key").alias("shard"), "u", "lo", "ctx"))
        if width == 1:
            break
        rows = scratch.keep(blocks(firsts.where(F.col("kinds") > VARIANTS), WIDTHS[level + 1]), f"level-{level + 1}")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, fit), copies


# --- the whole -------------------------------------------------------------------------------------


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(u, spans): for each document of ``rows`` (u, text) that loses bytes, runs [lo, hi] of repeated windows."""
    scratch = Scratch(rows.sparkSession)
    runs = scratch.keep(occurrences(rows), "runs")
    runs = runs.select("u", F.explode(F.arrays_zip("h", "c", "lo", "more", "at")).alias("r")).select("u", "r.*")
    counted = scratch.keep(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "counted")
    hits = scratch.keep(runs.join(counted.hint("shuffle_hash"), "h"), "hits")
    scratch.drop("runs", "counted")
    firsts, copied = first_of_each(hits, ["h", "c"], ["more", "at"], scratch, "runs")
    scratch.drop("hits")

    # the edges: first occurrences of anchors with several surroundings
    spread = firsts.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1")
    edge = firsts.join(spread, "h").select("u", "lo", "more", "at", "h", (F.col("variants") > VARIANTS).alias("hot"))
    wanted = scratch.keep(edge.groupBy("u").agg(F.collect_list(F.struct("lo", "more", "at", "h", "hot")).alias("e")), "wanted")
    texts = rows.select("u", "text").join(wanted.hint("shuffle_hash"), "u")

    def contexts(batches):
        def each(batch):
            for u, t, e in zip(*(batch.column(i) for i in range(3))):
                raw, u = t.as_buffer().to_pybytes(), u.as_py()
                for x in e.as_py():
                    ctx = raw[x["lo"] : x["lo"] + x["more"] + LENGTH]
                    if x["hot"]:
                        for b in blocks_of(u, x["lo"], x["more"], x["at"], ctx, WIDTHS[0]):
                            yield True, *b
                    else:
                        yield False, x["h"], 0, u, x["lo"], x["more"], x["at"], ctx

        for batch in batches:
            yield from as_batches(each(batch), ["hot", *_NAMES], [pa.bool_(), *_TYPES])

    gathered = scratch.keep(texts.mapInArrow(contexts, f"hot boolean, {BLOCK_SCHEMA}"), "gathered")
    hot = gathered.where("hot").drop("hot")
    shards, found = gathered.where("not hot").select(F.col("key").alias("shard"), "u", "lo", "ctx"), [copied]
    if not hot.isEmpty():
        more_shards, more_found = narrowed(hot, scratch)
        shards, found = shards.unionByName(more_shards), found + more_found
    solved = scratch.keep(shard_repeats(shards.repartition("shard").sortWithinPartitions("shard", "u", "lo")), "solved")
    spans = reduce(DataFrame.unionByName, [*found, solved])
    return scratch.keep(spans.groupBy("u").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def removed_bytes(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes [start, end) that the repeated windows [lo, hi] cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def strip_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sx_kept, n_bytes, n_removed, n_spans): what is left of each text, as bytes."""
    rows = numbered(docs, key=key, text=text)
    spans = repeated_spans(rows)
    rows = rows.join(spans.hint("shuffle_hash"), "u", "left").select("key", "text", "spans")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for t, s in zip(batch.column(1), batch.column(2)):
                raw = t.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                gone = removed_bytes([(x["lo"], x["hi"]) for x in s.as_py()]) if s.is_valid else []
                at, left = 0, []
                for a, b in gone:
                    left.append(raw[at:a])
                    at = b
                for o, v in zip(out, (b"".join([*left, raw[at:]]), len(raw), sum(b - a for a, b in gone), len(gone))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), *(pa.array(o, pa.int64()) for o in out[1:])], names=[key, "sx_kept", "n_bytes", "n_removed", "n_spans"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("sx_kept", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))])
    return rows.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("sx_kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
SQL: dict[str, str] = {}
