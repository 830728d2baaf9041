"""Embedding near-duplicates by sorted projection passes.

Each pass sorts the distinct vectors lexicographically by the concatenated signs of random
projections and compares every vector with its next ``WINDOW`` neighbours; pairs whose cosine
reaches the threshold in double precision are verified links, and components are the union of the
links of all passes. Passes carry vectors rounded to 16 bits a component: a bound on the rounding
says for nearly all pairs on which side of the threshold they lie, and the vectors themselves are
fetched for the few that it leaves open. The number of passes grows with that of distinct vectors, see ``passes_of``,
and with their density, which the first passes measure, see ``passes_for``. Tasks sort ranges; vectors at their borders meet in a second step. Passes find what belongs
together; the links of a component are then counted whole, without listing pairs: members within
half the threshold's angle of the component's first vector are all linked with each other (angles
obey the triangle inequality), and only the others are compared, in blocks, with all members.

Defined results. Null, empty or zero vectors and those with null or non-finite components link
with nothing; each is its own component. Vectors of different lengths never link. Copies are one
node that carries its count, so a vector that a third of the rows share is compared once; a null
vec_id gets its links, and is last when a component's smallest id is chosen (null if all are).
Repeated rows are separate vectors. Empty table: empty result. Other columns play no part.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import components, cut, forest

PASSES = 4  # at least
TOGETHER = 6  # passes in one shuffle
WINDOW = 512  # compared as blocks of products of matrices; a wider one takes fewer passes, each of which shuffles all vectors
RECALL = 0.99  # of pairs at the threshold, which decides the number of passes
CROWDED, CROWDED_RECALL = 0.01, 0.95  # outside the densest hundredth of the vectors, of pairs wherever they lie
BITS = 60
PART = 1024  # members in a block of comparisons
FINEST = 32767  # the largest component of a rounded vector
BROADCAST_ROWS = 200_000  # pairs left open by rounding, of 16 bytes, up to which they are broadcast to the vectors


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of an Arrow column of lists that all have ``dim`` values."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rounded(x: np.ndarray) -> pa.Array:
    """Unit vectors as 16-bit whole numbers, the largest component of each at ``FINEST``."""
    q = np.ascontiguousarray(np.rint(x * (FINEST / np.abs(x).max(axis=1, keepdims=True))).astype("<i2"))
    ends = np.arange(len(x) + 1, dtype=np.int32) * (2 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(q)])


def unrounded(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of ``rounded`` ones of ``dim`` components, and how far at most each lies from the vector that was rounded.

    A component is off by half a unit, a vector of length one by half the root of ``dim`` over the
    rounded vector's length; both being made unit vectors again at most doubles that.
    """
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    q = np.frombuffer(column.buffers()[2], "<i2", len(column) * dim, int(first)).reshape(-1, dim).astype(np.float64)
    size = np.sqrt((q * q).sum(axis=1))
    return q / size[:, None], math.sqrt(dim) / size * (1 + 1e-6) + 1e-9


def projections(dim: int, turn: int) -> np.ndarray:
    return np.random.default_rng([turn, dim]).standard_normal((dim, BITS))


def passes_of(n: int, least: float = 0.9, window: int = WINDOW) -> int:
    """Passes that bring ``RECALL`` of the pairs at the threshold together among ``n`` vectors spread evenly.

    A sign is equal for two vectors in the share of their angle that is left of a half turn, and a
    window holds all vectors that agree in the first log2(n / window) signs.
    """
    one = (1 - math.acos(least) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if one >= 1 else max(PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - one)))


def passes_for(shared: dict[int, int], least: float = 0.9) -> int:
    """Passes that bring pairs at the threshold together among vectors of measured density.

    ``shared`` counts vectors by the signs that they have in common with the last one of their
    window: a pair that agrees in one more surely meets. ``RECALL`` holds on average, and
    ``CROWDED_RECALL`` for all vectors but the most crowded share ``CROWDED``.
    """
    bits = np.array(sorted(shared), dtype=np.int64)
    n = np.array([shared[b] for b in bits], dtype=np.float64)
    if not n.sum():
        return 0
    miss = 1 - (1 - math.acos(least) / math.pi) ** (bits + 1.0)
    beyond = np.append(np.cumsum(n[::-1])[::-1][1:], 0)  # more crowded ones
    crowded = miss[np.argmax(beyond <= CROWDED * n.sum())]
    few = lambda k: (n @ miss**k) / n.sum() <= 1 - RECALL and crowded**k <= 1 - CROWDED_RECALL
    most = 1
    while not few(most):
        most *= 2
    return bisect.bisect_left(range(1, most + 1), True, key=few) + 1


def valid(vector: str = "embedding"):
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def sort_keys(nodes: DataFrame, turns: range) -> DataFrame:
    """(turn, dim, key, node, v): one row of each node, its vector rounded, for each pass of ``turns``."""

    def run(batches):
        for batch in batches:
            node, v = batch.column(0), batch.column(1)
            dims = v.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own_node, own = node.take(pa.array(at)), v.take(pa.array(at))
                x = matrix(own, int(dim))
                q = rounded(x)
                for turn in turns:
                    key = ((x @ projections(int(dim), turn)) > 0).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, turn, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(key), own_node, q], names=["turn", "dim", "key", "node", "v"])

    return nodes.select("node", "v").mapInArrow(run, "turn int, dim int, key long, node long, v binary")


def window_links(keyed: DataFrame, least: float, window: int, measured: bool = True) -> DataFrame:
    """(a, b): pairs within the window of a pass that surely link; a batch hands on a spanning forest of them.

    Pairs that rounding leaves open are marked in ``ask``, each of them handed on. Further rows (part, i, e, turn, dim, node, v) are the first and last ``window`` rows of each
    partition, i rows from its start and e from its end. Rows (shared, n) count, among vectors
    without a link in their window, those that share so many leading signs with its last one.
    """
    ends = ["turn", "dim", "node", "v"]
    names = ["a", "b", "ask", "part", "i", "e", *ends, "shared", "n"]

    def edge_rows(head, last, n):
        i = np.concatenate([np.arange(len(head)), np.arange(max(len(head), n - len(last)), n)]).astype(np.int32)
        t = pa.concat_tables([head, last.slice(len(last) - (len(i) - len(head)))]).combine_chunks()
        part = np.full(len(i), TaskContext.get().partitionId(), np.int32)
        none = pa.nulls(len(i), pa.int64())
        for b in t.to_batches():
            ask = pa.nulls(len(i), pa.bool_())
            yield pa.RecordBatch.from_arrays([none, none, ask, pa.array(part), pa.array(i), pa.array(n - 1 - i, pa.int32()), *b.columns, none, none], names=names)

    def run(batches):
        tail: tuple | None = None  # the last rows of what came before
        head, last, n = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            own = pa.Table.from_batches([batch]).select(ends)
            head = own.slice(0, window) if head is None else pa.concat_tables([head, own.slice(0, window - len(head))])
            last = own if last is None else pa.concat_tables([last, own])
            last, n = last.slice(max(0, len(last) - window)), n + len(batch)
            turn, dim, key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            left, right, open_left, open_right, at, shared = [], [], [], [], 0, np.zeros(BITS + 1, np.int64)
            while at < len(node):  # runs of one pass and length
                other = np.flatnonzero((turn[at:] != turn[at]) | (dim[at:] != dim[at]))
                end = at + int(other[0]) if len(other) else len(node)
                x, off = unrounded(batch.column(4).slice(at, end - at), int(dim[at]))
                ids, keys, alone = node[at:end], key[at:end], np.ones(end - at, bool)
                if tail is not None and tail[0] == (turn[at], dim[at]):
                    x, off, ids, keys, alone = (np.concatenate(c) for c in zip(tail[1:], (x, off, ids, keys, alone)))
                slack = 2 * off.max()
                for s in range(0, len(ids), window):
                    cosine = x[s : s + window] @ x[s : s + 2 * window].T
                    i, j = np.nonzero(cosine >= least - slack)
                    near = (j > i) & (j <= i + window)
                    i, j = i[near], j[near]
                    c, room = cosine[i, j], off[s + i] + off[s + j]
                    sure, can = c - room >= least, c + room >= least
                    alone[s + i[can]] = alone[s + j[can]] = False
                    a, b = forest(ids[s + i[sure]], ids[s + j[sure]])
                    left.append(a)
                    right.append(b)
                    open_left.append(ids[s + i[can & ~sure]])
                    open_right.append(ids[s + j[can & ~sure]])
                if measured:
                    differ = (keys[:-window] ^ keys[window:])[alone[:-window]]
                    shared += np.bincount(BITS - np.frexp(differ.astype(np.float64))[1], minlength=BITS + 1)[: BITS + 1]
                tail = ((turn[at], dim[at]), x[-window:], off[-window:], ids[-window:], keys[-window:], alone[-window:])
                at = end
            if left:
                a, b = forest(np.concatenate(left), np.concatenate(right))
                bits = np.flatnonzero(shared)
                asks, counts = sum(map(len, open_left)), len(bits)
                a, b = np.concatenate([a, *open_left]), np.concatenate([b, *open_right])
                rows, links = len(a) + counts, len(a)
                ask = np.arange(rows) >= links - asks
                more = [pa.nulls(rows, own.schema.field(c).type) for c in ends]
                pair = [pa.array(np.append(c, bits), pa.int64(), mask=np.arange(rows) >= links) for c in (a, b)]
                count = [pa.array(np.append(a, c), pa.int64(), mask=np.arange(rows) < links) for c in (bits, shared[bits])]
                marks = pa.array(ask, mask=np.arange(rows) >= links)
                yield pa.RecordBatch.from_arrays([*pair, marks, *[pa.nulls(rows, pa.int32())] * 3, *more, *count], names=names)
        if n:
            yield from edge_rows(head, last, n)

    return keyed.mapInArrow(run, "a long, b long, ask boolean, part int, i int, e int, turn int, dim int, node long, v binary, shared long, n long")


def border_rows(edges: DataFrame, passes: int, window: int) -> DataFrame:
    """Rows as of ``sort_keys`` with a turn for each border of partitions, around which up to ``window`` rows of each side lie.

    Where a partition has fewer rows than that, those beyond it come too.
    """
    sizes = sorted((r.part, r.n) for r in edges.groupBy("part").agg(F.max(F.col("i") + F.col("e") + 1).alias("n")).collect())
    places = []  # part, border, side, rows between them
    for border in range(1, len(sizes)):
        for side, parts in ((1, sizes[border:]), (0, sizes[border - 1 :: -1])):
            between = 0
            for part, n in parts:
                if between >= window:
                    break
                places.append((part, border, side, between))
                between += n
    places = edges.sparkSession.createDataFrame(places, "part int, border int, side int, between int")
    own = F.col("between") + F.when(F.col("side") == 1, F.col("i")).otherwise(F.col("e"))
    rows = edges.join(F.broadcast(places), "part").where(own < window)  # a few rows for each partition
    key = F.when(F.col("side") == 1, own).otherwise(-1 - own).cast("long")
    return rows.select((F.col("border") * passes + F.col("turn")).alias("turn"), "dim", key.alias("key"), "node", "v")


def cosine(a: str, b: str) -> Column:
    """The cosine of two columns of vectors in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def verified(asked: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ``asked`` that link by the vectors of their nodes."""
    ids = asked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = F.broadcast(ids) if asked.count() <= BROADCAST_ROWS else ids
    vectors = cut(nodes.select("node", "v").join(ids, "node", "left_semi"))
    of = lambda c: vectors.select(F.col("node").alias(c), F.col("v").alias(f"v{c}"))
    return asked.join(of("a"), "a").join(of("b"), "b").where(cosine("va", "vb") >= least).select("a", "b")


def pass_links(nodes: DataFrame, turns: range, least: float, window: int, parts: int) -> DataFrame:
    """(a, b): the links that some passes find, whatever the number of partitions; and (shared, n) as of ``window_links``."""
    order = ["turn", "dim", "key", "node"]
    keyed = sort_keys(nodes, turns).repartitionByRange(parts, *order)
    found = cut(window_links(keyed.sortWithinPartitions(*order), least, window))
    borders = border_rows(found.where("part is not null"), turns.stop, window)
    across = window_links(borders.repartition(max(1, parts), "turn").sortWithinPartitions(*order), least, window, measured=False)  # their keys are places
    both = cut(found.unionByName(across).where("a is not null or shared is not null").select("a", "b", "ask", "shared", "n"))
    out = both.where("ask is null or not ask").select("a", "b", "shared", "n")
    asked = cut(both.where("ask").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if asked.isEmpty():
        return out
    return out.unionByName(verified(asked, nodes, least), allowMissingColumns=True)


def block_counts(blocks: DataFrame, least: float) -> DataFrame:
    """(node, n): weights of links found in blocks of rows (g, outer, node, weight, v), sorted by g.

    A block holds members and, as outer rows, members outside the core. An outer row counts all members
    that it links with; a member of the core, marked by a negative weight, counts the outer rows, as
    the rest of its core is counted without comparison.
    """

    def count(outer, node, weight, rows):
        x = matrix(rows, len(rows[0]))
        o, m = np.flatnonzero(outer), np.flatnonzero(~outer)
        if not len(o) or not len(m):
            return None
        inner_core = weight[m] < 0
        linked = (x[o] @ x[m].T >= least) & (node[o][:, None] != node[m][None, :])
        w = np.abs(weight)
        back = linked[:, inner_core].T @ w[o]
        return np.concatenate([node[o], node[m][inner_core]]), np.concatenate([linked @ w[m], back])

    def run(batches):
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            t = t.combine_chunks()
            g = t["g"].to_numpy()
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
            for a, b in zip(starts[:-1], starts[1:]):
                yield from emit(t.slice(a, b - a))
            kept = t.slice(starts[-1]) if len(starts) else None
        if kept is not None:
            yield from emit(kept)

    def emit(t):
        got = count(t["outer"].to_numpy(), t["node"].to_numpy(), t["weight"].to_numpy(), t["v"].combine_chunks())
        if got is not None:
            node, n = got
            use = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(n[use].astype(np.int64))], names=["node", "n"])

    return blocks.mapInArrow(run, "node long, n long")


def near_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col(key).alias("k"), F.col(vector).cast(kind).alias("v"))
    rows = rows.withColumn("ok", valid("v"))
    for seed in range(100):  # a node's number is a hash of its vector, under which no two vectors are equal
        rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("v", F.lit(seed))))
        check = F.xxhash64(F.lit(seed), "v")
        one = [F.count("*").alias("copies"), F.min("k").alias("least"), F.first("v").alias("v"), F.min(check).alias("c"), F.max(check).alias("d")]
        nodes = cut(rows.where("ok").groupBy("node").agg(*one))
        if nodes.where("c <> d").isEmpty():
            break
    nodes = nodes.drop("c", "d")
    n = nodes.count()
    fixed, passes = passes is not None, passes or passes_of(n, least, window)
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, shared, done = None, Counter(), 0
    while done < passes:
        turns = range(done, min(passes, done + TOGETHER))  # a shuffle has so many copies of the vectors, however many passes there are
        parts = max(1, min(most, n * len(turns) // (8 * window)))  # ranges of several windows
        some = pass_links(nodes, turns, least, window, parts)
        for r in some.where("shared is not null").groupBy("shared").agg(F.sum("n").alias("n")).collect():  # at most BITS + 1 rows
            shared[r.shared] += r.n
        found = some if found is None else found.unionByName(some)
        done = turns.stop
        passes = passes if fixed else max(passes, passes_for(shared, least))
    comp = cut(components(found))

    # whole counts in each component of two or more nodes
    members = cut(comp.join(nodes, "node"))
    first = members.where("node = root").select("root", F.col("v").alias("c"))
    core = cosine("v", "c") >= math.cos(math.acos(least) / 2) + 1e-9
    members = cut(members.join(first, "root").select("root", "node", "copies", "least", "v", core.alias("core")))
    per = members.groupBy("root").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"),
        F.count("*").alias("n"), F.count_if(~F.col("core")).alias("n_out"), F.min("least").alias("component_id"),
    )
    per = cut(per)
    blocks = lambda c: F.ceil(F.col(c) / PART).cast("int")
    odd = members.join(per.where("n_out > 0").select("root", blocks("n").alias("gi"), blocks("n_out").alias("gj")), "root")
    part = lambda c: F.pmod(F.xxhash64("node", F.lit("part")), F.col(c)).cast("int")
    weight = F.when(F.col("core"), -F.col("copies")).otherwise(F.col("copies"))
    inner = odd.withColumns({"i": part("gi"), "j": F.explode(F.sequence(F.lit(0), F.col("gj") - 1)), "outer": F.lit(False)})
    outer = odd.where("not core").withColumns({"j": part("gj"), "i": F.explode(F.sequence(F.lit(0), F.col("gi") - 1)), "outer": F.lit(True)})
    both = inner.unionByName(outer).select(F.xxhash64("root", "i", "j").alias("g"), "outer", "node", weight.alias("weight"), "v")
    counted = block_counts(both.repartition("g").sortWithinPartitions("g"), least).groupBy("node").agg(F.sum("n").alias("more"))
    out = members.join(per.select("root", "core_copies", "component_id"), "root").join(counted, "node", "left")
    links = F.col("copies") - 1 + F.coalesce("more", F.lit(0)) + F.when(F.col("core"), F.col("core_copies") - F.col("copies")).otherwise(0)
    out = out.select("node", links.alias("n_links"), "component_id")
    single = nodes.join(comp, "node", "left_anti").select("node", (F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    result = rows.select("k", "node").join(cut(out.unionByName(single)), "node", "left")
    result = result.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op3_embeddings": op3_embeddings}
SQL: dict[str, str] = {}
