"""Lexical retrieval packing.

Documents become token ids and are laid into windows of ``window`` ids. Whole windows of a long
document stand alone; what is left of each document, its tail, is packed: a seed tail opens a
window, a BM25 index over the documents of its shard returns unused neighbours by the words that
they share, and these fill the window in order of score; the last is cut where the window ends and
its rest stays available. A seed asks with all its words, told apart by 64-bit hashes, but for
those that are in no other document and stop words, in over ``COMMON`` of all documents. The
document frequencies and the mean length that BM25 needs are those of the whole corpus; they are
counted over ``TERMS`` buckets of hashed words, a fixed 4 MB that is broadcast, so words of one
bucket have one weight.

Shards are by content, not by where documents lie: a document goes where the word with the least
hash among its words goes, stop words left out, so that two documents meet with a chance equal to
the share of their words that both have. A word that many documents go by is cut into splits of
about half a task's share, and into as many more as a document is longer than the mean: very long
ones have most words and would all go by the same. In a task, documents with the same word stand together, and each run of at
most ``SHARD_DOCS`` documents or ``SHARD_TOKENS`` ids is a shard with its own inverted index, so
memory is bounded and a lost task repeats alone. A shard's last window, if not full, is divided
into runs of a power of two, which need no padding.

Ids equal those of the ``tokenizers`` vocabulary file; they are made by ``tiktoken`` from the same
vocabulary's rank file, several times faster. A text that spells out the special token, which
``tokenizers`` reads as that token, goes to ``tokenizers`` itself.

Defined results. Null text: empty, one id (the end mark). Repeated rows are packed each, and so are
rows of a null or repeated id, which the length of their text and its place tell apart. Equal scores:
the earlier in the shard. Very long texts are streamed through whole windows. Empty table: no
pieces. Other columns play no part.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import documents, joined_word_hashes, mix64, text_blocks

WINDOW = 2048
END = 1
TERMS = 1 << 19
COMMON, AT_LEAST = 0.05, 16  # a stop word is in more than this share of documents, and in more than so many
SHARD_DOCS = 4096
SHARD_TOKENS = 6_000_000
NEIGHBOURS = 32
K1, B = 1.2, 0.75
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str):
    """text -> ids as unsigned 16-bit, equal to tokenizers' ``encode(text, add_special_tokens=False)``."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def encode(text: str) -> np.ndarray:
        ids = exact().encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
        out = np.empty(len(ids) + 1, dtype=np.uint16)
        out[:-1] = ids
        out[-1] = END
        return out

    return encode


def bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - (TERMS - 1).bit_length())).astype(np.int64)


def corpus_statistics(docs: DataFrame, *, text: str = "text") -> tuple[np.ndarray, np.ndarray, int, float]:
    """idf of each bucket of words (0: of no use), its document frequency, the number of documents and their mean number of words."""

    def count(batches):
        df, n, total = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            for _, block in text_blocks(batch.column(0), 200_000):
                words, doc = joined_word_hashes(block)
                n += len(block)
                total += len(words)
                pair = np.sort(doc * TERMS + bucket(words))
                df += np.bincount(pair[np.append(True, pair[1:] != pair[:-1])] % TERMS if len(pair) else pair, minlength=TERMS)
        at = np.flatnonzero(df)
        columns = [np.concatenate([at, [-1, -2]]).astype(np.int32), np.concatenate([df[at], [n, total]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "n"])

    table = docs.select(F.col(text).alias("t")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = table["term"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(TERMS)
    df[term[term >= 0]] = n[term >= 0]
    total = int(n[term == -1].sum())
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    idf[(df < 2) | (df > max(COMMON * total, AT_LEAST))] = 0
    return idf.astype(np.float32), df.astype(np.int64), total, float(n[term == -2].sum()) / max(total, 1)


def by_content(rows: DataFrame, shared, parts: int) -> DataFrame:
    """``rows`` (k, t) dealt to tasks, and in them in order, by the least-hashed word of their text."""

    @F.arrow_udf("struct<word:long,splits:int>")
    def lead(texts: pa.Array) -> pa.Array:
        idf, df, total, mean = shared.value
        words_out, splits_out = [], []
        for _, block in text_blocks(texts, 200_000):
            words, doc = joined_word_hashes(block)
            size = np.maximum(np.bincount(doc, minlength=len(block)) / max(mean, 1.0), 1.0)
            of = bucket(words)
            use = idf[of] > 0
            words, doc, of = mix64(words[use]), doc[use], of[use]
            least = np.full(len(block), np.uint64((1 << 64) - 1))
            np.minimum.at(least, doc, words)
            splits = np.zeros(len(block), np.int32)
            chosen = words == least[doc]
            splits[doc[chosen]] = np.ceil(df[of[chosen]] * size[doc[chosen]] * (2 * parts / max(total, 1))).astype(np.int32)
            words_out.append(least.view(np.int64))
            splits_out.append(splits)
        columns = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((words_out, np.int64), (splits_out, np.int32))]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["word", "splits"])

    own = F.xxhash64("k", "t")  # of documents without such words, and of the split
    rows = rows.withColumn("lead", lead("t")).withColumn("own", own)
    word = F.when(F.col("lead.splits") > 0, F.col("lead.word")).otherwise(F.col("own"))
    split = F.when(F.col("lead.splits") > 0, F.pmod("own", F.col("lead.splits").cast("long"))).otherwise(F.lit(0).cast("long"))
    rows = rows.select("k", "t", word.alias("word"), split.alias("split"), "own")
    return rows.repartition("word", "split").sortWithinPartitions("word", "own", "k", "t").select("k", "t")


class Shard:
    """A BM25 inverted index over some documents and the tails that are still unused."""

    def __init__(self, texts: list[bytes], idf: np.ndarray, mean: float):
        self.n = len(texts)
        found, length, first_doc, block, size = [], np.zeros(self.n, np.float32), 0, [], 0
        for i, t in enumerate([*texts, None]):  # in blocks that stay in cache
            if block and (t is None or size + len(t) > 200_000):
                words, doc = joined_word_hashes(block)
                doc = doc + first_doc
                length += np.bincount(doc, minlength=self.n)
                weight = idf[bucket(words)]
                use = weight > 0
                found.append((words[use], doc[use], weight[use]))
                first_doc, block, size = i, [], 0
            if t is not None:
                block.append(t)
                size += len(t)
        words, doc, weight = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        order = np.argsort(words, kind="stable")  # documents stay in order
        words, doc, weight = words[order], doc[order], weight[order]
        new = np.append(True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])) if len(words) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(words))).astype(np.float32)
        words, doc, weight = words[first], doc[first], weight[first]
        lead = np.append(True, words[1:] != words[:-1]) if len(words) else np.zeros(0, bool)
        term = np.cumsum(lead) - 1
        shared = np.bincount(term, minlength=1)[term] > 1 if len(term) else lead  # a word of one document finds no other
        term, doc, tf, weight = term[shared], doc[shared], tf[shared], weight[shared]
        self.doc = doc
        self.impact = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1.0)))
        lead = np.append(True, term[1:] != term[:-1]) if len(term) else np.zeros(0, bool)
        self.at = np.append(np.flatnonzero(lead), len(term))  # where each word's documents begin
        slot = np.cumsum(lead) - 1
        order = np.argsort(doc, kind="stable")
        self.query = slot[order]  # the words of each document
        self.asks = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.n))]) if len(doc) else np.zeros(self.n + 1, np.int64)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The best-scoring unused documents for a seed, best first; ties by position."""
        slot = self.query[self.asks[seed] : self.asks[seed + 1]]
        if not len(slot):
            return slot
        start, count = self.at[slot], self.at[slot + 1] - self.at[slot]
        hits = np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)
        score = np.bincount(self.doc[hits], self.impact[hits], minlength=self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > NEIGHBOURS:
            found = found[np.argpartition(-score[found], NEIGHBOURS)[:NEIGHBOURS]]
        return found[np.lexsort((found, -score[found]))]


def pack_shard(lengths: np.ndarray, index: Shard, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces that hold every id once. The last, if not full, is cut at powers of two."""
    out = [[(d, s, window)] for d, n in enumerate(lengths) for s in range(0, int(n) // window * window, window)]
    start = lengths // window * window
    rest = lengths - start
    unused = rest > 0
    nxt = 0
    while True:
        while nxt < len(rest) and not unused[nxt]:
            nxt += 1
        if nxt == len(rest):
            return out
        seed, room, pieces = nxt, window, []
        queue = [seed]
        while room:
            if not queue:
                queue = list(index.neighbours(seed, unused))
                if not queue:
                    while nxt < len(rest) and not unused[nxt]:
                        nxt += 1
                    if nxt == len(rest):
                        break
                    queue = [nxt]
            d = int(queue.pop(0))
            take = min(room, int(rest[d]))
            pieces.append((d, int(start[d]), take))
            start[d] += take
            rest[d] -= take
            room -= take
            unused[d] = rest[d] > 0
        out += [pieces] if not room else powers(pieces)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a run of pieces into runs whose lengths are falling powers of two."""
    total, out, queue = sum(p[2] for p in pieces), [], list(pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        run = []
        while size:
            d, s, n = queue.pop(0)
            take = min(n, size)
            run.append((d, s, take))
            size -= take
            if take < n:
                queue.insert(0, (d, s + take, n - take))
        out.append(run)
    return out


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row for each piece; with ``with_ids`` its ids as little-endian unsigned 16-bit."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(corpus_statistics(docs, text=text))  # TERMS numbers, whatever the corpus
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[key].dataType
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches):
        encode = encoder(vocabulary, ranks)
        idf, _, _, mean = shared.value
        sequence = TaskContext.get().partitionId() << 32
        held_key, held_ids, held_text, size = [], [], [], 0

        def flush():
            nonlocal sequence
            lengths = np.array([len(i) for i in held_ids], dtype=np.int64)
            rows = []
            for run in pack_shard(lengths, Shard(held_text, idf, mean), window):
                offset = 0
                for d, s, n in run:
                    ids = held_ids[d][s : s + n]
                    rows.append((held_key[d], s, n, zlib.crc32(ids.astype("<u4").tobytes()), int(lengths[d]), sequence, offset, *([ids.tobytes()] if with_ids else [])))
                    offset += n
                sequence += 1
            cols = list(zip(*rows))
            types = [key_type, *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py() or ""
                held_key.append(k.as_py())
                held_ids.append(encode(t))
                held_text.append(t.encode())
                size += len(held_ids[-1])
                if len(held_key) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    yield from flush()
                    held_key, held_ids, held_text, size = [], [], [], 0
        if held_key:
            yield from flush()

    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in names[1:7]), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return by_content(rows, shared, int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
