"""Secrets, judged by corpus-wide ownership frequency.

Three base kinds follow fixed formats and always stand. A generator adds long tokens of mixed
characters and known prefixes as candidates. For every candidate value a hash is counted over the
corpus by distinct repositories and distinct owners: a value that many unrelated owners carry is
a copied example, one of few owners looks live. Added spans are the live-looking ones; counts of
live and example values are given for all kinds.

Here a repository is a document's ``source``; an owner is a document by its content, so that exact
copies of a file are one owner. Both columns are parameters.

Defined results. Null text: no spans. A null repository is one of its own. Repeated rows are
scanned each and are one owner. Empty table: empty result. Matching is linear in a text's length,
but for a binary search for each span. A column named like one of the result (s_assign, s_access,
s_hex, s_base_sha256, s_spans, s_live, s_example) is replaced by it; others are passed on.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import Taken, cut, documents, widened, without

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key")
EXAMPLE_OWNERS = 3  # from this many owners on, in this many repositories, a value is a copied example
EXAMPLE_REPOS = 3

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_PREFIX = re.compile(r"(?:gh[pousr]_|github_pat_|sk_live_|rk_live_|xox[abprs]-|glpat-|eyJ|AIza|ya29)")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign", m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.group()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m.group()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2]), s[1]))


def added_candidates(text: str, base: list) -> list[tuple[int, int, str, str]]:
    """Long tokens that look random, outside base spans."""
    if not any(len(w) >= 20 for w in text.split()):
        return []
    out, taken = [], Taken(base)
    for m in _LONG.finditer(text):
        s = m.group()
        mixed = any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and len(set(s)) >= 12
        if (mixed or _PREFIX.match(s)) and not taken.meets(m.start(), m.end()):
            out.append((m.start(), m.end(), "key", s))
    return out


def joined(spans, kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(((s[0], s[1], s[2]) for s in spans), key=lambda s: (s[0], kinds.index(s[2]), s[1])))


OWN = ("s_assign", "s_access", "s_hex", "s_base_sha256", "s_owner", "s_found", "s_row", "s_repository", "s_spans", "s_live", "s_example")


def scan(rows: DataFrame, *, text: str = "text") -> DataFrame:
    """``rows`` without the text, with base counts, spans and all candidates with hashes of their values."""
    rows = without(rows, *OWN)
    at = rows.columns.index(text)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])
    names = ["s_assign", "s_access", "s_hex", "s_base_sha256", "s_owner", "s_found"]

    def run(batches):
        for batch in batches:
            n = {k: [] for k in BASE}
            sha, owner, found = [], [], []
            for v in batch.column(at):
                t = v.as_py() or ""
                base = base_spans(t)
                for k in BASE:
                    n[k].append(sum(s[2] == k for s in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every = base + added_candidates(t, base)
                digest = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True)
                owner.append(digest(t) if every else 0)
                found.append([{"kind": s[2], "start": s[0], "end": s[1], "value": digest(s[3])} for s in every])
            thin = batch.drop_columns([batch.schema.names[at]])
            new = [*(pa.array(n[k], pa.int64()) for k in BASE), pa.array(sha, pa.string()), pa.array(owner, pa.int64()), pa.array(found, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*thin.columns, *new], names=[*thin.schema.names, *names])

    kinds = ["long"] * 3 + ["string", "long", "array<struct<kind:string,start:int,end:int,value:long>>"]
    return rows.mapInArrow(run, widened(rows.drop(text), dict(zip(names, kinds))))


def ownership(scanned: DataFrame, *, repository: str = "s_repository") -> DataFrame:
    """(value, repos, owners, example): how widely each candidate value is spread.

    Distinct pairs are counted after partial aggregation, so a value copied into a third of the
    corpus is small before it is shuffled.
    """
    seen = scanned.select(F.coalesce(F.concat(F.lit("r"), repository), F.lit("-")).alias("repo"), F.col("s_owner").alias("owner"), F.explode("s_found.value").alias("value"))
    repos = seen.groupBy("value", "repo").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("repos"), F.sum("n").alias("uses"))
    owners = seen.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("owners"))
    return repos.join(owners, "value").withColumn("example", (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("repos") >= EXAMPLE_REPOS))


def classify(rows: DataFrame, *, text: str = "text", repository: str = "source") -> DataFrame:
    """``rows`` without the text, with base results, s_spans (base and live added ones), s_live and s_example."""
    repo = rows.schema[repository].name
    scanned = scan(without(rows, *(n for n in OWN if n != repo)), text=text)
    scanned = cut(scanned.withColumns({"s_row": F.monotonically_increasing_id(), "s_repository": F.col(repo).cast("string")}))
    spread = cut(ownership(scanned).select("value", "example"))
    hits = scanned.where(F.size("s_found") > 0).select("s_row", F.explode("s_found").alias("f"))
    hits = hits.select("s_row", "f.*").join(spread, "value")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    shown = F.when(~((F.col("kind") == "key") & F.col("example")), F.struct("start", place.alias("place"), "end", "kind"))
    per = hits.groupBy("s_row").agg(
        F.array_sort(F.collect_list(shown)).alias("shown"),
        F.count_if(~F.col("example")).alias("s_live"),
        F.count_if("example").alias("s_example"),
    )
    spans = F.array_join(F.transform("shown", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = per.select("s_row", spans.alias("s_spans"), "s_live", "s_example")
    out = scanned.join(per, "s_row", "left")
    filled = {"s_spans": F.coalesce("s_spans", F.lit("")), "s_live": F.coalesce("s_live", F.lit(0)), "s_example": F.coalesce("s_example", F.lit(0))}
    return out.withColumns(filled).drop("s_row", "s_found", "s_owner", "s_repository")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", *(F.col(f"s_{k}").alias(f"n_{k}") for k in BASE), F.col("s_base_sha256").alias("base_sha256"), F.col("s_spans").alias("spans"), F.col("s_live").alias("n_live"), F.col("s_example").alias("n_example"))


QUERIES = {"op8_secrets": op8_secrets}
SQL: dict[str, str] = {}
