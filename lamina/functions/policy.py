"""Compaction: which segments to rewrite, and how. Expressions over the manifest's rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEGABYTE = 1024 * 1024


@dataclass(frozen=True)
class Weights:
    """Coefficients of the priority score (fixed defaults)."""

    deleted: float = 10.0
    size: float = 0.3
    age: float = 0.2
    stale: float = 5.0
    miss: float = 3.0


def priority(w: Weights = Weights()) -> Column:
    """Score of a segment row (del_ratio, size_bytes, age_hours, staleness, hit_ratio)."""
    mb = F.greatest(F.col("size_bytes") / MEGABYTE, F.lit(1.0))
    return (
        F.pow("del_ratio", F.lit(2.0)) * w.deleted + F.log2(mb) * w.size + F.log2(F.col("age_hours")) * w.age
        + F.col("staleness") * w.stale + (1 - F.col("hit_ratio")) * w.miss
    )


def action() -> Column:
    """What a segment needs first: rewrite, query-driven rewrite, refresh of statistics, merge of small files, or nothing."""
    return (
        F.when(F.col("del_ratio") > 0.5, "rewrite").when(1 - F.col("hit_ratio") > 0.5, "query_driven")
        .when(F.col("staleness") > 0.5, "refresh").when(F.col("size_bytes") < MEGABYTE, "small_files")
    )


def climb(w: Weights, staleness: float, hit_ratio: float, queries: int, step: float = 0.1, least: int = 5) -> Weights:
    """One step of the weights towards what a segment's feedback shows, within their bounds."""
    if queries < least:
        return w
    if staleness > 0.5 and w.stale + step <= 20:
        w = replace(w, stale=w.stale + step)
    elif staleness < 0.1 and queries > 20 and w.stale - step / 2 >= 1:
        w = replace(w, stale=w.stale - step / 2)
    if 1 - hit_ratio > 0.5 and queries > 10 and w.miss + step <= 10:
        w = replace(w, miss=w.miss + step)
    return w


def tiering(range_share: float, ratio: float = 10.0) -> tuple[str, float]:
    """(policy, runs a level): ratio / (1 + ratio * share of range queries), tiering from half the ratio, leveling to 15 %."""
    t = ratio / (1 + ratio * min(max(range_share, 0.01), 0.99))
    return ("tiering" if t >= ratio * 0.5 else "leveling" if t <= ratio * 0.15 else "hybrid"), t


def flush_policy(write_amp: float, read_amp: float, p99_ms: float, qps: float) -> str:
    if write_amp > 10 and read_amp < 2:
        return "tiering"
    if read_amp > 5 and p99_ms > 50:
        return "leveling"
    return "lazy_leveling" if qps > 1000 else "hot_cold"


#: Decay of a write's weight with each later one, and heat from which a key is hot or up to which it is cold.
HEAT_DECAY = 0.875
HOT = 5.0
COLD = 1.0


def write_heat(log: DataFrame, key: str) -> DataFrame:
    """(key, writes, heat, kind): each write of a key adds one to a heat that decays with the next.

    The sum of the powers of the decay, so that a count, combined before the shuffle, is enough.
    """
    heat = (1 - F.pow(F.lit(HEAT_DECAY), F.col("writes"))) / (1 - HEAT_DECAY)
    out = log.groupBy(key).agg(F.count("*").alias("writes")).withColumn("heat", heat)
    return out.withColumn("kind", F.when(F.col("heat") >= HOT, "hot").when(F.col("heat") <= COLD, "cold").otherwise("warm"))


def climbed(step: float = 0.1, least: int = 5) -> tuple[Column, Column]:
    """``climb`` for rows (stale, miss, staleness, hit_ratio, queries): the new weights stale and miss."""
    c = F.col
    up, down = c("stale") + step, c("stale") - step / 2
    stale = F.when((c("staleness") > 0.5) & (up <= 20), up).when((c("staleness") <= 0.5) & (c("staleness") < 0.1) & (c("queries") > 20) & (down >= 1), down).otherwise(c("stale"))
    miss = F.when((1 - c("hit_ratio") > 0.5) & (c("queries") > 10) & (c("miss") + step <= 10), c("miss") + step).otherwise(c("miss"))
    known = c("queries") >= least
    return F.when(known, stale).otherwise(c("stale")), F.when(known, miss).otherwise(c("miss"))


def tiering_of(range_share: Column, ratio: float = 10.0) -> Column:
    """``tiering`` for a column: (policy, runs)."""
    t = F.lit(ratio) / (1 + ratio * F.least(F.greatest(range_share, F.lit(0.01)), F.lit(0.99)))
    kind = F.when(t >= ratio * 0.5, "tiering").when(t <= ratio * 0.15, "leveling").otherwise("hybrid")
    return F.struct(kind.alias("policy"), t.alias("runs"))


def flush_policy_of(write_amp: Column, read_amp: Column, p99_ms: Column, qps: Column) -> Column:
    return (
        F.when((write_amp > 10) & (read_amp < 2), "tiering").when((read_amp > 5) & (p99_ms > 50), "leveling")
        .when(qps > 1000, "lazy_leveling").otherwise("hot_cold")
    )


def may_run_behind(load: Column) -> Column:
    """Whether background work may run beside a foreground load between 0 and 1."""
    return 1 - load > 0.3


def ewma(log: DataFrame, key: str, value: str, order: str, decay: float) -> DataFrame:
    """(key, score): exponentially weighted mean of each key's values in order, the newest counting 1 - decay."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    x = log.withColumn("age", F.row_number().over(newest) - 1)
    return x.groupBy(key).agg((F.sum(F.col(value) * F.pow(F.lit(decay), F.col("age"))) * (1 - decay)).alias("score"))


def range_reduce(segments: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Segments both hot and re-read: 0.6 hot + 0.4 overlap, best first."""
    hot = segments.where((F.col("hot") > threshold) & (F.col("overlap") > threshold))
    return hot.withColumn("score", F.col("hot") * 0.6 + F.col("overlap") * 0.4).orderBy(F.col("score").desc(), "segment")


def rewrite_keys(log: DataFrame) -> DataFrame:
    """(table, column, weight): the column by which a rewrite should sort, the one whose filters (table, column, share) spare most rows.

    Ties go to the first name.
    """
    spared = log.groupBy("table", "column").agg(F.sum(1 - F.col("share")).alias("weight"))
    best = F.max_by(F.struct("column", "weight"), F.struct("weight", _backwards("column"))).alias("best_key")
    return spared.groupBy("table").agg(best).select("table", "best_key.*")


def _backwards(name: str) -> Column:
    """Greater for names that come first."""
    return F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c))


def io_schedule(tasks: DataFrame, bytes_per_second: float) -> DataFrame:
    """``tasks`` (device, priority, seq, size_bytes) with ``begin_second``: each device spends its tokens by priority, then in order.

    A row is a file or segment to flush or rewrite, so a device's queue is metadata.
    """
    before = Window.partitionBy("device").orderBy("priority", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return tasks.withColumn("begin_second", F.coalesce(F.sum("size_bytes").over(before), F.lit(0)) / bytes_per_second)


def commit_groups(log: DataFrame, window_ms: int = 50, most: int = 100) -> DataFrame:
    """(window, part, n, last): commits (ts, seq) synced together, those of a time window, at most so many at once."""
    window = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (window_ms * 1000)).alias("window")
    x = log.select(window, "seq")
    place = F.row_number().over(Window.partitionBy("window").orderBy("seq")) - 1
    return x.withColumn("part", F.floor(place / most)).groupBy("window", "part").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
