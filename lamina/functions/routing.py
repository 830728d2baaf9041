"""Read-path advice. A route is a note for EXPLAIN; results never depend on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and relative costs.
POINT_SHARE = 0.01
FULL_SHARE = 0.10
DELTA_OVERLOAD = 100
CPU_ROW = 1.0
IO_BYTE = 0.001
DELTA_LOOKUP = 10.0
MERGE_OVERHEAD = 1.5
COLUMNAR_CPU = 1.5
COMPRESSION = 0.5
FEEDBACK_WEIGHT = 0.3
WINDOW = 1000
DEFAULT_SHARE = 0.1


def query_kind(has_filter: bool, is_aggregate: bool, share: float) -> str:
    if is_aggregate:
        return "aggregate"
    if not has_filter:
        return "full_scan"
    return "point_get" if share < POINT_SHARE else "range_scan"


def rule(kind: str, share: float, deltas: int, pending: bool = False) -> str | None:
    """The first rule that is sure, or none."""
    if kind == "point_get":
        return "delta"
    if not pending and deltas == 0:
        return "columnar"
    if share < POINT_SHARE:
        return "delta"
    if share > FULL_SHARE:
        return "columnar"
    return "merge" if deltas > DELTA_OVERLOAD else None


def kind_of(has_filter: Column, is_aggregate: Column, share: Column) -> Column:
    """``query_kind`` for the rows of a log."""
    return F.when(is_aggregate, "aggregate").when(~has_filter, "full_scan").when(share < POINT_SHARE, "point_get").otherwise("range_scan")


def rule_of(kind: Column, share: Column, deltas: Column, pending: Column) -> Column:
    """``rule`` for the rows of a log; null where none is sure."""
    return (
        F.when(kind == "point_get", "delta").when(~pending & (deltas == 0), "columnar").when(share < POINT_SHARE, "delta")
        .when(share > FULL_SHARE, "columnar").when(deltas > DELTA_OVERLOAD, "merge")
    )


def blended(estimate: Column, runs: Column, mean_ms: Column, weight: float = FEEDBACK_WEIGHT) -> Column:
    """``blend`` for the rows of a log."""
    return F.when(runs >= 3, estimate * (1 - weight) + mean_ms * weight).otherwise(estimate)


def calibrated(cpu_row: Column, mean_error: Column, rows: Column) -> Column:
    """The cost of a row after a run over so many: moved by the mean relative error, the less the larger the run, within bounds."""
    rate = F.lit(0.001) / F.sqrt(1 + rows * 1e-6)
    return F.least(F.greatest(cpu_row * (1 + mean_error * rate), F.lit(0.001)), F.lit(100.0))


def evidence(log: DataFrame) -> DataFrame:
    """(table, path, source, mean_ms, runs): timings of each path by the best source there is, measured before dual before proxy."""
    place = F.array_position(F.array(*map(F.lit, ("measured", "dual", "proxy"))), F.col("source"))
    per = log.groupBy("table", "path", "source").agg(F.avg("ms").alias("mean_ms"), F.count("*").alias("runs"))
    best = per.groupBy("table", "path").agg(F.min_by(F.struct("source", "mean_ms", "runs"), place).alias("b"))
    return best.select("table", "path", "b.*")


def observed_pairs(log: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``observed_share`` for pairs of columns (table, column, column2, seq, rows, total), in either order."""
    pair = log.withColumns({"column": F.least("column", "column2"), "column2": F.greatest("column", "column2")})
    pair = pair.withColumn("column", F.to_json(F.struct(F.col("column").alias("a"), F.col("column2").alias("b"))))
    out = observed_share(pair, window=window)
    part = lambda k: F.get_json_object("column", f"$.{k}")
    return out.select("table", part("a").alias("column1"), part("b").alias("column2"), "share", "n")


def costs(rows: float, row_bytes: float, deltas: int) -> dict[str, float]:
    columnar = rows * COLUMNAR_CPU * CPU_ROW + rows * row_bytes * COMPRESSION * IO_BYTE
    return {"delta": rows * CPU_ROW + rows * row_bytes * IO_BYTE, "columnar": columnar, "merge": deltas * DELTA_LOOKUP + columnar * MERGE_OVERHEAD}


@dataclass(frozen=True)
class Observed:
    """Measured runs of a path."""

    runs: int = 0
    mean_ms: float = 0.0


def blend(estimate: float, seen: Observed | None, weight: float = FEEDBACK_WEIGHT) -> float:
    """An estimate mixed with what at least three runs showed."""
    return estimate if seen is None or seen.runs < 3 else estimate * (1 - weight) + seen.mean_ms * weight


def confidence(samples: dict[str, int], measured: int, share: float, cost: dict[str, float], seen: dict[str, Observed]) -> float:
    """From a quarter up: columns with enough selectivity samples, measured runs, clear gaps, a share at an end."""
    known = sum(n >= 5 for n in samples.values())
    both = all(seen.get(p, Observed()).runs >= 3 for p in ("delta", "columnar"))
    gap = lambda a, b: abs(a - b) / (a + b + 1e-6)
    c = 0.25 + min(0.05 * known, 0.15) + 0.15 * (measured >= 3)
    c += 0.15 * (both and gap(cost["delta"], cost["columnar"]) > 0.5)
    c += 0.15 * (both and gap(seen["delta"].mean_ms, seen["columnar"].mean_ms) > 0.3)
    c += 0.1 * (known > 0 and not 0.01 <= share <= 0.5)
    return min(max(c, 0.0), 1.0)


@dataclass(frozen=True)
class Route:
    path: str
    tier: str
    cost: float | None = None


def route(kind: str, share: float, rows: float, row_bytes: float, deltas: int, pending: bool = False, seen: dict[str, Observed] | None = None) -> Route:
    """The first tier that decides: rules, then the least blended cost (ties: delta, columnar, merge)."""
    if sure := rule(kind, share, deltas, pending):
        return Route(sure, "rule")
    cost = costs(rows * share, row_bytes, deltas)
    cost |= {p: blend(cost[p], (seen or {}).get(p)) for p in ("delta", "columnar")}
    best = min(("delta", "columnar", "merge"), key=lambda p: cost[p])
    return Route(best, "cost", cost[best])


def observed_share(log: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(table, column, share, n): mean share of rows over each column's latest observations (seq, rows, total)."""
    latest = Window.partitionBy("table", "column").orderBy(F.col("seq").desc())
    recent = log.withColumn("at", F.row_number().over(latest)).where(F.col("at") <= window)
    return recent.groupBy("table", "column").agg(F.coalesce(F.avg(F.col("rows") / F.nullif(F.col("total"), F.lit(0))), F.lit(DEFAULT_SHARE)).alias("share"), F.count("*").alias("n"))


def segment_feedback(log: DataFrame) -> DataFrame:
    """(segment, queries, hit_ratio, staleness) of a log (segment, hit); staleness is the share of misses."""
    return log.groupBy("segment").agg(F.count("*").alias("queries"), F.avg(F.col("hit").cast("double")).alias("hit_ratio")).withColumn("staleness", 1 - F.col("hit_ratio"))


# --- learned routes: advice of a linear model, on no path to a result --------------------------------

# Kinds of queries, numbers of a query, the scales that bring them into 0 to 1.
KINDS = ["point_get", "range_scan", "full_scan", "aggregate"]
FEATURES = [*(f"is_{k}" for k in KINDS), "f_share", "f_rows", "f_filters", "f_columns", "f_deltas"]
MOST_ROWS_LOG10 = 9
MOST_FILTERS = 20
MOST_COLUMNS = 64
MOST_DELTAS = 1024
FILTERS_FROM_SHARE = [(0.9, 0), (0.5, 1), (0.1, 2), (0.01, 3), (0.001, 4)]
SHADOW_SHARE = 0.05
MERGE_MARGIN = 0.1


def filters_of(share: Column) -> Column:
    """How many filters a share of rows suggests: the fewer rows, the more."""
    (first, n), *rest = FILTERS_FROM_SHARE
    out = F.when(share >= first, n)
    for least, n in rest:
        out = out.when(share >= least, n)
    return out.otherwise(5)


def plan_features(kind: Column, share: Column, rows: Column, columns: Column, deltas: Column) -> Column:
    """A query's ``FEATURES`` as an array: its kind, then its numbers on scales of 0 to 1."""
    within = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    scaled = lambda x, most: within(F.log2(x + 1) / np.log2(most).item())
    return F.array(
        *((kind == k).cast("double") for k in KINDS), within(share), within(F.log10(rows + 1) / MOST_ROWS_LOG10),
        scaled(filters_of(share), MOST_FILTERS), scaled(columns, MOST_COLUMNS), scaled(deltas, MOST_DELTAS),
    )


def pooled(nodes: DataFrame, plan: str) -> DataFrame:
    """(plan, f): the mean features of a plan's nodes (plan, f)."""
    means = F.array(*(F.avg(F.get("f", F.lit(i))) for i in range(len(FEATURES))))
    return nodes.groupBy(plan).agg(means.alias("f"))


def fit(log: DataFrame, paths: list[str]) -> dict[str, np.ndarray]:
    """Least squares of each path's times on the features: weights and, last, a constant.

    ``log`` has ``f`` and a column of times for each path; a row without one of them counts for the others.
    Sums of products are all that leaves the executors.
    """
    x = [*(F.get("f", F.lit(i)) for i in range(len(FEATURES))), F.lit(1.0)]
    k = len(x)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    model = {}
    for path in paths:
        seen = log.where(F.col(path).isNotNull() & F.col("f").isNotNull())
        r = seen.agg(*(F.sum(x[i] * x[j]) for i, j in cells), *(F.sum(x[i] * F.col(path)) for i in range(k))).first()
        square = np.zeros((k, k))
        for (i, j), v in zip(cells, r):
            square[i, j] = square[j, i] = v or 0.0
        model[path] = np.linalg.lstsq(square, np.array([v or 0.0 for v in r[len(cells) :]]), rcond=1e-12)[0]
    return model


def predicted(model: dict[str, np.ndarray]) -> dict[str, Column]:
    """Each path's predicted time, from ``f``."""
    term = lambda w: sum((F.get("f", F.lit(i)) * float(a) for i, a in enumerate(w[:-1])), F.lit(float(w[-1])))
    return {path: term(w) for path, w in model.items()}


def learned_path(cost: dict[str, Column]) -> Column:
    """The path of least cost; merge only if it beats the others by a margin."""
    delta, columnar, merge = cost["delta"], cost["columnar"], cost["merge"]
    clear = merge < F.least(delta, columnar) * (1 - MERGE_MARGIN)
    return F.when(clear, "merge").when(delta <= columnar, "delta").otherwise("columnar")


def shadowed(query: Column, share: float = SHADOW_SHARE) -> Column:
    """Whether a query's other path is timed too: a fixed share of all, chosen by the query's hash."""
    return F.conv(F.substring(F.md5(query.cast("string")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))


def shadow_evidence(log: DataFrame) -> DataFrame:
    """(table, n, agreement, saved_ms) of queries (table, chosen, chosen_ms, other_ms) timed on both paths: how often the choice was the faster."""
    good = (F.col("chosen_ms") <= F.col("other_ms")).cast("double")
    saved = F.avg(F.greatest(F.col("chosen_ms") - F.col("other_ms"), F.lit(0.0)))
    return log.groupBy("table").agg(F.count("*").alias("n"), F.avg(good).alias("agreement"), saved.alias("saved_ms"))
