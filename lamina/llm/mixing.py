"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1. Among all rates whose tokens meet each source's target and that
stay within ``cap`` copies, those closest to the start in relative entropy are
``min(cap, exp(tilt * size))`` with one tilt a source: the convex dual's variable. Newton steps on
the dual run over the (source, size) histogram, an exact and small statistic of the corpus, as
Spark aggregates. Rates are then rounded to whole copies for each histogram cell, walking down the
sizes so that rounding errors cancel; what is left over is moved by single cells until a source
meets its target. Which documents of a cell get the extra copy is decided by a hash of their key,
through ranks within salted parts of the cell, so that a hot cell never meets in one task.

Defined results. Null text: size 0. Null source: a source of its own, last. Documents of size 0
keep one copy and count nothing. Repeated rows are separate documents; ties of a key are ordered by
the text, and which of two equal rows has the extra copy makes no difference. An empty table gives
an empty result. Columns of the input may have any name: ``mixed_rows`` passes all on, and where
``mix`` adds a column of a name that is taken, its own replaces the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import SPACE, cut, documents

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """A row for each source: its size, weight and target.

    Sources by code point, null last, take the weights in turn. The budget is ``share`` of all
    sizes; a target stops at ``cap`` times its source's size and the excess goes to the others by
    weight. The result of that repeated sharing is found at once, in order of cap by weight: a
    source is capped when the level of what is left still exceeds its cap.
    """
    per = cells.groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("mix_source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("mix_size") > 0, F.col("mix_size"))).alias("least"))
    rank = (F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank + 1).cast("int")))
    everyone = Window.partitionBy()
    full = F.col("mix_source_size") * float(cap)
    order = Window.orderBy(full / F.col("w"), F.col("mix_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"left": share * F.sum("mix_source_size").over(everyone) - F.coalesce(F.sum(full).over(before), F.lit(0.0)), "ws": F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    per = per.withColumn("level", F.col("left") / F.col("ws"))
    per = per.withColumn("level", F.min(F.when(full / F.col("w") >= F.col("level"), F.struct(full / F.col("w"), F.col("level").alias("level")))).over(everyone)["level"])
    return per.select("mix_source", "mix_source_size", "docs", "least", F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("w"))).alias("mix_target"))


def _rate(cap: int) -> Column:
    return F.when(F.col("full"), F.when(F.col("mix_size") > 0, float(cap)).otherwise(1.0)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("mix_size"), F.lit(50.0)))))


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: int = 2, tolerance: float = 1e-7, max_rounds: int = 60) -> DataFrame:
    """The dual's Newton iterations: ``targets`` with the tilt of each source.

    The step is Newton's on the logarithm of the tokens taken, kept inside a bracket of the root
    and halved where it would leave it. Only the largest remaining error reaches the driver.
    """
    lo = F.when(F.col("mix_target") < F.col("mix_source_size"), F.lit(-60.0) / F.col("least")).otherwise(F.lit(0.0))
    hi = F.when(F.col("mix_target") < F.col("mix_source_size"), F.lit(0.0)).otherwise(F.lit(math.log(cap) + 1e-9) / F.col("least"))
    state = cut(
        targets.withColumn("full", F.col("mix_target") >= cap * F.col("mix_source_size") * (1 - 1e-12))
        .withColumns({"lo": lo, "hi": hi, "tilt": F.lit(0.0)})
    )
    for _ in range(max_rounds):
        rate = _rate(cap)
        tokens = F.col("n") * F.col("mix_size") * rate
        got = (
            cells.join(state.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s")))
            .groupBy("mix_source")
            .agg(F.sum(tokens).alias("f"), F.sum(F.when(rate < cap, tokens * F.col("mix_size")).otherwise(0.0)).alias("d"))
            .withColumnRenamed("mix_source", "g")
        )
        x = state.join(got, F.col("mix_source").eqNullSafe(F.col("g"))).drop("g")
        x = x.withColumns({"error": F.when(F.col("full") | (F.col("mix_source_size") == 0), 0.0).otherwise(F.abs(F.col("f") - F.col("mix_target")) / F.col("mix_target")), "lo": F.when(F.col("f") < F.col("mix_target"), F.col("tilt")).otherwise(F.col("lo")), "hi": F.when(F.col("f") > F.col("mix_target"), F.col("tilt")).otherwise(F.col("hi"))})
        step = F.col("tilt") - F.when(F.col("d") > 0, F.log(F.col("f") / F.col("mix_target")) * F.col("f") / F.col("d"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        x = x.withColumn("tilt", F.when(F.col("error") <= tolerance, F.col("tilt")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
        state = cut(x.drop("f", "d"))
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("error")
    else:
        raise RuntimeError("tilts did not settle")
    return state.drop("error", "lo", "hi")


def round_cells(cells: DataFrame, state: DataFrame, cap: int = 2, tolerance: float = 2e-4, max_rounds: int = 100) -> DataFrame:
    """Whole copies ``k`` for each cell of ``n`` documents, so that each source comes to its target."""
    x = cells.join(state.drop("docs", "least").withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s"))).drop("s")
    down = Window.partitionBy("mix_source").orderBy(F.col("mix_size").desc())
    x = x.withColumn("upto", F.floor(F.sum(F.col("n") * _rate(cap)).over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5))
    x = x.withColumn("k", F.when(F.col("mix_size") == 0, F.col("n")).otherwise(F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))))
    x = x.withColumn("k", F.least(F.greatest(F.col("k"), F.lit(0)), cap * F.col("n")))
    x = cut(x.select("mix_source", "mix_size", "n", "mix_source_size", "mix_target", "k"))
    for _ in range(max_rounds):
        left = x.groupBy("mix_source").agg((F.first("mix_target") - F.sum(F.col("k") * F.col("mix_size"))).alias("gap"), F.first("mix_target").alias("t"))
        left = left.where(F.abs("gap") > tolerance * F.col("t")).select(F.col("mix_source").alias("s"), "gap")
        move = F.greatest(-F.col("k"), F.least(cap * F.col("n") - F.col("k"), F.round(F.col("gap") / F.col("mix_size")))).cast("long")
        best = (
            x.where("mix_size > 0")
            .join(left, F.col("mix_source").eqNullSafe(F.col("s")))
            .withColumn("move", move)
            .withColumn("rest", F.abs(F.col("gap") - F.col("move") * F.col("mix_size")))
            .where("move <> 0 and rest < abs(gap)")
            .groupBy("mix_source")
            .agg(F.min(F.struct("rest", "mix_size", "move")).alias("b"))
            .select(F.col("mix_source").alias("s"), F.col("b.mix_size").alias("z"), F.col("b.move").alias("move"))
        )
        best = cut(best)
        if best.isEmpty():
            break
        x = cut(x.join(best, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_size") == F.col("z")), "left").withColumn("k", F.col("k") + F.coalesce("move", F.lit(0))).drop("s", "z", "move"))
    else:
        raise RuntimeError("whole copies did not settle")
    return x


OWN = ("mix_source", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def mix(rows: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """``rows`` with mix_source, mix_size, mix_source_size, mix_target, mix_copies and mix_taken (copies times size)."""
    thin = cut(sized(rows, key=key, source=source, text=text).drop("mix_row"))
    out = mixed(sized(rows, key=key, source=source, text=text), thin, weights, share, cap)
    return out.select(*(F.col("mix_row")[c].alias(c) for c in rows.columns if c.lower() not in OWN), *OWN)


def mixed(wide: DataFrame, thin: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """``wide`` (mix_source, mix_size, mix_hash and more, as of ``sized``) with the result; ``thin`` has these three of all rows."""
    n = thin.count()
    cells = cut(thin.groupBy("mix_source", "mix_size").agg(F.count("*").alias("n")))
    state = solve_tilts(cells, source_targets(cells, weights, share, cap), cap)
    copies = round_cells(cells, state, cap).withColumnRenamed("n", "docs")

    # A cell's parts: as many as the square root of the corpus, so that neither parts nor their lists grow faster.
    parts = max(1, math.isqrt(n))
    part = F.pmod("mix_hash", F.lit(parts)).cast("int")
    source_key = F.coalesce(F.concat(F.lit("s"), "mix_source"), F.lit("-")).alias("mix_key")
    counted = thin.withColumn("mix_part", part).groupBy("mix_source", "mix_size", "mix_part").agg(F.count("*").alias("n"))
    same_cell = F.col("s").eqNullSafe(F.col("mix_source")) & (F.col("z") == F.col("mix_size"))
    plan = counted.withColumnsRenamed({"mix_source": "s", "mix_size": "z"}).join(copies, same_cell).drop("s", "z")
    upto = F.sum("n").over(Window.partitionBy("mix_source", "mix_size").orderBy("mix_part"))
    extra = F.col("k") % F.col("docs")
    extras = F.greatest(F.lit(0), F.least(F.col("n"), extra - (upto - F.col("n")))).alias("mix_extras")
    base = F.floor(F.col("k") / F.col("docs")).alias("mix_base")
    plan = plan.select(source_key, "mix_size", "mix_part", base, extras, "mix_source_size", "mix_target")
    keys = ["mix_key", "mix_size", "mix_part"]
    ranked = wide.select("*", source_key, part.alias("mix_part"))
    ranked = ranked.withColumn("mix_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("mix_hash")))
    out = ranked.join(plan, keys)
    out = out.withColumn("mix_copies", (F.col("mix_base") + (F.col("mix_rank") <= F.col("mix_extras")).cast("int")).cast("int"))
    out = out.withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))
    return out.drop("mix_key", "mix_part", "mix_rank", "mix_hash", "mix_base", "mix_extras")


def sized(rows: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(mix_row, mix_source, mix_size, mix_hash): all columns of ``rows`` in one, so that no names clash."""
    return rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("mix_row"), F.col(source).cast("string").alias("mix_source"),
        word_count(F.col(text)).alias("mix_size"), F.xxhash64(F.col(key), F.col(text), F.lit("mix")).alias("mix_hash"),
    )


def mixed_rows(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    wide = sized(docs, key=key, source=source, text=text)
    out = mixed(wide, cut(wide.drop("mix_row")), weights, share, cap).where("mix_copies > 0")
    return out.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("mix_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = sized(documents(spark, sf_dir).select("doc_id", "source", "text"))
    narrow = cut(narrow.select(F.col("mix_row.doc_id").alias("doc_id"), "mix_source", "mix_size", "mix_hash"))
    names = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_copies": "copies"}
    out = mixed(narrow, narrow).withColumnsRenamed(names)
    return out.select("doc_id", "size", "source_size", "target", F.col("mix_taken").cast("long").alias("taken"), "copies")


QUERIES = {"op1_mix_sources": op1_mix_sources}
SQL: dict[str, str] = {}
