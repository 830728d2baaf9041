"""Statistics of blocks and columns, and relations between columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.joins import in_pieces
from lamina.sources.shared import shared_folder

BLOCK_ROWS = 8192


def _numbers(df: DataFrame, c: str) -> Column:
    """The column without NaN, which no minimum or maximum counts."""
    return F.when(~F.isnan(c), F.col(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)


def block_stats(df: DataFrame, block: Column, columns: list[str]) -> DataFrame:
    """(block, column, min, max, nulls, n) with minima and maxima as text; every column in one pass."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        v = _numbers(df, c)
        aggs += [F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"), F.count_if(F.col(c).isNull()).alias(f"{c}__nulls")]
    wide = df.groupBy(block.alias("block")).agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").cast("string").alias("min"), F.col(f"{c}__max").cast("string").alias("max"), F.col(f"{c}__nulls").alias("nulls")) for c in columns))
    return wide.select("block", "n", F.inline(rows))


def merge_stats(stats: DataFrame, column: str, kind: str) -> DataFrame:
    """Block statistics of one column joined to those of the table, compared as ``kind``."""
    s = stats.where(F.col("column") == column)
    return s.agg(F.min(F.col("min").cast(kind)).alias("min"), F.max(F.col("max").cast(kind)).alias("max"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n"))


def table_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, distinct, min, max) of a table."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        v = _numbers(df, c)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.count_distinct(c).alias(f"{c}__distinct"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct"), F.col(f"{c}__min").cast("string").alias("min"), F.col(f"{c}__max").cast("string").alias("max")) for c in columns))
    return one.select("n", F.inline(rows))


def with_previous(df: DataFrame, value: str, order: list[str], *, group: str, pieces: int = 64) -> DataFrame:
    """``df`` with ``piece`` and ``prev``, the value of the row before in its group as a struct (v), null for the first.

    Groups are cut into pieces by the first column of ``order``, so that a group of a third of all
    rows is that many tasks; the last value of each piece is carried into the next.
    """
    x = in_pieces(df, order[0], pieces, "piece")
    own = F.struct(F.col(value).alias("v"))
    before = F.lag(own).over(Window.partitionBy(group, "piece").orderBy(*order))
    ends = x.groupBy(F.col(group).alias("end_group"), F.col("piece").alias("end_piece")).agg(F.max_by(own, F.struct(*order)).alias("end"))
    earlier = Window.partitionBy("end_group").orderBy("end_piece").rowsBetween(Window.unboundedPreceding, -1)  # at most ``pieces`` rows
    ends = ends.select("end_group", "end_piece", F.last("end").over(earlier).alias("carried"))
    x = x.withColumn("prev", before)
    x = x.join(ends, F.col(group).eqNullSafe(F.col("end_group")) & (F.col("piece") == F.col("end_piece")))
    return x.withColumn("prev", F.coalesce("prev", "carried")).drop("end_group", "end_piece", "carried")


def column_features(df: DataFrame, column: str, order: list[str], *, group: str, pieces: int = 64) -> DataFrame:
    """Per group: distinct ratio, entropy in bits, mean and longest run, null ratio, log2 of the range, share of rising pairs.

    Runs and pairs follow ``order`` within a group; what a task sorts is a piece of a group, and runs
    that go on over pieces are joined from a row for each piece.
    """
    x = with_previous(df.select(group, column, *order), column, order, group=group, pieces=pieces)
    v, p = F.col(column), F.col("prev")
    x = x.select(group, "piece", v.alias("v"), p["v"].alias("p"), *order, (p.isNull() | ~v.eqNullSafe(p["v"])).cast("int").alias("new"))
    x = x.withColumn("run", F.sum("new").over(Window.partitionBy(group, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    lengths = x.groupBy(group, "piece", "run").agg(F.count("*").alias("length"))
    lead = F.coalesce(F.max(F.when(F.col("run") == 0, F.col("length"))), F.lit(0)).alias("lead")  # of a run from an earlier piece
    inner = F.coalesce(F.max(F.when(F.col("run") > 0, F.col("length"))), F.lit(0)).alias("inner")
    tail = F.max_by("length", "run").alias("tail")
    per = lengths.groupBy(group, "piece").agg(lead, inner, tail, (F.max("run") > 0).alias("breaks"))
    steps = F.array_sort(F.collect_list(F.struct("piece", "lead", "inner", "tail", "breaks")))  # at most ``pieces``

    def go(state, step):
        now = state["now"] + step["lead"]
        return F.struct(
            F.when(step["breaks"], step["tail"]).otherwise(now).alias("now"), F.greatest(state["best"], now, step["inner"], F.when(step["breaks"], step["tail"]).otherwise(now)).alias("best"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("best"))
    longest = per.groupBy(group).agg(F.aggregate(steps, zero, go, lambda s: s["best"]).alias("run_max"))
    values = x.where("v is not null").groupBy(group, "v").agg(F.count("*").alias("c"))
    totals = values.groupBy(F.col(group).alias("total_group")).agg(F.sum("c").alias("total"))
    share = F.col("c") / F.col("total")
    values = values.join(totals, F.col(group).eqNullSafe(F.col("total_group")))
    entropy = values.groupBy(group).agg(F.sum(-share * F.log2(share)).alias("entropy"), F.count("*").alias("distinct"))
    base = x.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(F.col("v").isNull().cast("int")).alias("null_ratio"), F.log2(F.max("v") - F.min("v") + 1).alias("range_log2"),
        F.coalesce(F.avg(F.when(F.col("p").isNotNull() & F.col("v").isNotNull(), (F.col("v") >= F.col("p")).cast("int"))), F.lit(1.0)).alias("sortedness"),
        (F.count("*") / F.sum("new")).alias("run_avg"),
    )
    return base.join(longest, group).join(entropy, group).withColumn("cardinality_ratio", F.col("distinct") / F.col("n"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's correlation and the advice that follows: peer_diff above 0.9, else subaltern above 1.2 children a parent."""
    r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    children = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) / F.count_distinct(F.when(F.col(b).isNotNull(), F.col(a)))
    out = df.agg(r.alias("r"), children.alias("children"))
    return out.withColumn("relation", F.when(F.col("r") > 0.9, "peer_diff").when(F.col("children") > 1.2, "subaltern").otherwise("none"))


def peer_diff(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """b as its difference from a."""
    return df.withColumn(to, F.col(a) - F.col(b)).drop(b)


def peer_undo(df: DataFrame, a: str, diff: str, to: str) -> DataFrame:
    return df.withColumn(to, F.col(a) - F.col(diff)).drop(diff)


def subaltern(df: DataFrame, parent: str, child: str) -> DataFrame:
    """child as offset from the least child of its parent, and that parent's offset from the least of all."""
    low = df.groupBy(parent).agg(F.min(child).alias("parent_min"))
    least = low.agg(F.min("parent_min").alias("global_min"))
    low = low.crossJoin(F.broadcast(least))  # one row
    return df.join(low, parent).withColumns({"parent_offset": F.col("parent_min") - F.col("global_min"), "child_offset": F.col(child) - F.col("parent_min")}).drop("parent_min")


def subaltern_undo(df: DataFrame, parent: str, child: str) -> DataFrame:
    """What ``subaltern`` encoded: the child from both offsets and the least of all."""
    return df.select(parent, (F.col("global_min") + F.col("parent_offset") + F.col("child_offset")).alias(child))


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position``, its row's number from 0 in an order, without a task that sees all rows.

    Ranges are sorted apart; a row for each range, its size, gives where it begins. The ranges are
    kept in the shared folder, as a second sampling could draw them elsewhere.
    """
    shared_folder(df.sparkSession)
    x = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    ).checkpoint()
    sizes = x.groupBy("part").agg(F.count("*").alias("rows"))
    begin = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("part", begin.alias("begin"))  # a row for each partition
    return x.join(F.broadcast(begins), "part").withColumn("position", F.col("begin") + F.col("at")).drop("part", "at", "begin")


def sparse_index(df: DataFrame, key: str, every: int = BLOCK_ROWS) -> DataFrame:
    """(key, position) of every so many-th row in order of the key: the last sample up to a key is where to look."""
    return positions(df.select(key), key).where(F.col("position") % every == 0)


def granules(stats: DataFrame, blocks: int = 8) -> DataFrame:
    """Statistics of so many blocks together, of ``block_stats`` with numbered blocks."""
    return stats.groupBy(F.floor(F.col("block") / blocks).alias("granule"), "column").agg(
        F.min(F.col("min").cast("double")).alias("min"), F.max(F.col("max").cast("double")).alias("max"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n"),
    )


def bloom(df: DataFrame, block: Column, value: str, *, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """(block, filter): the bits that the values of a block set, as a sorted array; values are combined before they are shuffled."""
    places = F.explode(F.array(*_places(F.col(value), bits, hashes))).alias("place")
    return df.select(block.alias("block"), places).groupBy("block").agg(F.array_sort(F.collect_set("place")).alias("filter"))


def _places(value: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)).cast("int") for i in range(hashes)]


def may_hold(value: Column, *, bits: int = 1 << 16, hashes: int = 4) -> Column:
    """Whether a filter of ``bloom`` may hold a value; no is sure, yes is not."""
    tests = [F.array_contains("filter", p) for p in _places(value, bits, hashes)]
    return tests[0] & tests[1] & tests[2] & tests[3] if hashes == 4 else F.forall(F.array(*tests), lambda t: t)


def encoding_advice(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(column, advice): delta for integers that never fall in an order, bitpack for others, dictionary for strings of under 1000 values, alp for floats."""
    ints = [c for c in columns if isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    one = df
    if ints:
        whole = df.select(*columns, *(o for o in order if o not in columns), F.struct(*ints).alias("ints"), F.lit(0).alias("all"))
        one = with_previous(whole, "ints", order, group="all")
    rows = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            advice = F.lit("alp")
        elif c in ints:
            advice = F.when(F.coalesce(F.bool_or(F.col(c) < F.col("prev")["v"][c]), F.lit(False)), "bitpack").otherwise("delta")
        elif isinstance(kind, T.StringType):
            advice = F.when(F.count_distinct(c) < 1000, "dictionary").otherwise("raw")
        else:
            advice = F.lit("raw")
        rows.append(F.struct(F.lit(c).alias("column"), advice.alias("advice")))
    return one.agg(F.array(*rows).alias("x")).select(F.inline("x"))
