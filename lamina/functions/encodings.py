"""Light column encodings by blocks: codes, what they would take in bits, and the way back.

A block is some thousand rows, so windows over one stay small whatever the table's size. Codes are
columns; how their bits lie in a file is the writer's affair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of a plain value, of a place in a block, of an exponent.
PLAIN = 64
PLACE = 16
EXPONENT = 8
#: Powers of ten that doubles are tried with.
EXPONENTS = range(0, 7)
#: Schemes in order of preference where they take as much.
SCHEMES = ["bitpack", "for", "delta", "rle", "dict", "raw"]


def bits(x: Column) -> Column:
    """Binary digits of a whole number that isn't negative; none for zero."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def in_block(block: str, order: str):
    return Window.partitionBy(block).orderBy(order)


def reference_frame(df: DataFrame, block: str, value: str) -> DataFrame:
    """``df`` with the block's least value as ``reference`` and ``code``, the distance from it, for ``value``."""
    low = df.groupBy(block).agg(F.min(value).alias("reference"))
    return df.join(low, block).withColumn("code", F.col(value) - F.col("reference")).drop(value)


def reference_undo(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.col("reference") + F.col("code")).drop("reference", "code")


def delta(df: DataFrame, block: str, value: str, order: str) -> DataFrame:
    """``df`` with ``code``, the difference from the row before, for ``value``; a block's first row keeps its value."""
    before = F.lag(value).over(in_block(block, order))
    return df.withColumn("code", F.col(value) - F.coalesce(before, F.lit(0))).drop(value)


def delta_undo(df: DataFrame, block: str, value: str, order: str) -> DataFrame:
    return df.withColumn(value, F.sum("code").over(in_block(block, order))).drop("code")


def run_lengths(df: DataFrame, block: str, value: str, order: str) -> DataFrame:
    """(block, start, length, value): runs of equal neighbours, by their places in the block; nulls equal each other."""
    w = in_block(block, order)
    new = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    x = df.select(block, order, value, (F.row_number().over(w) - 1).alias("place"), new.cast("int").alias("new"))
    x = x.withColumn("run", F.sum("new").over(w))
    runs = x.groupBy(block, "run").agg(F.min("place").alias("start"), F.count("*").alias("length"), F.first(value).alias(value))
    return runs.drop("run")


def run_undo(runs: DataFrame, block: str, value: str) -> DataFrame:
    """(block, place, value) of ``run_lengths``."""
    places = F.sequence(F.col("start").cast("long"), F.col("start") + F.col("length") - 1)
    return runs.select(block, F.explode(places).alias("place"), value)


def dictionary(df: DataFrame, block: str, value: str) -> DataFrame:
    """``df`` with ``code``, the place of ``value`` among the block's values in order, and the block's sorted ``words``."""
    words = df.groupBy(block).agg(F.array_sort(F.collect_set(value)).alias("words"))
    code = F.when(F.col(value).isNotNull(), F.dense_rank().over(Window.partitionBy(block).orderBy(F.col(value).asc_nulls_last())) - 1)
    return df.withColumn("code", code).drop(value).join(words, block)


def dictionary_undo(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.when(F.col("code").isNotNull(), F.get("words", F.col("code")))).drop("code", "words")


def hierarchy(df: DataFrame, block: str, parent: str, child: str) -> DataFrame:
    """``df`` with ``code``, the place of a child among its parent's in the block, and the parent's ``words``."""
    return dictionary(df.withColumn("family", F.struct(block, parent)), "family", child).drop("family")


def _digits(value: Column, exponent: int) -> Column:
    """The value as a whole number of 10^-exponent, null where that isn't the same double."""
    scale = float(10**exponent)
    whole = F.rint(value * scale)
    exact = (F.abs(whole) < float(1 << 53)) & (whole / scale == value)
    return F.when(exact & ~((whole == 0) & F.startswith(value.cast("string"), F.lit("-"))), whole.cast("long"))


def decimal_digits(df: DataFrame, block: str, value: str) -> DataFrame:
    """``df`` with doubles as whole numbers (``code``) of the block's ``exponent``; those that don't fit stay as ``odd``.

    The exponent is the one under which a block takes the fewest bits, the least among equals.
    """
    v = F.col(value)
    sizes = [_decimal_bits(_digits(v, e), F.count(v)) for e in EXPONENTS]
    each = F.array(*(F.struct(s.alias("bits"), F.lit(e).alias("exponent")) for e, s in zip(EXPONENTS, sizes)))
    best = df.groupBy(block).agg(F.array_min(each)["exponent"].alias("exponent"))
    code = F.coalesce(*(F.when(F.col("exponent") == e, _digits(v, e)) for e in EXPONENTS))
    return df.join(best, block).withColumn("code", code).withColumn("odd", F.when(F.col("code").isNull(), v)).drop(value)


def _decimal_bits(digits: Column, n: Column) -> Column:
    fit = F.count(digits)
    width = F.coalesce(bits(F.max(digits) - F.min(digits)), F.lit(0))
    return EXPONENT + PLAIN + fit * width + (n - fit) * (PLAIN + PLACE)


def decimal_undo(df: DataFrame, value: str) -> DataFrame:
    scale = F.element_at(F.array(*(F.lit(float(10**e)) for e in EXPONENTS)), F.col("exponent") + 1)
    return df.withColumn(value, F.coalesce(F.col("code") / scale, "odd")).drop("code", "odd", "exponent")


def sizes(df: DataFrame, block: str, value: str, order: str) -> DataFrame:
    """(block, scheme, bits) of whole numbers without nulls under each scheme that can hold them."""
    before = F.lag(value).over(in_block(block, order))
    x = df.select(block, F.col(value).alias("v"), (F.col(value) - before).alias("d"))
    per = x.groupBy(block).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("d").alias("dlo"), F.max("d").alias("dhi"),
        F.count_if(F.col("d").isNull() | (F.col("d") != 0)).alias("runs"), F.count_distinct("v").alias("kinds"),
    )
    n, one = F.col("n"), F.col("n") - 1
    size = {
        "bitpack": F.when(F.col("lo") >= 0, n * bits(F.col("hi"))),
        "for": PLAIN + n * bits(F.col("hi") - F.col("lo")),
        "delta": 2 * PLAIN + one * F.coalesce(bits(F.col("dhi") - F.col("dlo")), F.lit(0)),
        "rle": F.col("runs") * (PLAIN + PLACE),
        "dict": F.col("kinds") * PLAIN + n * bits(F.col("kinds") - 1),
        "raw": n * PLAIN,
    }
    each = F.array(*(F.struct(F.lit(s).alias("scheme"), size[s].cast("long").alias("bits")) for s in SCHEMES))
    return per.select(block, F.inline(each)).where("bits is not null")


def picked(sizes: DataFrame, block: str, among: list[str] = SCHEMES) -> DataFrame:
    """(block, scheme, bits): what takes least, of equals the first of ``among``."""
    place = F.array_position(F.array(*map(F.lit, among)), F.col("scheme"))
    best = F.min_by(F.struct("scheme", "bits"), F.struct("bits", place.alias("place"))).alias("best_scheme")
    return sizes.where(F.col("scheme").isin(among)).groupBy(block).agg(best).select(block, "best_scheme.*")
