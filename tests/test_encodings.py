"""Encodings by blocks: there and back on nulls, ties and odd numbers; what a log of routes teaches."""

import math

from pyspark.sql import functions as F

from lamina.functions import encodings as E
from lamina.functions import routing as R

ROWS = [(0, 0, 5, "a", 1.25), (0, 1, 5, None, -0.0), (0, 2, None, "a", math.pi), (0, 3, -7, "a", None), (1, 4, 9, None, float("nan")), (1, 5, 9, None, 1e300), (2, 6, None, "", -3.5)]


def rows(spark):
    return spark.createDataFrame(ROWS, "b int, k int, v long, w string, x double")


def test_round_trips(spark):
    own = lambda c: sorted((r.k, str(r[c])) for r in rows(spark).collect())
    got = lambda df, c: sorted((r.k, str(r[c])) for r in df.collect())
    assert got(E.reference_undo(E.reference_frame(rows(spark), "b", "v"), "v"), "v") == own("v")
    assert got(E.dictionary_undo(E.dictionary(rows(spark), "b", "w"), "w"), "w") == own("w")
    assert got(E.dictionary_undo(E.hierarchy(rows(spark), "b", "w", "v"), "v"), "v") == own("v")
    decimals = E.decimal_digits(rows(spark), "b", "x")
    assert got(E.decimal_undo(decimals, "x"), "x") == own("x")
    assert {r.k for r in decimals.collect() if r.odd is not None} == {1, 2, 4, 5}  # negative zero, pi, nan, too large


def test_runs_keep_nulls_apart(spark):
    runs = sorted((r.b, r.start, r.length, r.w) for r in E.run_lengths(rows(spark), "b", "w", "k").collect())
    assert runs == [(0, 0, 1, "a"), (0, 1, 1, None), (0, 2, 2, "a"), (1, 0, 2, None), (2, 0, 1, "")]
    back = E.run_undo(E.run_lengths(rows(spark), "b", "w", "k"), "b", "w")
    assert sorted((r.b, r.place, str(r.w)) for r in back.collect()) == [(0, 0, "a"), (0, 1, "None"), (0, 2, "a"), (0, 3, "a"), (1, 0, "None"), (1, 1, "None"), (2, 0, "")]


def test_empty(spark):
    none = rows(spark).limit(0)
    for df in (E.sizes(none, "b", "v", "k"), E.run_lengths(none, "b", "w", "k"), E.decimal_digits(none, "b", "x"), E.dictionary(none, "b", "w")):
        assert df.count() == 0


def test_least_bits_win(spark):
    values = [(0, i, 1000 + i) for i in range(64)] + [(1, i, 7) for i in range(64)] + [(2, i, i * 7919 % 64) for i in range(64)]
    sizes = E.sizes(spark.createDataFrame(values, "b int, k int, v long"), "b", "v", "k")
    assert {r.b: r.scheme for r in E.picked(sizes, "b").collect()} == {0: "delta", 1: "for", 2: "bitpack"}


def test_fit_ignores_rows_without_a_time(spark):
    n = len(R.FEATURES)
    log = [([float(i == j) for j in range(n)], 2.0 * i, None if i % 2 else 1.0) for i in range(n)] + [(None, 99.0, 99.0)]
    log = spark.createDataFrame(log, "f array<double>, a double, b double")
    cost = R.predicted(R.fit(log, ["a", "b"]))
    got = log.where("f is not null").select("a", cost["a"].alias("pa"), cost["b"].alias("pb"), "b").collect()
    assert all(abs(r.a - r.pa) < 1e-6 and (r.b is None or abs(r.b - r.pb) < 1e-6) for r in got)


def test_shadow_share(spark):
    share = spark.range(20_000).agg(F.avg(R.shadowed(F.col("id")).cast("double"))).first()[0]
    assert 0.04 < share < 0.06
