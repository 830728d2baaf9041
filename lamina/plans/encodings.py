"""Encodings by blocks, learned routes and the order of background work as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import encodings as E
from lamina.functions import policy as PO
from lamina.functions import routing as R
from lamina.plans.engine import _customers, _root
from lamina.plans.registry import query, table as t
from lamina.plans.statistics import _KIND, _LOG, _SEGS, _queries, _segments

_X = "SELECT o_orderkey // 1024 AS block, o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_totalprice FROM orders"
_BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


def _orders(s, d, *columns: str):
    return t(s, d, "orders").select(F.floor(F.col("o_orderkey") / 1024).alias("block"), "o_orderkey", *columns)


_SIZES = f"""WITH x AS (SELECT block, o_custkey AS v, o_custkey - lag(o_custkey) OVER (PARTITION BY block ORDER BY o_orderkey) AS d FROM ({_X})),
p AS (SELECT block, count(*) AS n, min(v) AS lo, max(v) AS hi, max(d) - min(d) AS dd, count(*) FILTER (d IS NULL OR d <> 0) AS runs, count(DISTINCT v) AS kinds
 FROM x GROUP BY block)
SELECT block, 'bitpack' AS scheme, n * ({_BITS.format('hi')}) AS bits FROM p WHERE lo >= 0 UNION ALL SELECT block, 'for', 64 + n * ({_BITS.format('(hi - lo)')}) FROM p
UNION ALL SELECT block, 'delta', 128 + (n - 1) * coalesce({_BITS.format('dd')}, 0) FROM p UNION ALL SELECT block, 'rle', runs * 80 FROM p
UNION ALL SELECT block, 'dict', kinds * 64 + n * ({_BITS.format('(kinds - 1)')}) FROM p UNION ALL SELECT block, 'raw', n * 64 FROM p"""


@query(_SIZES)
def encoded_sizes(s, d):
    return E.sizes(_orders(s, d, "o_custkey"), "block", "o_custkey", "o_orderkey")


@query(f"""SELECT block, scheme, bits FROM ({_SIZES}) WHERE scheme IN ('bitpack', 'for', 'delta')
 QUALIFY row_number() OVER (PARTITION BY block ORDER BY bits, CASE scheme WHEN 'bitpack' THEN 1 WHEN 'for' THEN 2 ELSE 3 END) = 1""")
def encoding_picked(s, d):
    """What a writer of whole numbers takes for each block."""
    return E.picked(E.sizes(_orders(s, d, "o_custkey"), "block", "o_custkey", "o_orderkey"), "block", ["bitpack", "for", "delta"])


@query(f"SELECT block, o_orderkey, min(o_custkey) OVER (PARTITION BY block) AS reference, o_custkey - min(o_custkey) OVER (PARTITION BY block) AS code FROM ({_X})")
def encode_for(s, d):
    return E.reference_frame(_orders(s, d, "o_custkey"), "block", "o_custkey")


@query(f"SELECT block, o_orderkey, o_custkey - coalesce(lag(o_custkey) OVER (PARTITION BY block ORDER BY o_orderkey), 0) AS code FROM ({_X})")
def encode_delta(s, d):
    return E.delta(_orders(s, d, "o_custkey"), "block", "o_custkey", "o_orderkey")


@query(f"""WITH x AS (SELECT *, row_number() OVER w - 1 AS place, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN 1 ELSE 0 END AS new
 FROM ({_X}) WINDOW w AS (PARTITION BY block ORDER BY o_orderkey)), r AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY place) AS run FROM x)
SELECT block, min(place) AS start, count(*) AS length, any_value(o_orderstatus) AS o_orderstatus FROM r GROUP BY block, run""")
def encode_rle(s, d):
    return E.run_lengths(_orders(s, d, "o_orderstatus"), "block", "o_orderstatus", "o_orderkey")


@query(f"SELECT block, o_orderkey, dense_rank() OVER (PARTITION BY block ORDER BY o_orderstatus) - 1 AS code FROM ({_X})")
def encode_dictionary(s, d):
    return E.dictionary(_orders(s, d, "o_orderstatus"), "block", "o_orderstatus").select("block", "o_orderkey", "code")


@query(f"SELECT block, o_orderkey, dense_rank() OVER (PARTITION BY block, o_orderstatus ORDER BY o_custkey) - 1 AS code FROM ({_X})")
def encode_hierarchy(s, d):
    return E.hierarchy(_orders(s, d, "o_orderstatus", "o_custkey"), "block", "o_orderstatus", "o_custkey").select("block", "o_orderkey", "code")


@query(f"SELECT block, o_orderkey, 2 AS exponent, CAST(round(o_totalprice * 100) AS BIGINT) AS code FROM ({_X})")
def encode_decimals(s, d):
    """Prices have two digits, so no block keeps one as it is."""
    x = E.decimal_digits(_orders(s, d, "o_totalprice"), "block", "o_totalprice")
    return x.select("block", "o_orderkey", "exponent", F.when(F.col("odd").isNull(), F.col("code")).alias("code"))


_BACK = {"for": "o_custkey", "delta": "o_custkey", "rle": "o_orderstatus", "dict": "o_orderstatus", "corra_hier": "o_custkey", "alp": "CAST(round(o_totalprice * 100) AS BIGINT)"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS scheme, o_orderkey, CAST({v} AS VARCHAR) AS value FROM orders" for k, v in _BACK.items()))
def encodings_round_trip(s, d):
    """Each scheme there and back gives the column that went in; prices are shown in cents."""
    x = _orders(s, d, "o_custkey", "o_orderstatus", "o_totalprice")
    own = lambda *c: x.select("block", "o_orderkey", *c)
    cust, status, both = own("o_custkey"), own("o_orderstatus"), own("o_orderstatus", "o_custkey")
    runs = E.run_undo(E.run_lengths(status, "block", "o_orderstatus", "o_orderkey"), "block", "o_orderstatus")
    places = status.drop("o_orderstatus").withColumn("place", (F.row_number().over(E.in_block("block", "o_orderkey")) - 1).cast("long"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    back = {
        "for": E.reference_undo(E.reference_frame(cust, "block", "o_custkey"), "o_custkey").withColumn("value", F.col("o_custkey")),
        "delta": E.delta_undo(E.delta(cust, "block", "o_custkey", "o_orderkey"), "block", "o_custkey", "o_orderkey").withColumn("value", F.col("o_custkey")),
        "rle": places.join(runs, ["block", "place"]).withColumn("value", F.col("o_orderstatus")),
        "dict": E.dictionary_undo(E.dictionary(status, "block", "o_orderstatus"), "o_orderstatus").withColumn("value", F.col("o_orderstatus")),
        "corra_hier": E.dictionary_undo(E.hierarchy(both, "block", "o_orderstatus", "o_custkey"), "o_custkey").withColumn("value", F.col("o_custkey")),
        "alp": E.decimal_undo(E.decimal_digits(own("o_totalprice"), "block", "o_totalprice"), "o_totalprice").withColumn("value", cents),
    }
    parts = [got.select(F.lit(scheme).alias("scheme"), "o_orderkey", F.col("value").cast("string").alias("value")) for scheme, got in back.items()]
    return reduce(DataFrame.unionByName, parts)


# learned routes

_FILTERS = "CASE WHEN share >= 0.9 THEN 0 WHEN share >= 0.5 THEN 1 WHEN share >= 0.1 THEN 2 WHEN share >= 0.01 THEN 3 WHEN share >= 0.001 THEN 4 ELSE 5 END"
_NUMBERS = f"""SELECT event_id, kind, event_id % 7 AS plan, least(greatest(share, 0), 1) AS f_share, least(log10(1000000 + 1) / 9, 1) AS f_rows,
 least(log2({_FILTERS} + 1) / log2(20), 1) AS f_filters, least(log2(3 + 1) / log2(64), 1) AS f_columns, least(log2(deltas + 1) / log2(1024), 1) AS f_deltas
 FROM (SELECT *, {_KIND} AS kind FROM ({_LOG}))"""


def _features(s, d):
    kind = R.kind_of(F.col("filtered"), F.col("aggregated"), F.col("share"))
    f = R.plan_features(kind, F.col("share"), F.lit(1_000_000), F.lit(3), F.col("deltas"))
    return _queries(s, d).select("event_id", (F.col("event_id") % 7).alias("plan"), f.alias("f"))


_ROUND = ", ".join(f"round(avg({c}), 8) AS {c}" for c in ("f_share", "f_rows", "f_filters", "f_columns", "f_deltas"))
_ONE_HOT = ", ".join(f"round(avg(CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END), 8) AS is_{k}" for k in R.KINDS)


@query(f"SELECT plan, {_ONE_HOT}, {_ROUND} FROM ({_NUMBERS}) GROUP BY plan")
def plan_features(s, d):
    """Features of several nodes of a plan are their mean."""
    return R.pooled(_features(s, d), "plan").select("plan", *(F.round(F.get("f", F.lit(i)), 8).alias(c) for i, c in enumerate(R.FEATURES)))


_COST = {"delta": "1 + 3 * f_share + 2 * f_deltas", "columnar": "2 - f_share + 0.25 * f_filters", "merge": "2.5 - 2 * f_deltas + f_share"}


def _costs(at) -> dict:
    """Times on each path that are linear in the features; ``_COST`` says the same in SQL."""
    return {
        "delta": 1 + 3 * at["f_share"] + 2 * at["f_deltas"],
        "columnar": 2 - at["f_share"] + 0.25 * at["f_filters"],
        "merge": 2.5 - 2 * at["f_deltas"] + at["f_share"],
    }


_LEARNED = f"SELECT event_id, {', '.join(f'{e} AS {p}' for p, e in _COST.items())} FROM ({_NUMBERS})"


@query(f"""SELECT event_id, round("delta", 6) AS "delta", round(columnar, 6) AS columnar, round(merge, 6) AS merge,
 CASE WHEN merge < least("delta", columnar) * 0.9 THEN 'merge' WHEN "delta" <= columnar THEN 'delta' ELSE 'columnar' END AS path FROM ({_LEARNED})""")
def learned_costs(s, d):
    """A linear model fitted to times that are linear in the features gives them again."""
    f = _features(s, d)
    log = f.select("event_id", "f", *(c.alias(p) for p, c in _costs({c: F.get("f", F.lit(i)) for i, c in enumerate(R.FEATURES)}).items()))
    cost = {p: F.round(c, 9) for p, c in R.predicted(R.fit(log, list(_COST))).items()}
    return f.select("event_id", *(F.round(c, 6).alias(p) for p, c in cost.items()), R.learned_path(cost).alias("path"))


_BOTH = "SELECT user_id % 7 AS \"table\", event_type AS chosen, coalesce(value, 0) AS chosen_ms, user_id % 300 AS other_ms FROM events"


@query(f"""SELECT "table", count(*) AS n, round(avg(CASE WHEN chosen_ms <= other_ms THEN 1.0 ELSE 0.0 END), 6) AS agreement,
 round(avg(greatest(chosen_ms - other_ms, 0)), 5) AS saved_ms
 FROM ({_BOTH} WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) < {int(R.SHADOW_SHARE * 2**32)}) GROUP BY "table" """)
def shadow_timing(s, d):
    """Queries whose other path is timed too, a sample of 5 % by hash, which is the feature."""
    e = t(s, d, "events").where(R.shadowed(F.col("event_id")))
    user, ms = F.col("user_id"), F.coalesce("value", F.lit(0.0))
    log = e.select((user % 7).alias("table"), F.col("event_type").alias("chosen"), ms.alias("chosen_ms"), (user % 300).alias("other_ms"))
    return R.shadow_evidence(log).withColumns({"agreement": F.round("agreement", 6), "saved_ms": F.round("saved_ms", 5)})


# the order of background work


@query("""SELECT "table", column_ AS "column", round(weight, 5) AS weight FROM (SELECT user_id % 7 AS "table", event_type AS column_, sum(1 - value / 1000) AS weight
 FROM events WHERE value IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY weight DESC, column_) = 1""")
def rewrite_keys(s, d):
    log = t(s, d, "events").where("value is not null").select(
        (F.col("user_id") % 7).alias("table"), F.col("event_type").alias("column"), (F.col("value") / 1000).alias("share"),
    )
    return PO.rewrite_keys(log).withColumn("weight", F.round("weight", 5))


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE (c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL)")
def query_driven_rewrite(s, d):
    """A table rewritten in the order of the column that its queries filter on reads the same."""
    _, k, _ = _customers(s, d)
    k.compact(files=2, by="c_nationkey")
    return k.scan(columns=["c_custkey", "c_nationkey", "c_acctbal"])


@query(f"""SELECT segment, round(coalesce(sum(size_bytes) OVER (PARTITION BY segment % 4 ORDER BY segment % 3, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 / 8388608.0, 6) AS begin_second FROM ({_SEGS})""")
def io_schedule(s, d):
    """Flushes before low before high levels on each device, at eight megabytes a second."""
    k = F.col("segment")
    tasks = _segments(s, d).select("segment", "size_bytes", (k % 4).alias("device"), (k % 3).alias("priority"), k.alias("seq"))
    return PO.io_schedule(tasks, 8 * 1024 * 1024.0).select("segment", F.round("begin_second", 6).alias("begin_second"))


@query("""SELECT "window", part, count(*) AS n, max(seq) AS last FROM (SELECT "window", seq, (row_number() OVER (PARTITION BY "window" ORDER BY seq) - 1) // 10 AS part
 FROM (SELECT epoch_us(ts) // 3600000000 AS "window", event_id AS seq FROM events)) GROUP BY "window", part""")
def group_commits(s, d):
    """Events as commits, those of an hour synced together, ten at a time."""
    log = t(s, d, "events").select("ts", F.col("event_id").alias("seq"))
    return PO.commit_groups(log, window_ms=3_600_000, most=10)
