"""Statistics, column analytics, routing and compaction policies as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import policy as PO
from lamina.functions import predicate as PR
from lamina.functions import routing as R
from lamina.functions import stats as S
from lamina.plans.registry import query, table as t


@query("SELECT o_orderkey // 1024 AS block, count(*) AS n, 'o_totalprice' AS \"column\", min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) FILTER (o_totalprice IS NULL) AS nulls FROM orders GROUP BY 1")
def block_statistics(s, d):
    b = S.block_stats(t(s, d, "orders"), F.floor(F.col("o_orderkey") / 1024), ["o_totalprice"])
    return b.select("block", "n", "column", F.col("min").cast("double").alias("lo"), F.col("max").cast("double").alias("hi"), "nulls")


@query("SELECT min(n_chars) AS min, max(n_chars) AS max, count(*) FILTER (n_chars IS NULL) AS nulls, count(*) AS n FROM documents")
def merged_statistics(s, d):
    return S.merge_stats(S.block_stats(t(s, d, "documents"), F.col("doc_id") % 10, ["n_chars"]), "n_chars", "long")


@query("SELECT count(*) AS n, 'source' AS \"column\", count(*) FILTER (source IS NULL) AS nulls, count(DISTINCT source) AS distinct_, min(source) AS min, max(source) AS max FROM documents UNION ALL SELECT count(*), 'doc_id', 0, count(DISTINCT doc_id), CAST(min(doc_id) AS VARCHAR), CAST(max(doc_id) AS VARCHAR) FROM documents")
def table_statistics(s, d):
    return S.table_stats(t(s, d, "documents"), ["source", "doc_id"]).withColumnRenamed("distinct", "distinct_")


_FEAT = """
WITH x AS (SELECT o_orderstatus AS g, o_custkey AS v, o_orderkey AS k, lag(o_custkey) OVER w AS p, row_number() OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)),
r AS (SELECT *, sum(CASE WHEN i = 1 OR v IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY k) AS run FROM x),
l AS (SELECT g, avg(c) AS run_avg, max(c) AS run_max FROM (SELECT g, run, count(*) AS c FROM r GROUP BY g, run) GROUP BY g),
e AS (SELECT g, sum(-h * log2(h)) AS entropy, count(*) AS dist FROM (SELECT g, v, count(*) / sum(count(*)) OVER (PARTITION BY g) AS h FROM x GROUP BY g, v) GROUP BY g)
SELECT g AS o_orderstatus, count(*) AS n, round(any_value(dist) / count(*), 6) AS cardinality_ratio, round(any_value(entropy), 5) AS entropy, round(any_value(run_avg), 5) AS run_avg, any_value(run_max) AS run_max,
 round(log2(max(v) - min(v) + 1), 5) AS range_log2, round(avg(CASE WHEN p IS NOT NULL THEN CASE WHEN v >= p THEN 1 ELSE 0 END END), 5) AS sortedness FROM x JOIN l USING (g) JOIN e USING (g) GROUP BY g"""


@query(_FEAT)
def column_features(s, d):
    f = S.column_features(t(s, d, "orders"), "o_custkey", ["o_orderkey"], group="o_orderstatus")
    r = lambda c, k=5: F.round(c, k).alias(c)
    return f.select("o_orderstatus", "n", r("cardinality_ratio", 6), r("entropy"), r("run_avg"), "run_max", r("range_log2"), r("sortedness"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(count(*) / count(DISTINCT l_quantity), 5) AS children, CASE WHEN corr(l_quantity, l_extendedprice) > 0.9 THEN 'peer_diff' WHEN count(*) / count(DISTINCT l_quantity) > 1.2 THEN 'subaltern' ELSE 'none' END AS relation FROM lineitem")
def column_correlation(s, d):
    return S.correlation(t(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 6).alias("r"), F.round("children", 5).alias("children"), "relation")


@query("SELECT o_orderkey, o_orderkey - o_custkey AS diff FROM orders")
def peer_difference(s, d):
    return S.peer_diff(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "diff")


@query("SELECT o_orderkey, o_custkey FROM orders")
def peer_round_trip(s, d):
    x = S.peer_diff(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "diff")
    return S.peer_undo(x, "o_orderkey", "diff", "o_custkey")


@query("SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) - (SELECT min(o_orderkey) FROM orders) AS parent_offset, o_orderkey - min(o_orderkey) OVER (PARTITION BY o_custkey) AS child_offset, (SELECT min(o_orderkey) FROM orders) AS global_min FROM orders")
def subaltern_offsets(s, d):
    return S.subaltern(t(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


_FALLS = "max(CASE WHEN {0} < {0}_before THEN 1 ELSE 0 END)"
_BEFORE = "SELECT *, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS o_orderkey_before, lag(o_custkey) OVER (ORDER BY o_orderkey) AS o_custkey_before FROM orders"


@query(f"""SELECT 'o_orderkey' AS "column", CASE WHEN {_FALLS.format('o_orderkey')} = 1 THEN 'bitpack' ELSE 'delta' END AS advice FROM ({_BEFORE})
 UNION ALL SELECT 'o_custkey', CASE WHEN {_FALLS.format('o_custkey')} = 1 THEN 'bitpack' ELSE 'delta' END FROM ({_BEFORE})
 UNION ALL SELECT column_name, CASE data_type WHEN 'DOUBLE' THEN 'alp' ELSE 'raw' END FROM information_schema.columns WHERE table_name = 'orders' AND column_name = 'o_totalprice'
 UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) < 1000 THEN 'dictionary' ELSE 'raw' END FROM orders""")
def encoding_advice(s, d):
    return S.encoding_advice(t(s, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"], ["o_orderkey"])


@query("SELECT 'orders' AS \"table\", event_type AS \"column\", round(avg(value / 1000), 6) AS share, count(*) AS n FROM (SELECT * FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1000) GROUP BY event_type")
def observed_selectivity(s, d):
    log = t(s, d, "events").where("value is not null").select(F.lit("orders").alias("table"), F.col("event_type").alias("column"), F.col("event_id").alias("seq"), F.col("value").alias("rows"), F.lit(1000.0).alias("total"))
    return R.observed_share(log).withColumn("share", F.round("share", 6))


@query("SELECT user_id % 50 AS segment, count(*) AS queries, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS hit_ratio, round(1 - avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS staleness FROM events GROUP BY 1")
def segment_feedback(s, d):
    log = t(s, d, "events").select((F.col("user_id") % 50).alias("segment"), (F.col("event_type") == "click").alias("hit"))
    return R.segment_feedback(log).withColumns({c: F.round(c, 6) for c in ("hit_ratio", "staleness")})


_SEGS = "SELECT s_suppkey AS segment, (s_suppkey % 10) / 10.0 AS del_ratio, s_suppkey * 300000 AS size_bytes, 1.0 + s_suppkey % 24 AS age_hours, (s_suppkey % 4) / 4.0 AS staleness, (s_suppkey % 5) / 5.0 AS hit_ratio FROM supplier"


def _segments(s, d):
    k = F.col("s_suppkey")
    return t(s, d, "supplier").select(k.alias("segment"), ((k % 10) / 10.0).alias("del_ratio"), (k * 300000).alias("size_bytes"), (1.0 + k % 24).alias("age_hours"), ((k % 4) / 4.0).alias("staleness"), ((k % 5) / 5.0).alias("hit_ratio"))


@query(f"SELECT segment, round(power(del_ratio, 2) * 10 + log2(greatest(size_bytes / 1048576.0, 1)) * 0.3 + log2(age_hours) * 0.2 + staleness * 5 + (1 - hit_ratio) * 3, 6) AS priority FROM ({_SEGS})")
def compaction_priority(s, d):
    return _segments(s, d).select("segment", F.round(PO.priority(), 6).alias("priority"))


@query(f"SELECT segment, CASE WHEN del_ratio > 0.5 THEN 'rewrite' WHEN 1 - hit_ratio > 0.5 THEN 'query_driven' WHEN staleness > 0.5 THEN 'refresh' WHEN size_bytes < 1048576 THEN 'small_files' END AS action FROM ({_SEGS})")
def compaction_action(s, d):
    return _segments(s, d).select("segment", PO.action().alias("action"))


@query("SELECT user_id AS segment, round(sum(v * power(0.875, age)) * 0.125, 6) AS score FROM (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age FROM events WHERE value IS NOT NULL) GROUP BY user_id")
def access_ewma(s, d):
    return PO.ewma(t(s, d, "events").where("value is not null"), "user_id", "value", "event_id", 0.875).select(F.col("user_id").alias("segment"), F.round("score", 6).alias("score"))


@query("SELECT s_suppkey AS segment, (s_suppkey % 10) / 10.0 * 0.6 + (s_suppkey % 7) / 7.0 * 0.4 AS score FROM supplier WHERE (s_suppkey % 10) / 10.0 > 0.3 AND (s_suppkey % 7) / 7.0 > 0.3")
def range_reduce(s, d):
    k = F.col("s_suppkey")
    x = t(s, d, "supplier").select(k.alias("segment"), ((k % 10) / 10.0).alias("hot"), ((k % 7) / 7.0).alias("overlap"))
    return PO.range_reduce(x).select("segment", "score")


#: events as a log of queries: whether there is a filter or an aggregate, the share of rows and the deltas in the way.
_LOG = "SELECT event_id, event_type <> 'view' AS filtered, event_type = 'purchase' AND user_id % 2 = 0 AS aggregated, coalesce(value, 0) / 1000 AS share, user_id % 150 AS deltas, user_id % 5 = 0 AS pending FROM events"
_KIND = "CASE WHEN aggregated THEN 'aggregate' WHEN NOT filtered THEN 'full_scan' WHEN share < 0.01 THEN 'point_get' ELSE 'range_scan' END"


def _queries(s, d):
    kind, user = F.col("event_type"), F.col("user_id")
    share = (F.coalesce("value", F.lit(0.0)) / 1000).alias("share")
    return t(s, d, "events").select("event_id", (kind != "view").alias("filtered"), ((kind == "purchase") & (user % 2 == 0)).alias("aggregated"), share, (user % 150).alias("deltas"), (user % 5 == 0).alias("pending"))


@query(f"SELECT event_id, {_KIND} AS kind FROM ({_LOG})")
def query_kinds(s, d):
    return _queries(s, d).select("event_id", R.kind_of(F.col("filtered"), F.col("aggregated"), F.col("share")).alias("kind"))


@query(f"""SELECT event_id, CASE WHEN kind = 'point_get' THEN 'delta' WHEN NOT pending AND deltas = 0 THEN 'columnar' WHEN share < 0.01 THEN 'delta'
 WHEN share > 0.1 THEN 'columnar' WHEN deltas > 100 THEN 'merge' END AS path FROM (SELECT *, {_KIND} AS kind FROM ({_LOG}))""")
def route_rules(s, d):
    q = _queries(s, d).withColumn("kind", R.kind_of(F.col("filtered"), F.col("aggregated"), F.col("share")))
    return q.select("event_id", R.rule_of(*map(F.col, ("kind", "share", "deltas", "pending"))).alias("path"))


_TIMES = "SELECT event_type AS path, user_id % 7 AS \"table\", CASE user_id % 3 WHEN 0 THEN 'proxy' WHEN 1 THEN 'dual' ELSE 'measured' END AS source, coalesce(value, 0) AS ms FROM events WHERE user_id % 7 <> 3 OR user_id % 3 = 0"


def _times(s, d):
    user = F.col("user_id")
    source = F.when(user % 3 == 0, "proxy").when(user % 3 == 1, "dual").otherwise("measured")
    e = t(s, d, "events").where((user % 7 != 3) | (user % 3 == 0))
    return e.select(F.col("event_type").alias("path"), (user % 7).alias("table"), source.alias("source"), F.coalesce("value", F.lit(0.0)).alias("ms"))


@query(f"""WITH x AS (SELECT "table", path, source, avg(ms) AS mean_ms, count(*) AS runs FROM ({_TIMES}) GROUP BY ALL)
 SELECT "table", path, source, round(mean_ms, 5) AS mean_ms, runs FROM x QUALIFY row_number() OVER (PARTITION BY "table", path ORDER BY CASE source WHEN 'measured' THEN 1 WHEN 'dual' THEN 2 ELSE 3 END) = 1""")
def execution_history(s, d):
    return R.evidence(_times(s, d)).withColumn("mean_ms", F.round("mean_ms", 5))


@query(f"""SELECT "table", path, round(CASE WHEN count(*) >= 3 THEN 100 * 0.7 + avg(ms) * 0.3 ELSE 100 END, 5) AS cost FROM ({_TIMES}) GROUP BY ALL""")
def blended_costs(s, d):
    seen = _times(s, d).groupBy("table", "path").agg(F.count("*").alias("runs"), F.avg("ms").alias("mean_ms"))
    return seen.select("table", "path", F.round(R.blended(F.lit(100.0), F.col("runs"), F.col("mean_ms")), 5).alias("cost"))


@query(f"""SELECT "table", path, round(least(greatest(1.0 * (1 + avg(ms / 100 - 1) * 0.001 / sqrt(1 + count(*) * 1e-6)), 0.001), 100.0), 8) AS cpu FROM ({_TIMES}) GROUP BY ALL""")
def calibrated_costs(s, d):
    seen = _times(s, d).groupBy("table", "path").agg(F.count("*").alias("runs"), F.avg(F.col("ms") / 100 - 1).alias("error"))
    return seen.select("table", "path", F.round(R.calibrated(F.lit(1.0), F.col("error"), F.col("runs")), 8).alias("cpu"))


@query("""SELECT 'events' AS "table", least(event_type, 'value') AS column1, greatest(event_type, 'value') AS column2, round(avg(value / 1000), 6) AS share, count(*) AS n
 FROM (SELECT * FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1000) GROUP BY event_type""")
def observed_pairs(s, d):
    log = t(s, d, "events").where("value is not null").select(
        F.lit("events").alias("table"), F.col("event_type").alias("column"), F.lit("value").alias("column2"), F.col("event_id").alias("seq"), F.col("value").alias("rows"), F.lit(1000.0).alias("total"),
    )
    return R.observed_pairs(log).withColumn("share", F.round("share", 6))


@query("WITH n AS (SELECT count(*) AS c FROM orders) SELECT c * 1.0 + c * 64 * 0.001 AS delta, c * 1.5 + c * 64 * 0.5 * 0.001 AS columnar, 7 * 10 + (c * 1.5 + c * 64 * 0.5 * 0.001) * 1.5 AS merge FROM n")
def route_costs(s, d):
    c = R.costs(t(s, d, "orders").count(), 64, 7)
    return s.createDataFrame([(float(c["delta"]), float(c["columnar"]), float(c["merge"]))], "delta double, columnar double, merge double")


@query("SELECT round((1 - (1 - 1.0 / count(DISTINCT o_custkey)) * (1 - (50000.0 - min(o_totalprice)) / (max(o_totalprice) - min(o_totalprice)))), 8) AS share FROM orders")
def selectivity_estimate(s, d):
    r = t(s, d, "orders").agg(F.count_distinct("o_custkey"), F.min("o_totalprice"), F.max("o_totalprice")).first()
    st = {"o_custkey": PR.ColumnStats(distinct=r[0]), "o_totalprice": PR.ColumnStats(r[1], r[2], 1)}
    x = PR.selectivity(PR.parse("o_custkey = 5 OR o_totalprice < 50000"), st)
    return s.createDataFrame([(round(x, 8),)], "share double")


# pruning by statistics: the block's minima and maxima as rows, the filter as a condition over them

_BLOCKS = "SELECT o_orderkey // 1024 AS block, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, min(o_custkey) AS o_custkey_min, max(o_custkey) AS o_custkey_max FROM orders GROUP BY 1"


def _wide_blocks(s, d):
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    return t(s, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 1024).alias("block")).agg(
        F.min(price).alias("o_totalprice_min"), F.max(price).alias("o_totalprice_max"), F.min(cust).alias("o_custkey_min"), F.max(cust).alias("o_custkey_max"),
    )


def _skip(name: str, text: str, sql: str):
    @query(f"SELECT block FROM ({_BLOCKS}) WHERE {sql}", name=name)
    def run(s, d):
        return _wide_blocks(s, d).where(PR.overlap(PR.pruning(PR.parse(text)))).select("block")


_skip("prune_and", "o_totalprice > 440000 AND o_custkey <= 20", "o_totalprice_max > 440000 AND o_custkey_min <= 20")
_skip("prune_or_group", "o_totalprice < 900 OR o_totalprice >= 450000 OR o_totalprice = 1000", "(o_totalprice_min < 900 OR o_totalprice_max >= 450000 OR (o_totalprice_min <= 1000 AND o_totalprice_max >= 1000))")
_skip("prune_or_columns", "o_totalprice < 0 OR o_custkey = 3", "TRUE")
_skip("prune_not", "NOT o_totalprice > 0 AND o_custkey < 5", "o_custkey_min < 5")


@query("""SELECT b.block // 8 AS granule, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n FROM
 (SELECT o_orderkey // 1024 AS block, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY 1) b GROUP BY 1""")
def granule_statistics(s, d):
    b = S.block_stats(t(s, d, "orders"), F.floor(F.col("o_orderkey") / 1024), ["o_totalprice"])
    return S.granules(b).select("granule", F.col("min").alias("lo"), F.col("max").alias("hi"), "n")


@query("SELECT o_orderkey // 1024 AS block, count(*) AS n FROM orders WHERE o_custkey = 40 GROUP BY 1")
def bloom_probe(s, d):
    """Blocks that may hold a customer by their filters, then the rows themselves: a filter never loses one."""
    block = F.floor(F.col("o_orderkey") / 1024)
    o = t(s, d, "orders").select(block.alias("block"), "o_custkey")
    asked = S.bloom(o, F.col("block"), "o_custkey").where(S.may_hold(F.lit(40).cast("long"))).select("block")
    return o.join(asked, "block", "left_semi").where("o_custkey = 40").groupBy("block").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def row_positions(s, d):
    return S.positions(t(s, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "position")


@query("SELECT * FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) WHERE position % 512 = 0")
def sparse_index(s, d):
    return S.sparse_index(t(s, d, "orders"), "o_orderkey", 512).select("o_orderkey", "position")


@query("SELECT o_custkey, o_orderkey FROM orders")
def subaltern_round_trip(s, d):
    return S.subaltern_undo(S.subaltern(t(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


# compaction policies over segments

_STATE = f"SELECT segment, 5.0 AS stale, 3.0 AS miss, staleness, hit_ratio, segment % 30 AS queries FROM ({_SEGS})"


@query(f"""SELECT segment,
 round(CASE WHEN queries < 5 THEN stale WHEN staleness > 0.5 THEN stale + 0.1 WHEN staleness < 0.1 AND queries > 20 THEN stale - 0.05 ELSE stale END, 6) AS stale,
 round(CASE WHEN queries >= 5 AND 1 - hit_ratio > 0.5 AND queries > 10 THEN miss + 0.1 ELSE miss END, 6) AS miss FROM ({_STATE})""")
def climbed_weights(s, d):
    x = _segments(s, d).select("segment", F.lit(5.0).alias("stale"), F.lit(3.0).alias("miss"), "staleness", "hit_ratio", (F.col("segment") % 30).alias("queries"))
    stale, miss = PO.climbed()
    return x.select("segment", F.round(stale, 6).alias("stale"), F.round(miss, 6).alias("miss"))


@query(f"SELECT segment, CASE WHEN t >= 5 THEN 'tiering' WHEN t <= 1.5 THEN 'leveling' ELSE 'hybrid' END AS policy, round(t, 6) AS runs FROM (SELECT segment, 10 / (1 + 10 * least(greatest(staleness, 0.01), 0.99)) AS t FROM ({_SEGS}))")
def tiering_policy(s, d):
    x = _segments(s, d).select("segment", PO.tiering_of(F.col("staleness")).alias("p"))
    return x.select("segment", "p.policy", F.round("p.runs", 6).alias("runs"))


@query(f"SELECT segment, CASE WHEN w > 10 AND r < 2 THEN 'tiering' WHEN r > 5 AND p > 50 THEN 'leveling' WHEN q > 1000 THEN 'lazy_leveling' ELSE 'hot_cold' END AS policy FROM (SELECT segment, segment % 20 AS w, segment % 9 AS r, segment % 77 AS p, segment * 30 AS q FROM ({_SEGS}))")
def flush_policies(s, d):
    k = F.col("segment")
    return _segments(s, d).select("segment", PO.flush_policy_of(k % 20, k % 9, k % 77, k * 30).alias("policy"))


@query(f"SELECT segment, 1 - del_ratio > 0.3 AS may_run FROM ({_SEGS})")
def load_gate(s, d):
    return _segments(s, d).select("segment", PO.may_run_behind(F.col("del_ratio")).alias("may_run"))
