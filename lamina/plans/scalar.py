"""Scalar, date, JSON, array and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.plans.registry import query, table as t


@query("SELECT p_partkey, upper(p_name) AS up, substr(p_brand, 1, 5) AS pre, length(p_type) AS n, replace(p_type, ' ', '_') AS under, p_brand || '/' || p_type AS both_, lpad(CAST(p_size AS VARCHAR), 4, '0') AS pad, reverse(p_brand) AS rev FROM part")
def fn_string(s, d):
    return t(s, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.substring("p_brand", 1, 5).alias("pre"), F.length("p_type").alias("n"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("under"), F.concat_ws("/", "p_brand", "p_type").alias("both_"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("pad"), F.reverse("p_brand").alias("rev"))


@query("SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS num, regexp_replace(c_name, '[0-9]+', 'N') AS masked, c_name LIKE '%1' AS ends, c_name ILIKE 'CUSTOMER%' AS starts, levenshtein(c_mktsegment, 'BUILDING') AS dist FROM customer")
def fn_pattern(s, d):
    c = F.col("c_name")
    return t(s, d, "customer").select("c_custkey", F.regexp_extract(c, "([0-9]+)", 1).alias("num"), F.regexp_replace(c, "[0-9]+", "N").alias("masked"), c.like("%1").alias("ends"), c.ilike("CUSTOMER%").alias("starts"), F.levenshtein("c_mktsegment", F.lit("BUILDING")).alias("dist"))


@query("SELECT doc_id, split_part(source, 'c', 2) AS part, trim('  ' || lang || ' ') AS lang, coalesce(source, 'none') AS src, nullif(lang, 'en') AS other FROM documents")
def fn_null_split(s, d):
    return t(s, d, "documents").select("doc_id", F.split_part("source", F.lit("c"), F.lit(2)).alias("part"), F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("lang"), F.coalesce("source", F.lit("none")).alias("src"), F.nullif("lang", F.lit("en")).alias("other"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(dow FROM o_orderdate) AS INT) + 1 AS dow, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, o_orderdate + INTERVAL 30 DAY AS due, strftime(o_orderdate, '%Y/%m') AS ym FROM orders")
def fn_date(s, d):
    o = F.col("o_orderdate")
    return t(s, d, "orders").select("o_orderkey", F.date_trunc("month", o).cast("timestamp_ntz").alias("month"), F.year(o).alias("y"), F.dayofweek(o).alias("dow"), F.date_diff(o, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), (o + F.expr("INTERVAL 30 DAYS")).alias("due"), F.date_format(o, "yyyy/MM").alias("ym"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 7) AS unit, CAST(floor(l_tax * 100) AS BIGINT) AS f, CAST(ceil(l_discount * 100) AS BIGINT) AS c, abs(l_discount - 0.05) AS a, round(sqrt(l_extendedprice), 6) AS sq, round(ln(l_extendedprice), 8) AS l, l_orderkey % 7 AS m, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le, round(power(l_quantity, 2), 2) AS p FROM lineitem")
def fn_math(s, d):
    c = F.col
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c("l_extendedprice") / c("l_quantity"), 7).alias("unit"), F.floor(c("l_tax") * 100).alias("f"), F.ceil(c("l_discount") * 100).alias("c"), F.abs(c("l_discount") - 0.05).alias("a"), F.round(F.sqrt("l_extendedprice"), 6).alias("sq"), F.round(F.log("l_extendedprice"), 8).alias("l"), (c("l_orderkey") % 7).alias("m"), F.greatest("l_tax", "l_discount").alias("g"), F.least("l_tax", "l_discount").alias("le"), F.round(F.pow("l_quantity", F.lit(2.0)), 2).alias("p"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band, CAST(o_totalprice AS DECIMAL(12, 1)) AS dec1, CAST(o_orderkey AS VARCHAR) AS txt, TRY_CAST(o_orderstatus AS INT) AS none FROM orders")
def fn_case_cast(s, d):
    p = F.col("o_totalprice")
    return t(s, d, "orders").select("o_orderkey", F.when(p < 50000, "low").when(p < 150000, "mid").otherwise("high").alias("band"), p.cast("decimal(12,1)").alias("dec1"), F.col("o_orderkey").cast("string").alias("txt"), F.col("o_orderstatus").try_cast("int").alias("none"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT k, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k")
def fn_json_struct(s, d):
    return t(s, d, "events").select(F.from_json("props", "k long").alias("j")).groupBy("j.k").agg(F.count("*").alias("n"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS pos, round(CAST(list_max(embedding) AS DOUBLE), 5) AS most FROM embeddings")
def fn_array(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t(s, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 4).alias("norm2"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("pos"), F.round(F.array_max(e), 5).alias("most"))


@query("SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY lang, w HAVING count(*) > 20")
def fn_unnest(s, d):
    w = t(s, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy("lang", "w").agg(F.count("*").alias("n")).where("n > 20")


@query("SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def fn_cosine(s, d):
    e = t(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("q")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda c, x: c + x)
    return e.join(q).select("vec_id", F.round(dot("v", "q") / F.sqrt(dot("v", "v")) / F.sqrt(dot("q", "q")), 5).alias("cosine"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def fn_ordered_list(s, d):
    x = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(x, lambda p: p["role"]), ">").alias("roles"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(html) AS n FROM pages")
def fn_url(s, d):
    return t(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.length("html").alias("n"))


@query("SELECT p_partkey, map_extract_value(MAP {'a': p_size, 'b': p_size * 2}, 'b') AS b FROM part")
def fn_map(s, d):
    m = F.create_map(F.lit("a"), F.col("p_size"), F.lit("b"), F.col("p_size") * 2)
    return t(s, d, "part").select("p_partkey", F.element_at(m, "b").alias("b"))


_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: power(CAST(p[1] AS DOUBLE) - p[2], 2))))"


@query(f"SELECT e.vec_id, round({_L2}, 5) AS l2, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 5) AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def fn_distance(s, d):
    e = t(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("q")))  # one row
    total = lambda f: F.aggregate(F.zip_with("v", "q", f), F.lit(0.0), lambda c, x: c + x)
    return e.join(q).select("vec_id", F.round(F.sqrt(total(lambda x, y: (x - y) * (x - y))), 5).alias("l2"), F.round(total(lambda x, y: x * y), 5).alias("dot"))
