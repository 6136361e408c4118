"""Queries for ranking and windows (W1-W16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import average_tie_percentile
from ..operators import ranking as W
from ..operators.stats import representative_score
from .aggregates import _STATS, outcome_stats
from .registry import query, table


@query("W1", """WITH c AS (SELECT p_brand, p_retailprice AS v, p_size AS z, p_partkey FROM part)
SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY v) + (count(*) OVER (PARTITION BY p_brand, v) - 1) / 2.0::DOUBLE) / count(v) OVER (PARTITION BY p_brand) * 100, 6) AS price_rank, round(100 - (rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE) / count(z) OVER () * 100, 6) AS size_rank FROM c""")
def w1(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    out = average_tie_percentile(part, "p_retailprice", ["p_brand"], "price_rank")
    return average_tie_percentile(out, "p_size", [], "size_rank", inverted=True).select("p_partkey", F.round("price_rank", 6).alias("price_rank"), F.round("size_rank", 6).alias("size_rank"))


@query("W2", f"""WITH {_STATS}, r AS (SELECT p_type, p_brand, n, improved, round(wilson, 9) AS wilson, ln(1 + n) * (0.5 + 0.5 * wilson) AS score FROM s)
SELECT p_type, p_brand, n, improved, wilson, round(score, 6) AS score, row_number() OVER (PARTITION BY p_type ORDER BY round(score, 6) DESC, n DESC, p_brand) AS rank FROM r""")
def w2(spark, sf_dir):
    s = outcome_stats(spark, sf_dir).withColumn("score", F.round(representative_score(F.col("n"), F.col("wilson")), 6))
    return W.rank_in_group(s.select("p_type", "p_brand", "n", "improved", F.round("wilson", 9).alias("wilson"), "score"), ["p_type"], [F.desc("score"), F.desc("n"), F.asc("p_brand")])


@query("W3", """WITH g AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS sold FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, arg_max(l_suppkey, sold * 1000000 - l_suppkey) AS l_suppkey, max(sold) AS sold, count(*) AS size FROM g GROUP BY 1""")
def w3(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("sold"))
    return W.representatives(g, ["l_partkey"], "sold", "l_suppkey")


@query("W3b", "SELECT p_partkey, (md5_number(p_name || p_partkey) % (p_size + 1)::UHUGEINT)::BIGINT AS pick FROM part".replace("md5_number(p_name || p_partkey)", "('0x' || md5(p_name || p_partkey))::UHUGEINT"))
def w3b(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", W.md5_modulo(F.concat("p_name", F.col("p_partkey").cast("string")), (F.col("p_size") + 1).cast("long")).alias("pick"))


@query("W4", """SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1""")
def w4(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.min_by("o_totalprice", "o_orderkey").alias("first_price"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("W5", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END) IS NOT NULL DESC, o_orderdate DESC, o_orderkey) AS n FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (n = 1) AS canonical, array_to_string(list_sort(list(o_orderkey)), '|') AS ids FROM o GROUP BY 1""")
def w5(spark, sf_dir):
    has = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).isNotNull()
    c = W.canonical(table(spark, sf_dir, "orders").withColumn("has", has), ["o_custkey"], [F.desc("has"), F.desc("o_orderdate"), F.asc("o_orderkey")], "o_orderkey")
    return c.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|"))


@query("W6", """WITH u AS (SELECT p_partkey, p_name, coalesce(n, 0) AS used FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY used DESC, p_partkey) AS n FROM u)
SELECT p_name, max(p_partkey) FILTER (n = 1) AS canonical, count(*) - 1 AS duplicates FROM r GROUP BY 1 HAVING count(*) > 1""")
def w6(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    u = table(spark, sf_dir, "part").join(used, "p_partkey", "left").withColumn("used", F.coalesce("n", F.lit(0)))
    c = W.canonical(u, ["p_name"], [F.desc("used"), F.asc("p_partkey")], "p_partkey")
    return c.where(F.size("ids") > 1).select("p_name", "canonical", (F.size("ids") - 1).cast("long").alias("duplicates"))


@query("W7", """WITH t AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'profile' WHEN 'N' THEN 'label' ELSE 'risk' END AS kind, p_brand, sum(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, kind ORDER BY score DESC, p_brand) AS n FROM t)
SELECT l_suppkey, kind, p_brand, score, CASE WHEN kind = 'profile' AND n = 1 THEN 'main' WHEN kind = 'label' AND n <= 2 THEN 'assist' WHEN kind = 'risk' AND n <= 2 THEN 'risk' ELSE 'extra' END AS role FROM r""")
def w7(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "profile").when(F.col("l_returnflag") == "N", "label").otherwise("risk")
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", kind.alias("kind"), "p_brand").agg(F.sum("l_quantity").alias("score"))
    return W.roles(t, "l_suppkey", "kind", "score", "p_brand")


_PROFILES = [("cheap", -1.0, 0.5), ("large", 0.2, 2.0), ("premium", 2.0, 0.1)]


@query("W8", f"""WITH f(profile, a, b) AS (VALUES {", ".join(map(str, _PROFILES))}), s AS (SELECT profile, p_partkey, round(a::DOUBLE * p_retailprice / 20 + b::DOUBLE * p_size, 6) AS fit FROM part, f),
r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY fit DESC, p_partkey) AS rank FROM s)
SELECT profile, p_partkey, fit, rank FROM r WHERE rank <= CASE WHEN profile IN ('cheap', 'large') THEN 7 ELSE 6 END""")
def w8(spark, sf_dir):
    profiles = spark.createDataFrame(_PROFILES, "profile string, a double, b double")  # a parameter table of three rows
    fits = table(spark, sf_dir, "part").crossJoin(F.broadcast(profiles)).select("profile", "p_partkey", F.round(F.col("a") * F.col("p_retailprice") / 20 + F.col("b") * F.col("p_size"), 6).alias("fit"))
    return W.quota_top(fits, "profile", [F.desc("fit"), F.asc("p_partkey")], 20)


@query("W9", """WITH t AS (SELECT p_type, p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) AS own FROM part)
SELECT p_type, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY own > 1, p_retailprice DESC, p_partkey) AS n FROM t) WHERE n <= 12""")
def w9(spark, sf_dir):
    return W.fair_top(table(spark, sf_dir, "part"), ["p_type"], "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 12).select("p_type", "p_brand", "p_partkey")


@query("W10", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
def w10(spark, sf_dir):
    best = W.first_of_group(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")])
    return best.orderBy(F.desc("p_retailprice"), "p_partkey").limit(12).select("p_brand", "p_partkey", "p_retailprice")


@query("W11", """SELECT user_id % 50 AS post, count(*) AS views, strftime(max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END), '%Y-%m-%d %H:%M:%S') AS latest FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY views DESC, max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END) DESC, post DESC LIMIT 10""")
def w11(spark, sf_dir):
    published = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    feed = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy((F.col("user_id") % 50).alias("post")).agg(F.count("*").alias("views"), F.max(published).alias("at"))
    return feed.orderBy(F.desc("views"), F.desc("at"), F.desc("post")).limit(10).select("post", "views", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("latest"))


_SHIFT = """WITH c AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), o AS (SELECT * FROM c WHERE event_type IS DISTINCT FROM b)"""


@query("W12", _SHIFT + " SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS ended, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_current FROM o")
def w12(spark, sf_dir):
    p = W.periods(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "event_id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return p.select("user_id", "event_type", text("started_at").alias("started"), text("ended_at").alias("ended"), "is_current")


@query("W13", """WITH m AS (SELECT user_id, event_type, event_id % 2 AS unit, ts < TIMESTAMP '2024-01-16' AS old, avg(value) AS v FROM events GROUP BY 1, 2, 3, 4)
SELECT n.user_id, n.event_type, n.unit, round(o.v, 6) AS old, round(n.v, 6) AS new, round(n.v - o.v, 6) AS delta, n.v IS DISTINCT FROM o.v AS changed FROM m n JOIN m o ON n.user_id = o.user_id AND n.event_type = o.event_type AND n.unit = o.unit WHERE NOT n.old AND o.old""")
def w13(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("unit"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("old")).agg(F.avg("value").alias("v"))
    m = m.withColumn("u", F.col("unit").cast("string"))
    d = W.metric_deltas(m.where("old").drop("old"), m.where("NOT old").drop("old"), ["user_id", "event_type", "unit"], "v", "u")
    return d.withColumns({c: F.round(c, 6) for c in ("old", "new", "delta")})


_DAILY = """r AS (SELECT user_id, event_type, ts::DATE AS day, CASE WHEN event_id % 29 = 0 THEN 's2' ELSE 's1' END AS source, ts, event_id, value FROM events),
g AS (SELECT user_id, event_type, day, count(DISTINCT source) AS sources, arg_max(value, ts::TIMESTAMP) AS value FROM r GROUP BY 1, 2, 3)"""


def _daily(spark, sf_dir):
    readings = table(spark, sf_dir, "events").withColumn("source", F.when(F.col("event_id") % 29 == 0, "s2").otherwise("s1"))
    return W.daily_values(readings, ["user_id", "event_type"], "ts", "value", "source", "event_id")


@query("W14", f"""WITH {_DAILY}, d AS (SELECT user_id, event_type, day, value FROM g WHERE sources = 1), b AS (SELECT *, count(value) OVER w AS n_days, median(value) OVER w AS m, min(value) OVER w AS lo, max(value) OVER w AS hi FROM d WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, n_days, round(CASE WHEN n_days >= 5 THEN m END, 6) AS median, CASE WHEN n_days >= 5 THEN lo END AS least, CASE WHEN n_days >= 5 THEN hi END AS greatest, coalesce(CASE WHEN n_days >= 5 AND m > 0 THEN abs((value - m) / m) > 0.5 END, false) AS anomaly FROM b""")
def w14(spark, sf_dir):
    b = W.rolling_baseline(_daily(spark, sf_dir)[0], ["user_id", "event_type"], "day", "value")
    return b.select("user_id", "event_type", F.col("day").cast("string").alias("day"), "n_days", F.round("median", 6).alias("median"), "least", "greatest", F.coalesce(F.abs("change") > 0.5, F.lit(False)).alias("anomaly"))


@query("W15", f"WITH {_DAILY} SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, sources FROM g WHERE sources > 1")
def w15(spark, sf_dir):
    return _daily(spark, sf_dir)[1].withColumn("day", F.col("day").cast("string"))


@query("W16", """SELECT p_brand, p_type, max({'q': p_size, 'l': length(p_name), 'n': p_name, 'k': p_partkey}).k AS p_partkey, max({'q': p_size, 'l': length(p_name), 'n': p_name, 'k': p_partkey}).n AS p_name, array_to_string(list_sort(list(DISTINCT p_partkey)), '|') AS ids, count(DISTINCT p_name) AS n_names, count(*) AS merged FROM part GROUP BY 1, 2""")
def w16(spark, sf_dir):
    m = W.merge_candidates(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size", "p_name", "p_partkey")
    return m.select("p_brand", "p_type", "p_partkey", "p_name", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("ids"), F.size("names").cast("long").alias("n_names"), "merged")
