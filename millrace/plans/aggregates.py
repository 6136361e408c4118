"""Queries for aggregations (A1-A29)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as A
from .registry import query, table

_CLUES = """SELECT p_type, p_brand, l_orderkey * 10 + l_linenumber AS clue, CASE l_returnflag WHEN 'A' THEN 'improved' WHEN 'R' THEN 'worsened' ELSE 'uncertain' END AS outcome, l_partkey, l_suppkey, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey"""
_WILSON = "CASE WHEN n > 0 THEN greatest((improved / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((improved / n::DOUBLE * (1 - improved / n::DOUBLE) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 0) ELSE 0 END"
_STATS = f"""c AS ({_CLUES}), o AS (SELECT p_type, p_brand, count(*) AS n, count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'worsened') AS worsened FROM (SELECT p_type, p_brand, clue, min(outcome) AS outcome FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT *, n - improved - worsened AS uncertain, improved / n::DOUBLE AS rate, {_WILSON} AS wilson FROM o)"""


def clues(spark, sf_dir):
    for t in ("lineitem", "part"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(_CLUES)


def outcome_stats(spark, sf_dir):
    return A.outcome_stats(clues(spark, sf_dir), ["p_type", "p_brand"], "clue", "outcome")


@query("A1", """SELECT md5(trim(text)) AS text_key, min(doc_id) AS first_id, min(n_chars) AS first_date, count(*) AS n, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs FROM documents GROUP BY 1""")
def a1(spark, sf_dir):
    return A.text_groups(table(spark, sf_dir, "documents"), "text", "doc_id", {"source": "sources", "lang": "langs"}, "n_chars")


@query("A2", f"WITH {_STATS} SELECT p_type, p_brand, n, improved, worsened, uncertain, round(rate, 6) AS rate, round(wilson, 6) AS wilson FROM s")
def a2(spark, sf_dir):
    return outcome_stats(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("rate", "wilson")})


@query("A3", f"""WITH {_STATS}, b AS (SELECT DISTINCT p_brand, l_suppkey, l_partkey FROM c), p AS (SELECT DISTINCT p_brand, l_suppkey FROM b),
t AS (SELECT p_type, l_suppkey, count(DISTINCT p_brand) AS vias, sum(n)::BIGINT AS clues FROM s JOIN p USING (p_brand) GROUP BY 1, 2), q AS (SELECT p_type, l_suppkey, count(DISTINCT l_partkey) AS products FROM (SELECT DISTINCT p_type, p_brand FROM s) JOIN b USING (p_brand) GROUP BY 1, 2)
SELECT p_type, l_suppkey, vias, clues, products, round(10 * vias + products + ln(1 + clues), 6) AS score FROM t JOIN q USING (p_type, l_suppkey)""")
def a3(spark, sf_dir):
    bridge = clues(spark, sf_dir).select("p_brand", "l_suppkey", "l_partkey").distinct()
    return A.bridged_totals(outcome_stats(spark, sf_dir), bridge, "p_type", "p_brand", "l_suppkey", "l_partkey", "n").withColumn("score", F.round("score", 6))


@query("A4", """WITH r AS (SELECT event_type, user_id, 'all' AS type, 'all' AS value FROM events UNION ALL SELECT event_type, user_id, 'region', (user_id % 5)::VARCHAR FROM events UNION ALL SELECT event_type, user_id, 'stage', CASE WHEN value > 20 THEN 'late' END FROM events)
SELECT event_type, type, value, count(DISTINCT user_id) AS n FROM r WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def a4(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("user_id") % 5).alias("region"), F.when(F.col("value") > 20, "late").alias("stage"))
    return A.segment_counts(rows, "event_type", {"region": "region", "stage": "stage"}, "user_id")


@query("A5", """WITH m AS (SELECT max(o_orderdate::DATE) AS last FROM orders), r AS (SELECT o_orderpriority, o_custkey, o_orderdate::DATE AS d, (last - INTERVAL 12 MONTH)::DATE AS y1, (last - INTERVAL 24 MONTH)::DATE AS y2 FROM orders, m),
c AS (SELECT o_orderpriority, count(DISTINCT o_custkey) FILTER (d > y1) AS current, count(DISTINCT o_custkey) FILTER (d > y2 AND d <= y1) AS previous FROM r GROUP BY 1)
SELECT *, CASE WHEN previous > 0 THEN round((current - previous) / previous::DOUBLE * 100, 6) END AS change FROM c""")
def a5(spark, sf_dir):
    return A.year_over_year(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey", "o_orderdate").withColumn("change", F.round("change", 6))


@query("A6", """SELECT l_suppkey, count(DISTINCT p_partkey) AS products, round(count(DISTINCT p_partkey) / (SELECT count(DISTINCT p_partkey) FROM part)::DOUBLE, 6) AS share FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 49) JOIN part USING (p_brand) GROUP BY 1""")
def a6(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mentions = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return A.coverage(mentions, part, "l_suppkey", "p_brand", "p_partkey").withColumn("share", F.round("share", 6))


@query("A7", f"WITH {_STATS} SELECT p_type, p_brand, n, improved, worsened FROM s WHERE improved > worsened AND improved >= 5 AND n >= 10 ORDER BY improved DESC, p_type, p_brand LIMIT 20")
def a7(spark, sf_dir):
    s = outcome_stats(spark, sf_dir).where("improved > worsened AND improved >= 5 AND n >= 10")
    return s.orderBy(F.desc("improved"), "p_type", "p_brand").limit(20).select("p_type", "p_brand", "n", "improved", "worsened")


@query("A8", """WITH t AS (SELECT p_brand, p_type, sum(p_size) AS s FROM part GROUP BY 1, 2), m AS (SELECT p_brand, p_type AS top_taste FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_type DESC) AS n FROM t) WHERE n = 1)
SELECT p_brand, count(*) AS items, round(avg(p_retailprice), 6) AS average, median(p_retailprice) AS median, min(p_retailprice) AS least, max(p_retailprice) AS greatest, array_to_string(list_sort(list(DISTINCT p_name))[1:10], '|') AS names, max(top_taste) AS top_taste FROM part JOIN m USING (p_brand) GROUP BY 1""")
def a8(spark, sf_dir):
    out = A.market_summary(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_retailprice", "p_size", "p_type")
    return out.withColumn("average", F.round("average", 6)).withColumn("names", F.array_join("names", "|"))


@query("A9", """SELECT c_custkey, round(cume_dist() OVER (ORDER BY c_acctbal), 9) AS position, round(avg(c_acctbal) OVER (), 6) AS average, median(c_acctbal) OVER () AS median FROM customer WHERE c_acctbal IS NOT NULL""")
def a9(spark, sf_dir):
    out = A.pool_position(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", F.round("position", 9).alias("position"), F.round("average", 6).alias("average"), "median")


@query("A10", """WITH q AS (SELECT quantile_cont(p_retailprice, 0.75) AS h1, quantile_cont(p_retailprice, 0.25) AS l1, quantile_cont(p_size, 0.75) AS h2, quantile_cont(p_size, 0.25) AS l2 FROM part)
SELECT p_partkey, concat_ws('|', CASE WHEN p_retailprice >= h1 THEN 'p_retailprice' END, CASE WHEN p_size >= h2 THEN 'p_size' END) AS advantages, concat_ws('|', CASE WHEN p_retailprice <= l1 THEN 'p_retailprice' END, CASE WHEN p_size <= l2 THEN 'p_size' END) AS weaknesses FROM part, q""")
def a10(spark, sf_dir):
    t = A.quantile_tags(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"])
    return t.select("p_partkey", F.array_join("advantages", "|").alias("advantages"), F.array_join("weaknesses", "|").alias("weaknesses"))


@query("A11", """WITH v AS (SELECT list_sort(list(p_retailprice)) AS l FROM part WHERE p_retailprice IS NOT NULL), t AS (SELECT l[least(floor(len(l) * 0.75)::INT, len(l) - 1) + 1] AS threshold FROM v),
m AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type DESC) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, round(avg(p_retailprice), 6) AS price, round(avg(p_size), 6) AS size, round(avg(p_retailprice) / 20 + avg(p_size), 6) AS composite, avg(p_retailprice) >= max(threshold) AS high, max(m.p_type) AS top_type FROM part JOIN m USING (p_brand), t WHERE m.n = 1 GROUP BY 1""")
def a11(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    top = part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.max(F.struct("n", "p_type")).alias("m"))
    brands = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size")).join(top, "p_brand")
    out = brands.crossJoin(F.broadcast(A.nearest_rank(part, "p_retailprice", 0.75)))
    return out.select("p_brand", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"), F.round(F.col("price") / 20 + F.col("size"), 6).alias("composite"), (F.col("price") >= F.col("threshold")).alias("high"), F.col("m.p_type").alias("top_type"))


_CLUSTERS = """r AS (SELECT unnest(['l_discount', 'l_tax', 'late']) AS field, unnest([l_discount, l_tax, CASE WHEN l_quantity > 45 THEN l_quantity / 50 ELSE 0 END]) AS rate FROM lineitem),
k AS (SELECT field, avg(rate) FILTER (rate > 0) AS average, max(rate) AS greatest, count(*) FILTER (rate > 0) AS affected, count(*) FILTER (rate > 0) / count(*)::DOUBLE AS coverage FROM r GROUP BY 1)"""


def _clusters(spark, sf_dir):
    late = F.when(F.col("l_quantity") > 45, F.col("l_quantity") / 50).otherwise(0.0)
    return A.problem_clusters(table(spark, sf_dir, "lineitem").withColumn("late", late), ["l_discount", "l_tax", "late"])


@query("A12", f"WITH {_CLUSTERS} SELECT field, round(average, 6) AS average, round(greatest, 6) AS greatest, affected, round(coverage, 6) AS coverage FROM k")
def a12(spark, sf_dir):
    return _clusters(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("average", "greatest", "coverage")})


_POINTS = [("l_discount", "price", 2.0), ("late", "delivery", 1.0), ("l_tax", "price", 1.0), ("l_tax", "paper", 0.5)]


_INDICATORS = [("price", "unit price"), ("price", "margin"), ("delivery", "days"), ("paper", "days"), ("paper", "weight"), ("width", "margin"), ("width", "weight")]
_TAG_RULES = [("PROMO", "price", 0.02), ("ECONOMY", "width", 0.01), ("STANDARD", "width", 0.004), ("STANDARD", "paper", 0.001)]
_VALUES = "(VALUES " + ", ".join(map(str, _POINTS)) + ")"
_RANKED = """CASE WHEN {0} / max({0}) OVER () >= 0.75 THEN 'P1' WHEN {0} / max({0}) OVER () >= 0.45 THEN 'P2' ELSE 'P3' END AS priority"""
_TAGGED = f"""{_CLUSTERS}, p(field, point, weight) AS {_VALUES}, g(tag, point, weight) AS (VALUES {", ".join(map(str, _TAG_RULES))}),
x AS (SELECT point, (0.7 * average + 0.3 * coverage) * weight * 10 AS score FROM k JOIN p USING (field) UNION ALL SELECT point, weight * coalesce(CASE WHEN p_size % 7 <> 0 THEN p_size / 50.0 END, 0.5) FROM part JOIN g ON p_type = tag),
s AS (SELECT point, sum(score)::DOUBLE AS score FROM x GROUP BY 1), f AS (SELECT point, score, {_RANKED.format("score")} FROM s)"""


@query("A13", f"""WITH {_CLUSTERS}, p(field, point, weight) AS {_VALUES}, s AS (SELECT point, sum((0.7 * average + 0.3 * coverage) * weight * 10) AS score FROM k JOIN p USING (field) GROUP BY 1)
SELECT point, round(score, 6) AS score, {_RANKED.format("score")} FROM s""")
def a13(spark, sf_dir):
    rules = spark.createDataFrame(_POINTS, "field string, point string, weight double")
    return A.failure_points(_clusters(spark, sf_dir), rules).withColumn("score", F.round("score", 6))


def _points(spark, sf_dir):
    rules = spark.createDataFrame(_POINTS, "field string, point string, weight double")
    tag_rules = spark.createDataFrame(_TAG_RULES, "tag string, point string, weight double")
    tags = table(spark, sf_dir, "part").select(F.col("p_type").alias("tag"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50.0).alias("similarity"))
    return A.failure_points(_clusters(spark, sf_dir), rules, tags, tag_rules)


@query("A13b", f"WITH {_TAGGED} SELECT point, round(score, 6) AS score, priority FROM f")
def a13b(spark, sf_dir):
    """Failure points from problems and from the tags of similar products."""
    return _points(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("A13c", f"""WITH {_TAGGED}, i(point, indicator) AS (VALUES {", ".join(map(str, _INDICATORS))}),
n AS (SELECT indicator, sum(score * CASE priority WHEN 'P1' THEN 1.5 WHEN 'P2' THEN 1.0 ELSE 0.6 END)::DOUBLE AS total, string_agg(point, '|' ORDER BY score DESC, point) AS points FROM f JOIN i USING (point) GROUP BY 1)
SELECT indicator, round(total, 6) AS score, round(total / max(total) OVER (), 6) AS share, {_RANKED.format("total")}, points FROM n""")
def a13c(spark, sf_dir):
    """What to measure against the failure points."""
    plan = A.quality_indicators(_points(spark, sf_dir), spark.createDataFrame(_INDICATORS, "point string, indicator string"))
    return plan.withColumns({"score": F.round("score", 6), "share": F.round("share", 6), "points": F.array_join("points", "|")})


@query("A14", """WITH c AS (SELECT l_orderkey, p_brand, CASE WHEN l_linenumber <= 3 THEN 1.0 WHEN l_linenumber <= 6 THEN 0.7 ELSE 0.4 END::DOUBLE * CASE WHEN l_quantity >= 30 THEN 1.5 WHEN l_quantity >= 10 THEN 1.2 ELSE 1.0 END::DOUBLE AS contribution FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT l_orderkey, p_brand, sum(contribution) AS total FROM c GROUP BY 1, 2)
SELECT l_orderkey, p_brand, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(total, 6) DESC, p_brand) AS n FROM s) WHERE n <= 2""")
def a14(spark, sf_dir):
    from ..functions.parse import percent_weight, rank_weight

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    total = lines.groupBy("l_orderkey", "p_brand").agg(F.round(F.sum(rank_weight(F.col("l_linenumber")) * percent_weight(F.col("l_quantity"))), 6).alias("total"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("total"), "p_brand"))
    return total.withColumn("n", n).where("n <= 2").drop("n")


@query("A15", """SELECT p_brand, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS A, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') AS N, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS R, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 8) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def a15(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pivot = lines.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.countDistinct("l_suppkey"))
    counts = lines.groupBy("p_brand").agg(F.count("*").alias("n"))
    share = counts.select("p_brand", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("share"))
    return pivot.na.fill(0).join(share, "p_brand")


@query("A16", "SELECT l_suppkey, l_partkey, l_quantity, count(*) AS n, array_to_string(list_sort(list(l_orderkey)), '|') AS ids FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
def a16(spark, sf_dir):
    d = A.duplicates(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_quantity"], "l_orderkey")
    return d.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|"))


@query("A17", "SELECT lower(p_name) AS name, count(*) AS n, count(DISTINCT p_type) AS types, min(p_brand) AS brand FROM part GROUP BY 1")
def a17(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"), F.min("p_brand").alias("brand")).orderBy(F.desc("n"), "name")


@query("A18", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'signup' AND event_id % 7 <> 0 GROUP BY 1, 2)
SELECT user_id, sum(n)::BIGINT AS votes, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(event_type, n) ELSE 'split' END AS winner, string_agg(event_type || ':' || n, '|' ORDER BY event_type || ':' || n) AS tally FROM c GROUP BY 1""")
def a18(spark, sf_dir):
    ballots = table(spark, sf_dir, "events").where("event_type <> 'signup' AND event_id % 7 <> 0")
    return A.majority(ballots, "user_id", "event_type").withColumn("tally", F.array_join("tally", "|"))


@query("A19", """WITH v AS (SELECT source, count(DISTINCT doc_id) FILTER (quality = 1 AND doc_id % 9 = 0) AS agree, count(DISTINCT doc_id) FILTER (toxic = 1 AND quality = 0) AS oppose, max(CASE WHEN source IN ('src1', 'src2') THEN 'high' ELSE 'low' END) AS r, bool_or(source = 'src3') AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, agree, oppose, CASE WHEN p THEN 'professional' WHEN agree >= 2 AND oppose = 0 THEN 'community' WHEN oppose >= 1 AND r <> 'high' THEN 'disputed' ELSE 'single' END AS status FROM v""")
def a19(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    stance = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "oppose").when((F.col("quality") == 1) & (F.col("doc_id") % 9 == 0), "agree")
    rows = rows.select("source", "doc_id", stance.alias("stance"), F.when(F.col("source").isin("src1", "src2"), "high").otherwise("low").alias("risk"), (F.col("source") == "src3").alias("pro"))
    return A.evidence_status(rows, "source", "doc_id", "stance", "risk", "pro")


@query("A20", """WITH l AS (SELECT p_brand, p_mfgr, unnest(['p_size', 'p_name']) AS field, unnest([(p_size // 10)::VARCHAR, split_part(p_name, ' ', 1)]) AS value, p_partkey FROM (SELECT *, p_partkey % 50 AS p_mfgr FROM part)),
n AS (SELECT p_brand, p_mfgr, field, count(DISTINCT value) AS variants, count(DISTINCT p_partkey) AS sources FROM l GROUP BY 1, 2, 3)
SELECT p_brand, p_mfgr, string_agg(CASE WHEN variants > 1 THEN field END, '|' ORDER BY field) AS differing, sum(variants)::BIGINT AS n_variants FROM n GROUP BY 1, 2""")
def a20(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 50).alias("p_mfgr"), F.floor(F.col("p_size") / 10).alias("p_size"), F.split("p_name", " ")[0].alias("p_name"), "p_partkey")
    f = A.fuse_fields(part, ["p_brand", "p_mfgr"], ["p_size", "p_name"], "p_partkey")
    total = F.aggregate("fields", F.lit(0), lambda s, x: s + F.size(x["variants"]))
    return f.select("p_brand", "p_mfgr", F.nullif(F.array_join("differing", "|"), F.lit("")).alias("differing"), total.cast("long").alias("n_variants"))


@query("A21", """WITH s AS (SELECT md5(text) AS k, lang, source, unnest(CASE WHEN n_chars > 2000 THEN ['adult', 'senior'] ELSE ['young'] END) AS stage FROM documents), t AS (SELECT stage, lang, k, count(DISTINCT source) AS sources FROM s GROUP BY 1, 2, 3)
SELECT stage, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, sum(sources)::BIGINT AS sources FROM t WHERE lang IN ('en', 'fr') GROUP BY 1""")
def a21(spark, sf_dir):
    stages = F.when(F.col("n_chars") > 2000, F.array(F.lit("adult"), F.lit("senior"))).otherwise(F.array(F.lit("young")))
    rows = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr")).select(F.md5(F.col("text").cast("binary")).alias("k"), "lang", "source", F.explode(stages).alias("stage"))
    texts = rows.groupBy("stage", "lang", "k").agg(F.countDistinct("source").alias("sources"))
    out = texts.groupBy("stage").pivot("lang", ["en", "fr"]).agg(F.count("k"))
    return out.na.fill(0).join(texts.groupBy("stage").agg(F.sum("sources").alias("sources")), "stage")


_SOURCES = """b AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars % 7 = 0 OR lang IS NULL OR source IS NULL OR n_chars IS NULL OR n_chars < 300 AS waits, CASE WHEN lang = 'en' THEN 'profile' WHEN lang = 'fr' THEN 'care' WHEN lang = 'de' THEN 'food' END AS field,
 CASE WHEN n_chars > 2000 THEN ['adult', 'senior', 'adult'] ELSE ['unspecified'] END AS stages FROM documents),
u AS (SELECT doc_id, source, field, text, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_id, unnest(list_distinct(list_transform(stages, lambda x: CASE WHEN x = 'unspecified' THEN 'all_stages' ELSE x END))) AS stage FROM b WHERE NOT waits AND field IS NOT NULL)"""


def _assembled(spark, sf_dir):
    n = F.col("n_chars")
    stages = F.when(n < 300, F.array().cast("array<string>")).when(n > 2000, F.array(F.lit("adult"), F.lit("senior"), F.lit("adult"))).when(n.isNotNull(), F.array(F.lit("unspecified")))
    field = F.when(F.col("lang") == "en", "profile").when(F.col("lang") == "fr", "care").when(F.col("lang") == "de", "food")
    ready = (n % 7 != 0) & F.col("lang").isNotNull()
    return A.assembled_sources(table(spark, sf_dir, "documents").withColumn("stages", stages), ["source"], "doc_id", ready, "stages", field, "text")


@query("A21b", f"WITH {_SOURCES} SELECT source, stage, field, text_id, md5(arg_min(text, doc_id)) AS content, count(DISTINCT doc_id) AS sources FROM u GROUP BY 1, 2, 3, 4")
def a21b(spark, sf_dir):
    """Texts of each object, stage and field."""
    return _assembled(spark, sf_dir)[0].withColumn("content", F.md5(F.col("content").cast("binary")))


@query("A21c", f"WITH {_SOURCES} SELECT DISTINCT source, stage, field, text_id, doc_id FROM u")
def a21c(spark, sf_dir):
    """The sources of each text, one row each."""
    return _assembled(spark, sf_dir)[1]


@query("A21d", f"WITH {_SOURCES} SELECT doc_id, CASE WHEN waits THEN 'pending' ELSE 'unassigned' END AS status FROM b WHERE waits OR field IS NULL")
def a21d(spark, sf_dir):
    """Sources that wait or that no field takes."""
    return _assembled(spark, sf_dir)[2]


@query("A22", """SELECT p_brand, p_size, count(DISTINCT p_name) AS texts, count(DISTINCT p_type) AS types, count(DISTINCT p_retailprice) > 1 AS conflict, list_sort(list(DISTINCT p_name))[1] AS first FROM part GROUP BY 1, 2""")
def a22(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    grouped = part.groupBy("p_brand", "p_size").agg(F.countDistinct("p_name").alias("texts"), F.countDistinct("p_type").alias("types"), F.array_sort(F.collect_set("p_name"))[0].alias("first"))
    clash = A.conflicting(part, ["p_brand", "p_size"], F.col("p_retailprice")).select("p_brand", "p_size", F.lit(True).alias("c"))
    return grouped.join(clash, ["p_brand", "p_size"], "left").withColumn("conflict", F.coalesce("c", F.lit(False))).drop("c")


@query("A23", """WITH m AS (SELECT conv_id, turn, text, unnest(list_filter([CASE WHEN text LIKE '%the%' THEN 'the' END, CASE WHEN text LIKE '%eau%' THEN 'eau' END, CASE WHEN text LIKE '%keit%' THEN 'keit' END], lambda x: x IS NOT NULL)) AS topic FROM conversations),
l AS (SELECT topic, conv_id, max({'turn': turn, 'text': text}) AS last FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY conv_id) AS r FROM l)
SELECT topic, count(*) AS conversations, string_agg(conv_id || ':' || last.turn || ':' || md5(last.text), '|' ORDER BY conv_id) FILTER (r <= 3) AS samples FROM r GROUP BY 1""")
def a23(spark, sf_dir):
    topics = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in ("the", "eau", "keit")]))
    latest = A.latest_samples(table(spark, sf_dir, "conversations").withColumn("topic", F.explode(topics)), "topic", "conv_id", "turn", "text")
    first = latest.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("conv_id"))).where("r <= 3")
    samples = first.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("s"))
    shown = F.transform("s", lambda x: F.concat_ws(":", x["conv_id"].cast("string"), x["turn"].cast("string"), F.md5(x["text"].cast("binary"))))
    return latest.groupBy("topic").agg(F.count("*").alias("conversations")).join(samples, "topic").select("topic", "conversations", F.array_join(shown, "|").alias("samples"))


@query("A24", """SELECT coalesce(nullif(trim(CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END), ''), 'other') AS priority, year(o_orderdate)::INT AS year, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1, 2""")
def a24(spark, sf_dir):
    from ..functions.text import blank_to_null

    priority = F.coalesce(blank_to_null(F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority"))), F.lit("other"))
    return table(spark, sf_dir, "orders").groupBy(priority.alias("priority"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))


@query("A25", """SELECT c_custkey, coalesce(n, 0) AS sources, CASE WHEN n IS NULL THEN 'withdrawn' ELSE 'active' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1) ON c_custkey = o_custkey""")
def a25(spark, sf_dir):
    n = table(spark, sf_dir, "orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("sources"), F.when(F.col("n").isNull(), "withdrawn").otherwise("active").alias("status"))


@query("A26", """WITH i AS (SELECT l_orderkey, l_linenumber, l_linenumber <> 4 AS eligible, CASE WHEN p_size <= 25 THEN split_part(p_type, ' ', 1) END AS profile FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND profile IS NOT NULL) AS used, count(*) FILTER (eligible AND profile IS NULL) AS missing, CASE WHEN count(*) FILTER (eligible) = 0 THEN 1.0 ELSE round(count(*) FILTER (eligible AND profile IS NOT NULL) / count(*) FILTER (eligible)::DOUBLE, 6) END::DOUBLE AS ratio,
 coalesce(string_agg(DISTINCT profile, '|' ORDER BY profile) FILTER (eligible), '') AS names, round(coalesce(sum(1.0::DOUBLE / l_linenumber) FILTER (eligible AND profile IS NOT NULL), 0), 6) AS weighted FROM i GROUP BY 1""")
def a26(spark, sf_dir):
    profile = F.when(F.col("p_size") <= 25, F.split("p_type", " ")[0])
    i = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") != 4).alias("eligible"), profile.alias("profile"))
    used = F.col("eligible") & F.col("profile").isNotNull()
    g = i.groupBy("l_orderkey").agg(F.count_if("eligible").alias("eligible"), F.count_if(used).alias("used"), F.array_sort(F.collect_set(F.when(F.col("eligible"), F.col("profile")))).alias("n"), F.coalesce(F.sum(F.when(used, 1.0 / F.col("l_linenumber"))), F.lit(0.0)).alias("w"))
    ratio = F.when(F.col("eligible") == 0, 1.0).otherwise(F.round(F.col("used") / F.col("eligible"), 6))
    return g.select("l_orderkey", "eligible", "used", (F.col("eligible") - F.col("used")).alias("missing"), ratio.alias("ratio"), F.array_join("n", "|").alias("names"), F.round("w", 6).alias("weighted"))


@query("A27", """WITH m AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS v FROM events GROUP BY 1, 2, 3),
d AS (SELECT user_id, day, list(event_type) AS present, coalesce(list(event_type) FILTER (v > 30), []) AS changed FROM m GROUP BY 1, 2),
r(direction, core, required) AS (VALUES ('buy', ['purchase'], ['purchase', 'signup']), ('trust', ['error', 'signup'], ['error']), ('use', ['click', 'view'], ['click', 'view']))
SELECT user_id, day, direction, CASE WHEN list_has_any(core, changed) THEN 'abnormal' WHEN list_has_all(present, required) THEN 'normal' ELSE 'insufficient' END AS state,
 array_to_string(list_filter(core, lambda x: list_contains(changed, x)), '|') AS evidence, array_to_string(list_filter(required, lambda x: NOT list_contains(present, x)), '|') AS missing FROM d, r""")
def a27(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"))
    directions = {"buy": (["purchase"], ["purchase", "signup"]), "trust": (["error", "signup"], ["error"]), "use": (["click", "view"], ["click", "view"])}
    states = A.direction_states(daily, ["user_id", "day"], "event_type", F.col("v") > 30, directions)
    return states.select("user_id", "day", "direction", "state", F.array_join("evidence", "|").alias("evidence"), F.array_join("missing", "|").alias("missing"))


@query("A28", """WITH s AS (SELECT l_returnflag AS main, unnest(string_split(p_type || ' ' || p_brand, ' ')) AS second, l_linestatus, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT main, second, l_linenumber, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS resolved, count(*) FILTER (l_linestatus = 'O') AS unresolved FROM s GROUP BY 1, 2, 3),
c AS (SELECT main, second, sum(n)::BIGINT AS n, sum(resolved)::BIGINT AS resolved, sum(unresolved)::BIGINT AS unresolved, list(l_linenumber ORDER BY n DESC, l_linenumber DESC)[1] AS top_onset FROM o GROUP BY 1, 2),
t AS (SELECT l_returnflag AS main, count(*) AS total FROM lineitem GROUP BY 1)
SELECT main, second, r AS place, n, round(n / total::DOUBLE, 6) AS share, CASE WHEN resolved + unresolved > 0 THEN round(resolved / (resolved + unresolved)::DOUBLE, 6) END AS resolved_rate, unresolved, top_onset
FROM (SELECT *, row_number() OVER (PARTITION BY main ORDER BY n DESC, second) AS r FROM c JOIN t USING (main)) WHERE r <= 4""")
def a28(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(F.col("l_returnflag").alias("main"), F.split(F.concat_ws(" ", "p_type", "p_brand"), " ").alias("labels"), (F.col("l_linestatus") == "F").alias("resolved"), (F.col("l_linestatus") == "O").alias("unresolved"), "l_linenumber")
    top = A.label_insights(rows, "main", "labels", "resolved", "unresolved", "l_linenumber")
    return top.select("main", F.col("label").alias("second"), "place", "n", F.round("share", 6).alias("share"), F.round("resolved_rate", 6).alias("resolved_rate"), "unresolved", "top_onset")


@query("A28b", """WITH y AS (SELECT o_orderpriority AS main, year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY main ORDER BY year DESC) AS r FROM y)
SELECT a.main, b.year AS previous, a.year AS current, round((a.n - b.n) * 100 / b.n::DOUBLE, 1) AS change FROM r a JOIN r b ON a.main = b.main AND a.r = 1 AND b.r = 2""")
def a28b(spark, sf_dir):
    return A.last_two_years(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("main"), F.year("o_orderdate").alias("year")), "main", "year", 1998)


@query("A29", """WITH a AS (SELECT lower(p_name) AS k, count(DISTINCT p_brand) AS n, min(p_brand) AS t FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN t END AS target FROM part LEFT JOIN a ON lower(p_name) = k""")
def a29(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("k", F.lower("p_name"))
    return A.alias_audit(part.select("p_partkey", "k"), part, "k", "p_brand").select("p_partkey", "status", "target")


_ALIASES = """s AS (SELECT p_partkey AS id, p_name || ' ' || p_size AS name FROM part WHERE p_partkey % 4 = 0),
a AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey - p_partkey % 4 END AS id, p_name || ' ' || p_size AS name, p_partkey AS alias_id FROM part WHERE p_partkey % 4 > 0),
live AS (SELECT a.* FROM a WHERE id IN (SELECT id FROM s))"""


def _aliases(spark, sf_dir):
    """Standards (a quarter of the parts) and aliases; some aliases name a standard that doesn't exist."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_size").alias("name"))
    target = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") - F.col("p_partkey") % 4)
    return part.where("p_partkey % 4 = 0").withColumnRenamed("p_partkey", "id"), part.where("p_partkey % 4 > 0").select(target.alias("id"), "name", F.col("p_partkey").alias("alias_id"))


@query("A29b", f"""WITH {_ALIASES}, l AS (SELECT upper(name) AS key, id, 0 AS alias FROM s UNION ALL SELECT upper(name), id, 1 FROM live), u AS (SELECT key, id, max(alias) AS alias FROM l GROUP BY 1, 2),
n AS (SELECT key, count(*) AS n, min(id) AS id, min(alias) AS alias FROM u GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN id END AS target, CASE WHEN n = 1 THEN CASE WHEN alias = 1 THEN 'alias' ELSE 'standard_name' END END AS matched_by
FROM (SELECT l_orderkey AS o_orderkey, upper(p_name || ' ' || (p_size + l_linenumber)) AS key FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1) LEFT JOIN n USING (key)""")
def a29b(spark, sf_dir):
    """Raw names of orders against standards and their aliases."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.upper(F.concat_ws(" ", "p_name", (F.col("p_size") + F.col("l_linenumber")))).alias("key"))
    lookup = A.alias_lookup(*_aliases(spark, sf_dir), "id", "name", F.upper)
    how = A.alias_audit(names, lookup, "key", "target").join(lookup.select("key", "target", "matched_by"), ["key", "target"], "left")
    return how.select("o_orderkey", "status", "target", "matched_by")


@query("A29c", f"""WITH {_ALIASES}, n AS (SELECT upper(name) AS key, count(*) AS n, min(id) AS one FROM s GROUP BY 1)
SELECT alias_id, a.id, CASE WHEN a.id IN (SELECT id FROM s) THEN 'kept' WHEN n = 1 THEN 'repaired' ELSE 'deactivated' END AS action, CASE WHEN a.id IN (SELECT id FROM s) THEN a.id WHEN n = 1 THEN one END AS target FROM a LEFT JOIN n ON upper(name) = key""")
def a29c(spark, sf_dir):
    return A.orphan_aliases(*_aliases(spark, sf_dir), "id", "name", F.upper).select("alias_id", "id", "action", "target")


@query("A29d", f"""WITH {_ALIASES}, c AS (SELECT upper(name) AS key, id AS target, count(*) AS n FROM live GROUP BY 1, 2) SELECT * FROM c WHERE key IN (SELECT key FROM c GROUP BY 1 HAVING count(*) > 1)""")
def a29d(spark, sf_dir):
    return A.alias_collisions(*_aliases(spark, sf_dir), "id", "name", F.upper)


@query("A29e", """WITH c AS (SELECT p_name || ' ' || p_size % 10 AS key, p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'rejected' END AS status, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS target, p_partkey % 3 = 0 AS reviewed FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE status WHEN 'approved' THEN 3 WHEN 'pending' THEN 2 WHEN 'rejected' THEN 1 ELSE 0 END DESC, target IS NOT NULL DESC, reviewed DESC, id DESC) AS r FROM c),
g AS (SELECT key, max(id) FILTER (r = 1) AS survivor, count(*) AS members, count(DISTINCT target) FILTER (status = 'approved') > 1 AS held_back FROM r GROUP BY 1)
SELECT key, survivor, members, CASE WHEN held_back THEN 0 ELSE members - 1 END AS duplicates, held_back FROM g""")
def a29e(spark, sf_dir):
    """Candidate names with a status, a suggested brand and a review; groups with conflicting approvals are held back."""
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "approved").when(k % 4 == 1, "pending").when(k % 4 == 2, "rejected")
    rows = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_size") % 10).alias("key"), k.alias("id"), status.alias("status"), F.when(k % 5 > 0, F.col("p_brand")).alias("target"), F.when(k % 3 == 0, "x").alias("reviewed"))
    return A.candidate_groups(rows, "key", "id", "status", "target", "reviewed", {"approved": 3, "pending": 2, "rejected": 1})
