"""Queries for parsing (F1-F13). Messy texts are derived from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from .registry import query, table


@query("F1", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::BIGINT * 1000 + 5000 WHEN l_linenumber % 3 = 1 THEN l_quantity::BIGINT END AS sold FROM lineitem""")
def f1(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    tenth = F.format_string("%d.%d万+", F.floor((q + 5) / 10), (q + 5) % 10)
    text = F.when(F.col("l_linenumber") % 3 == 0, tenth).when(F.col("l_linenumber") % 3 == 1, F.concat(q.cast("string"), F.lit("+ sold"))).otherwise("few")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.sold_count(text).alias("sold"))


@query("F2", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN floor(p_retailprice / 10) + 0.5::DOUBLE END AS price FROM part)
SELECT p_partkey, price, CASE WHEN price < 50 THEN '<50' WHEN price < 80 THEN '50-80' WHEN price >= 80 THEN '80+' END AS bucket FROM p""")
def f2(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("from $"), F.floor(F.col("p_retailprice") / 10).cast("string"), F.lit(".5 / pack of 2"))).otherwise("n/a")
    price = P.first_number(text)
    return table(spark, sf_dir, "part").select("p_partkey", price.alias("price"), P.price_bucket(price).alias("bucket"))


@query("F3", """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 2.0::DOUBLE * 3 WHEN 1 THEN p_size * 100 * 0.002::DOUBLE WHEN 2 THEN p_size * 0.907184::DOUBLE END, 6) AS weight,
 round(CASE p_partkey % 4 WHEN 0 THEN p_size * 2.0::DOUBLE * 3 + 0.5 WHEN 1 THEN p_size * 100 * 0.002::DOUBLE + 0.5 WHEN 2 THEN 0.5 ELSE 0.5 END, 6) AS weight_sum FROM part""")
def f3(spark, sf_dir):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(s, F.lit("kg*3 bag, 5lb"))).when(k == 1, F.concat(s, F.lit("00 g tin"))).when(k == 2, F.concat(s, F.lit(" lb"))).otherwise("loose")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.net_weight(text), 6).alias("weight"), F.round(P.net_weight(F.concat(text, F.lit(" + 250g free")), mode="sum"), 6).alias("weight_sum"))


@query("F4", """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + INTERVAL 40 DAY)::DATE AS ref, o_orderkey % 7 AS k FROM orders)
SELECT o_orderkey, strftime(CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN CASE WHEN month(d) = 2 AND day(d) = 29 THEN NULL ELSE d END WHEN 3 THEN (ref - INTERVAL 3 DAY)::DATE WHEN 4 THEN (ref - INTERVAL 1 DAY)::DATE WHEN 5 THEN (ref - INTERVAL 1 DAY)::DATE END, '%Y-%m-%d') AS day FROM o WHERE NOT (month(d) = 2 AND day(d) = 29)""")
def f4(spark, sf_dir):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 7
    raw = F.when(k == 0, F.date_format(d, "yyyy-M-d")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.date_format(d, "M-d")).when(k == 3, "3 days ago").when(k == 4, "20 hours ago").when(k == 5, "Yesterday").otherwise("long ago")
    rows = table(spark, sf_dir, "orders").where(~((F.month(d) == 2) & (F.dayofmonth(d) == 29)))
    return rows.select("o_orderkey", P.loose_date(raw, F.date_add(d, 40)).cast("string").alias("day"))


@query("F5", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS review_day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders""")
def f5(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "soon").when(k % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    unix = F.unix_timestamp("o_orderdate") * F.when(k % 2 == 0, 1000).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", P.review_date(raw).alias("review_day"), F.date_format(P.unix_time(unix), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("F6", """WITH n AS (SELECT p_partkey, list_filter([lower(split_part(p_name, ' ', 1)), lower(p_brand), CASE WHEN lower(p_type) = 'promo steel' THEN 'steel' ELSE lower(p_type) END, 'fowl', 'salt'], lambda x: x <> 'water') AS names FROM part)
SELECT p_partkey, array_to_string(names, '|') AS names, sha256('["' || array_to_string(names, '", "') || '"]') AS fingerprint FROM n""")
def f6(spark, sf_dir):
    first = F.split("p_name", " ")[0]
    text = F.concat(first, F.lit(" (fresh, min. 4%), "), F.col("p_brand"), F.lit(" [a; b] 12.5%; Water, Wares and products thereof 40% ("), F.col("p_type"), F.lit(" 5%, Fowl [fresh, dried]), Other products thereof 3%, Salt"))
    rows = table(spark, sf_dir, "part").select("p_partkey", P.nested_names(("water",), {"promo steel": "steel"}, ("products thereof",))(text).alias("n"))
    return rows.select("p_partkey", F.array_join("n", "|").alias("names"), F.sha2(F.concat(F.lit('["'), F.array_join("n", '", "'), F.lit('"]')), 256).alias("fingerprint"))


@query("F6b", """SELECT p_partkey, array_to_string([lower(split_part(p_name, ' ', 1)), lower(p_type), 'cod', 'wares and products thereof', lower(p_brand)], '|') AS names FROM part""")
def f6b(spark, sf_dir):
    """Full stops as separators, a prefix of the reading, a group whose name is exactly known, a header that stands alone."""
    text = F.concat(F.lit("LIVE: "), F.split("p_name", " ")[0], F.lit("。Fish 12%("), F.col("p_type"), F.lit("。Cod 3%)，Wares and products thereof; Meat products thereof 8%; "), F.col("p_brand"))
    names = P.nested_names(headers=("products thereof",), exact=("fish",), prefixes=("live",))(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, "|").alias("names"))


@query("F7", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'brass|steel' ELSE '' END AS parts FROM part""")
def f7(spark, sf_dir):
    glued = F.when(F.col("p_size") % 2 == 0, "brasssteel").otherwise("tincanopener")
    names = P.segment_names(["brass", "steel", "tin", "can", "tincan", "opener"])(glued)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, "|").alias("parts"))


@query("F8", """WITH r AS (SELECT p_partkey, unnest([lower(split_part(p_name, ' ', 1)), 'rice', p_brand]) AS name, unnest([1, 2, 3]) AS rank, unnest([p_size::DOUBLE, 12.5, NULL]) AS percent FROM part)
SELECT p_partkey, name, rank::BIGINT AS rank, percent, 1.0::DOUBLE AS rank_weight, CASE WHEN percent IS NULL THEN 1.0 WHEN percent >= 30 THEN 1.5 WHEN percent >= 10 THEN 1.2 ELSE 1.0 END::DOUBLE AS percent_weight FROM r""")
def f8(spark, sf_dir):
    text = F.concat(F.lower(F.split("p_name", " ")[0]), F.lit("("), F.col("p_size").cast("string"), F.lit("%), rice 12.5%, "), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(P.ingredient_rows(text)).alias("r")).select("p_partkey", "r.*")
    return rows.withColumn("rank_weight", P.rank_weight(F.col("rank"))).withColumn("percent_weight", P.percent_weight(F.col("percent")))


@query("F9", """WITH t AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS s, text FROM documents),
g AS (SELECT doc_id, length(s) - 7 AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS eff, length(s) AS len, list_unique(list_transform(range(1, greatest(length(s) - 7, 1) + 1), lambda i: substr(s, i, 8))) AS u FROM t),
r AS (SELECT doc_id, CASE WHEN len > 0 THEN eff / len::DOUBLE ELSE 0 END AS effective, CASE WHEN n >= 2 THEN 1 - u / n::DOUBLE ELSE 0 END AS repeated FROM g)
SELECT doc_id, round(effective, 6) AS effective, round(repeated, 6) AS repeated, CASE WHEN effective >= 0.7 AND repeated <= 0.35 THEN 'accept' WHEN effective >= 0.55 THEN 'review' ELSE 'reject' END AS verdict FROM r""")
def f9(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.share_of_effective_characters(F.col("text")).alias("effective"), T.repeated_gram_share()(F.col("text")).alias("repeated"))
    verdict = F.when((F.col("effective") >= 0.7) & (F.col("repeated") <= 0.35), "accept").when(F.col("effective") >= 0.55, "review").otherwise("reject")
    return rows.select("doc_id", F.round("effective", 6).alias("effective"), F.round("repeated", 6).alias("repeated"), verdict.alias("verdict"))


@query("F9b", """WITH t AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS s, text FROM documents),
g AS (SELECT doc_id, length(s) - 7 AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS eff, length(s) AS len, list_unique(list_transform(range(1, greatest(length(s) - 7, 1) + 1), lambda i: substr(s, i, 8))) AS u, len(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)*')) AS hits FROM t),
r AS (SELECT doc_id, coalesce(hits, 0) AS hits, CASE WHEN len > 0 THEN eff / len::DOUBLE ELSE 0 END AS effective, CASE WHEN n >= 2 THEN 1 - u / n::DOUBLE ELSE 0 END AS repeated FROM g)
SELECT doc_id, hits::INT AS hits, CASE WHEN effective < 0.55 THEN 'characters' WHEN effective < 0.7 AND hits < 2 THEN 'characters and evidence' WHEN repeated > 0.35 THEN 'repetition' WHEN hits < 2 THEN 'evidence' ELSE 'accept' END AS verdict FROM r""")
def f9b(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    hits = F.size(F.regexp_extract_all(text, F.lit(r"[0-9]+(\.[0-9]+)*"), F.lit(0)))
    verdict = T.text_check(T.share_of_effective_characters(text), T.repeated_gram_share()(text), hits)
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"), verdict.alias("verdict"))


@query("F10", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|' || user_id WHEN 1 THEN 'a|' || event_type ELSE '' END AS items, CASE WHEN event_id % 2 = 0 THEN round(value, 6) END AS v FROM events""")
def f10(spark, sf_dir):
    k = F.col("event_id")
    user = F.col("user_id").cast("string")
    cell = F.when(k % 3 == 0, F.to_json(F.array("event_type", user))).when(k % 3 == 1, F.concat(F.lit("a ; "), F.col("event_type"), F.lit(", a")))
    numbers = F.when(k % 2 == 0, F.to_json(F.create_map(F.lit("v"), F.col("value")))).otherwise("{broken")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(P.list_cell(cell), "|").alias("items"), F.round(F.element_at(P.map_cell(numbers), "v"), 6).alias("v"))


@query("F11", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'click|web' ELSE event_type || '|click|web' END AS parts, true AS has_click, (event_type = 'view')::INT AS view_at FROM events""")
def f11(spark, sf_dir):
    text = F.concat(F.col("event_type"), F.lit(" | click，, web;web"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(P.split_multi(text), "|").alias("parts"), F.array_contains(P.split_multi(text), "click").alias("has_click"), F.find_in_set(F.lit("view"), F.translate(F.concat(F.col("event_type"), F.lit("、x")), "、", ",")).alias("view_at"))


@query("F12", """SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE 'other' END AS category, CASE WHEN event_id % 4 = 0 THEN 'uncertain' ELSE 'improved' END AS direction, round(least(greatest(value / 50, 0), 1), 6) AS confidence FROM events WHERE event_id % 5 <> 0""")
def f12(spark, sf_dir):
    k = F.col("event_id")
    cell = F.to_json(F.array(F.struct(F.when(k % 5 != 0, F.col("event_type")).alias("category"), F.when(k % 4 == 0, "??").otherwise("improved").alias("direction"), (F.col("value") / 50).alias("confidence"))))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json(cell, "array<struct<category:string,direction:string,confidence:double>>")).alias("e")).select("event_id", "e.*")
    return rows.where("category IS NOT NULL").select(
        "event_id", F.when(F.col("category").isin("purchase", "signup"), F.col("category")).otherwise("other").alias("category"),
        F.when(F.col("direction").isin("improved", "worsened"), F.col("direction")).otherwise("uncertain").alias("direction"), F.round(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), 6).alias("confidence"),
    )


@query("F13", """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 60 + event_id % 100 END::BIGINT AS seconds, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_start FROM events WHERE event_type IN ('view', 'click')""")
def f13(spark, sf_dir):
    start = F.unix_timestamp("ts")
    item = F.struct(F.col("event_id"), start.alias("start"), F.when(F.col("event_id") % 6 != 0, start + 60 + F.col("event_id") % 100).alias("end"))
    days = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select("user_id", F.to_json(F.array(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.array(item).alias("items")))).alias("record"))
    schema = "array<struct<day:string,items:array<struct<event_id:long,start:long,end:long>>>>"
    flat = days.select("user_id", F.explode_outer(F.from_json("record", schema)).alias("d")).select("user_id", "d.day", F.explode_outer("d.items").alias("i"))
    local = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("i.start"), "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")
    return flat.select("user_id", "day", F.col("i.event_id").alias("event_id"), (F.col("i.end") - F.col("i.start")).alias("seconds"), local.alias("local_start"))
