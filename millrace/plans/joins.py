"""Queries for joins and matching (J1-J14) and set operations (U1-U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import trimmed_md5
from ..operators import match as M
from .registry import query, table


@query("J1", """SELECT r_name, p_brand, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size > 10 GROUP BY 1, 2""")
def j1(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = M.snowflake(t("lineitem"), (t("part").where("p_size > 10"), "l_partkey", "p_partkey"), (t("supplier"), "l_suppkey", "s_suppkey"), (t("nation"), "s_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey"))
    return rows.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("J2", """SELECT p_partkey, p_brand, l.q AS max_quantity, s.s AS max_balance FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON p_partkey = l_partkey
LEFT JOIN (SELECT l_partkey AS k, max(s_acctbal) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1 GROUP BY 1) s ON p_partkey = k""")
def j2(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    q = lines.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("max_quantity"))
    s = lines.where("l_linenumber = 1").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("s_acctbal").alias("max_balance"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(q, "p_partkey", "left").join(s, "p_partkey", "left")


@query("J3", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 3 = 0 AND md5(trim(p.text)) = md5(trim(d.text)))")
def j3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", trimmed_md5(F.col("text")).alias("hash"))
    return M.skip_processed(docs, docs.where("doc_id % 3 = 0"), "hash").select("doc_id")


@query("J4", """SELECT 'customer without order' AS audit, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'part without line', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 3) UNION ALL SELECT 'line without order', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def j4(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    audit = lambda name, df, key: df.select(F.lit(name).alias("audit"), F.col(key).alias("key"))
    a = audit("customer without order", M.orphans(t("customer"), t("orders"), "c_custkey", "o_custkey"), "c_custkey")
    b = audit("part without line", M.orphans(t("part"), t("lineitem").where("l_linenumber = 3"), "p_partkey", "l_partkey"), "p_partkey")
    c = audit("line without order", M.orphans(t("lineitem"), t("orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey"), "l_orderkey")
    return a.unionByName(b).unionByName(c)


@query("J5", """SELECT l_orderkey, l_linenumber, l_linestatus, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus IS DISTINCT FROM o_orderstatus""")
def j5(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return M.mismatches(lines, table(spark, sf_dir, "orders"), "o_orderkey", "l_linestatus", "o_orderstatus").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_linestatus", "o_orderstatus")


def _brands(spark, sf_dir):
    """Events with raw brand names, and an alias table from the parts' brands."""
    rows = table(spark, sf_dir, "events").select("event_id", F.split(F.concat_ws("|", F.concat(F.lit("brand # "), (F.col("user_id") % 30).cast("string")), F.concat(F.lit("BRAND#"), (F.col("user_id") % 30).cast("string")), F.concat(F.lit("Brand-"), (F.col("event_id") % 40).cast("string"))), r"\|").alias("names"))
    aliases = table(spark, sf_dir, "part").select(F.col("p_brand").alias("alias"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("standard_id")).distinct()
    return rows, aliases


_J6 = """WITH a AS (SELECT DISTINCT lower(regexp_replace(p_brand, '[\\s\\p{P}\\p{S}]+', '', 'g')) AS k, regexp_extract(p_brand, '[0-9]+')::BIGINT AS standard_id FROM part),
r AS (SELECT event_id, unnest(['brand # ' || user_id % 30, 'BRAND#' || user_id % 30, 'Brand-' || event_id % 40]) AS raw_name FROM events), n AS (SELECT *, lower(regexp_replace(raw_name, '[\\s\\p{P}\\p{S}]+', '', 'g')) AS k FROM r)
"""


@query("J6", _J6 + "SELECT DISTINCT event_id, standard_id FROM n JOIN a USING (k)")
def j6(spark, sf_dir):
    rows, aliases = _brands(spark, sf_dir)
    return M.alias_join(rows, F.col("names"), aliases, ["event_id"])[0]


@query("J6b", _J6 + "SELECT raw_name, count(*) AS n FROM n WHERE k NOT IN (SELECT k FROM a) GROUP BY 1")
def j6b(spark, sf_dir):
    rows, aliases = _brands(spark, sf_dir)
    return M.alias_join(rows, F.col("names"), aliases, ["event_id"])[1]


@query("J7", """WITH n AS (SELECT DISTINCT p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' x' END AS raw FROM part), s AS (SELECT DISTINCT p_brand AS brand FROM part),
p AS (SELECT raw, max(brand) FILTER (lower(raw) = lower(brand)) AS exact, count(DISTINCT brand) AS n, min(brand) AS one FROM n JOIN s ON contains(lower(raw), lower(brand)) OR contains(lower(brand), lower(raw)) GROUP BY raw)
SELECT raw, coalesce(exact, one) AS brand FROM p WHERE exact IS NOT NULL OR n = 1""")
def j7(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" x")).alias("raw"))
    return M.only_containing(names, part.select(F.col("p_brand").alias("brand")), "raw", "brand")


@query("J8", """WITH i AS (SELECT p_partkey AS item, p_brand, lower(p_name || ' ' || p_type) AS a FROM part), p AS (SELECT p_partkey, p_brand, lower(p_name) AS b FROM part),
s AS (SELECT item, p_partkey, CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) ELSE coalesce(list_sum(list_transform(list_intersect(regexp_extract_all(a, '[\\p{L}\\p{N}]+'), regexp_extract_all(b, '[\\p{L}\\p{N}]+')), lambda t: length(t))), 0) END AS score FROM i JOIN p USING (p_brand) WHERE item <> p_partkey)
SELECT item, p_partkey, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, p_partkey) AS n FROM s WHERE score >= 4) WHERE n = 1""")
def j8(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items = part.select(F.col("p_partkey").alias("item"), "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return M.best_in_block(items, part.select("p_partkey", "p_brand", "p_name"), "p_brand", "item", "title", "p_partkey", "p_name")


@query("J9")
def j9(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower("p_name").alias("name"), F.lower("p_type").alias("type"))
    return M.best_candidates(part, "p_partkey", "p_brand", "type", "name").withColumn("score", F.round("score", 6))


@query("J10", """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey)::INT AS i FROM lineitem),
d AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_partkey) AS v, [round(avg(l_quantity), 6), round(avg(l_discount), 6), round(avg(l_tax), 6), round(avg(l_extendedprice), 6)]::DOUBLE[] AS m FROM lineitem GROUP BY 1),
o AS (SELECT k, string_agg('p' || p, ',' ORDER BY i) AS names FROM l GROUP BY 1), h AS (SELECT n, list_sum(list_transform(range(1, n + 1), lambda i: 1::DOUBLE / i)) AS h FROM (SELECT DISTINCT n FROM d)),
e AS (SELECT k, p, max(i) AS i FROM l GROUP BY 1, 2),
s AS (SELECT x.k AS a, y.k AS b, sum(1::DOUBLE / x.i) AS w, sum(1::DOUBLE / x.i / (1 + abs(x.i - y.i))) AS near, count(*) AS c FROM e x JOIN e y ON x.p = y.p AND x.k % 2 = 0 AND y.k % 2 = 1 GROUP BY 1, 2),
q AS (SELECT x.k AS a, y.k AS b, sum(1::DOUBLE / x.i) AS same, count(*) FILTER (x.i <= 5) AS top FROM l x JOIN l y ON x.p = y.p AND x.i = y.i AND x.k % 2 = 0 AND y.k % 2 = 1 GROUP BY 1, 2),
r AS (SELECT s.a, s.b, ox.names = oy.names AS exact, round(0.5::DOUBLE * coalesce(same, 0) / h + 0.3::DOUBLE * near / w + 0.2::DOUBLE * c / (x.v + y.v - c), 5) AS similarity, coalesce(top, 0) / least(5, x.n, y.n)::DOUBLE AS top,
len(list_filter(range(1, 5), lambda i: abs(x.m[i] - y.m[i]) <= greatest(0.05, abs(x.m[i]) * 0.01, abs(y.m[i]) * 0.01))) / 4::DOUBLE AS nutrition
FROM s LEFT JOIN q ON s.a = q.a AND s.b = q.b JOIN d x ON x.k = s.a JOIN d y ON y.k = s.b JOIN o ox ON ox.k = s.a JOIN o oy ON oy.k = s.b JOIN h ON h.n = greatest(x.n, y.n))
SELECT a, b, exact, similarity, nutrition, round((similarity * 0.75::DOUBLE + nutrition * 0.25::DOUBLE)::DECIMAL(18, 9), 5)::DOUBLE AS score, (exact OR similarity >= 0.96 AND top >= 0.8) AND nutrition >= 0.95 AS auto_match FROM r WHERE exact OR similarity >= 0.5""")
def j10(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name")))), lambda x: x["name"])
    metrics = [part for m in ("l_quantity", "l_discount", "l_tax", "l_extendedprice") for part in (F.lit(m), F.round(F.avg(m), 6))]
    lists = lines.groupBy("l_orderkey").agg(listed.alias("names"), F.create_map(*metrics).alias("nutrition"))
    return M.formula_matches(lists.where("l_orderkey % 2 = 0"), lists.where("l_orderkey % 2 = 1"), "l_orderkey", "names", "nutrition", least=0.5)


_PERIODS = """SELECT user_id, ts AS started_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended_at, event_id AS period_id FROM events WHERE event_type = 'signup'"""


@query("J11", f"WITH p AS ({_PERIODS}) SELECT event_id, period_id FROM events e JOIN p ON e.user_id = p.user_id AND e.ts >= started_at AND (ended_at IS NULL OR e.ts < ended_at) WHERE event_type = 'view'")
def j11(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return M.in_period(table(spark, sf_dir, "events").where("event_type = 'view'"), spark.sql(_PERIODS), ["user_id"], "ts", "started_at", "ended_at").select("event_id", "period_id")


@query("J12", "SELECT doc_id FROM documents WHERE (source, lang) NOT IN (SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)")
def j12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    exceptions = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", "lang", ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("blocking"))
    return M.without_blockers(docs, exceptions, ["source", "lang"]).select("doc_id")


@query("J13", """WITH s AS (SELECT l_returnflag AS symptom, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT symptom, p_brand, count(DISTINCT l_suppkey) AS suppliers, sum(n)::BIGINT AS clues FROM s JOIN c USING (l_suppkey) GROUP BY 1, 2""")
def j13(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    stats = lines.groupBy(F.col("l_returnflag").alias("symptom"), "l_suppkey").agg(F.count("*").alias("n"))  # before the expansion
    chain = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    return stats.join(chain, "l_suppkey").groupBy("symptom", "p_brand").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.sum("n").alias("clues"))


@query("J14", """SELECT DISTINCT e.event_id, n_name FROM events e, nation n WHERE n_nationkey IN (e.user_id % 25, e.event_id % 25)""")
def j14(spark, sf_dir):
    cell = F.to_json(F.array(F.col("user_id") % 25, F.col("event_id") % 25))
    keys = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json(cell, "array<int>")).alias("n_nationkey")).distinct()
    return keys.join(table(spark, sf_dir, "nation"), "n_nationkey").select("event_id", "n_name")


@query("U1", "SELECT 'part' AS source, p_partkey AS key, p_brand AS tag FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_mktsegment FROM customer")
def u1(spark, sf_dir):
    parts = [("part", "p_partkey", "p_brand"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_mktsegment")]
    frames = [table(spark, sf_dir, n).select(F.lit(n).alias("source"), F.col(k).alias("key"), F.col(t).alias("tag")) for n, k, t in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("U2", "SELECT l_suppkey AS key FROM lineitem WHERE l_quantity > 45 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def u2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("key")).union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


@query("U3", """WITH t AS (SELECT l_suppkey, list(DISTINCT p_size) FILTER (l_returnflag = 'A') AS a, list(DISTINCT p_size) FILTER (l_returnflag = 'R') AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 20 GROUP BY 1)
SELECT l_suppkey, len(list_intersect(a, b))::BIGINT AS n_both, len(list_distinct(list_concat(a, b)))::BIGINT AS n_any, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS n_only_a FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")
def u3(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size <= 20"), F.col("l_partkey") == F.col("p_partkey"))
    t = lines.groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("p_size"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("p_size"))).alias("b"))
    size = lambda c: F.size(c).cast("long")
    return t.where((F.size("a") > 0) & (F.size("b") > 0)).select("l_suppkey", size(F.array_intersect("a", "b")).alias("n_both"), size(F.array_union("a", "b")).alias("n_any"), size(F.array_except("a", "b")).alias("n_only_a"))
