"""Queries for cleaning, keys and scores (P1-P13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .registry import query, table

_RAW = "concat('​', coalesce(text, ''), '  https://a.example/x?y=1 #topic ', cast(doc_id % 7 AS string), '# [smile of sixteen] ☀ ⬛️ ➡🇫🇷 WWW.x.example/ @us☀er_', cast(doc_id AS string), '  end')"
_RAW_SQL = "concat('​', coalesce(text, ''), '  https://a.example/x?y=1 #topic ', (doc_id % 7)::VARCHAR, '# [smile of sixteen] ☀ ⬛️ ➡🇫🇷 WWW.x.example/ @us☀er_', doc_id::VARCHAR, '  end')"
_NORMAL_SQL = "RAW"
for _p, _r in T.NOISE:
    _NORMAL_SQL = f"regexp_replace({_NORMAL_SQL}, '{_p}', '{_r}', 'g')"
_NORMAL_SQL = f"trim(regexp_replace({_NORMAL_SQL}, '\\s+', ' ', 'g'))"


@query("P1", f"SELECT doc_id, md5({_NORMAL_SQL.replace("RAW", _RAW_SQL)}) AS clean_md5, length({_NORMAL_SQL.replace("RAW", _RAW_SQL)})::BIGINT AS n_chars FROM documents")
def p1(spark, sf_dir):
    clean = T.normalize_text(F.expr(_RAW))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), F.length(clean).cast("long").alias("n_chars"))




@query("P2", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM l),
f AS (SELECT doc_id, line_no, line, length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g'))::BIGINT AS substantive, regexp_replace(line, '\\s+', '', 'g') AS compact FROM t)
SELECT doc_id, line_no, substantive, length(compact) >= 2 AND regexp_matches(compact, '[\\p{L}\\p{N}]') AND NOT regexp_matches(lower(compact), '^(?:ok|nice|is|6+|the)[~!?,.\\x{FF5E}\\x{FF01}\\x{FF1F}\\x{3002}\\x{FF0C}]*$') AS meaningful,
  substantive < 6 OR regexp_matches(lower(line), '^(?:(?:ha|oh|the)[\\s.,!?]*)+$') AS low_information FROM f""")
def p2(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.col("line")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.substantive_length(line).alias("substantive"), T.is_meaningful(line, "ok|nice|is|6+|the").alias("meaningful"), T.is_low_information(line, "ha|oh|the").alias("low_information"))


@query("P3", "SELECT lower(regexp_replace(p_name, '[\\s\\p{P}\\p{S}]+', '', 'g')) AS name_key, lower(regexp_replace(p_brand, '[\\s\\p{P}\\p{S}]+', '', 'g')) AS brand_key, count(*) AS n FROM part GROUP BY 1, 2")
def p3(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(T.normalize_name(F.col("p_name")).alias("name_key"), T.normalize_name(F.col("p_brand")).alias("brand_key")).agg(F.count("*").alias("n"))


@query("P4", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]', '', 'g') AS folded FROM part")
def p4(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.fold_text(F.concat_ws(" ", "p_name", "p_type")).alias("folded"))


@query("P5", """SELECT doc_id, sha256(lower(coalesce(text, ''))) AS text_hash, md5(trim(coalesce(text, ''))) AS trimmed_key,
  md5(concat_ws('|', source, lang, doc_id::VARCHAR)) AS part_key, sha256(concat_ws('|', coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS queue_key FROM documents""")
def p5(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.content_hash(text).alias("text_hash"), T.trimmed_md5(text).alias("trimmed_key"),
        F.md5(F.concat_ws("|", "source", "lang", F.col("doc_id").cast("string")).cast("binary")).alias("part_key"), T.identity_key(F.col("source"), F.col("doc_id")).alias("queue_key"),
    )


@query("P6", """SELECT p_partkey, round(least(greatest(p_retailprice / 1930 * 100, 0), 100), 2) AS price_score, round(least(greatest(p_size / 50.0::DOUBLE, 0), 100) * CASE WHEN p_size <= 50 THEN 100 ELSE 1 END, 2) AS size_score FROM part""")
def p6(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_score(F.col("p_retailprice"), 1930.0).alias("price_score"), S.normalize_score(F.col("p_size") / 50.0).alias("size_score"))


@query("P7", """WITH s AS (SELECT c_custkey, least(greatest((c_acctbal + 1000) / 110, 0), 100) AS v FROM customer)
SELECT c_custkey, CASE WHEN v >= 80 THEN '80-100' WHEN v >= 60 THEN '60-80' WHEN v >= 40 THEN '40-60' WHEN v >= 20 THEN '20-40' ELSE '0-20' END AS band, CASE WHEN v >= 75 THEN 'strong' WHEN v >= 60 THEN 'weak' END AS level FROM s""")
def p7(spark, sf_dir):
    v = S.clamp((F.col("c_acctbal") + 1000) / 110, 0.0, 100.0)
    return table(spark, sf_dir, "customer").select("c_custkey", S.score_band(v).alias("band"), S.level(v).alias("level"))


@query("P8", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 8) AS scaled FROM part")
def p8(spark, sf_dir):
    return S.min_max(table(spark, sf_dir, "part"), "p_retailprice", "scaled").select("p_partkey", F.round("scaled", 8).alias("scaled"))


_PARTS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity * 2 END AS a, CASE WHEN l_suppkey % 4 <> 0 THEN l_discount * 1000 END AS b, CASE WHEN l_linenumber <> 2 THEN l_tax * 1000 END AS c FROM lineitem"""


@query("P9", f"""SELECT l_orderkey, l_linenumber, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif((a IS NOT NULL)::INT * 0.5::DOUBLE + (b IS NOT NULL)::INT * 0.3::DOUBLE + (c IS NOT NULL)::INT * 0.2::DOUBLE, 0), 6) AS mean FROM ({_PARTS})""")
def p9(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(_PARTS)
    return rows.select("l_orderkey", "l_linenumber", F.round(S.weighted_mean([(F.col("a"), 0.5), (F.col("b"), 0.3), (F.col("c"), 0.2)]), 6).alias("mean"))


@query("P9b", f"""WITH f AS (SELECT *, coalesce(a, c) AS feed FROM ({_PARTS}))
SELECT l_orderkey, l_linenumber, feed, round((coalesce(feed * 0.35, 0) + coalesce(b * 0.45, 0)) / nullif((feed IS NOT NULL)::INT * 0.35::DOUBLE + (b IS NOT NULL)::INT * 0.45::DOUBLE, 0), 6) AS support, CASE WHEN feed IS NOT NULL AND b IS NOT NULL THEN round(greatest(0, feed - b) * feed / 100, 2) END AS excess FROM f""")
def p9b(spark, sf_dir):
    """Derived features; ``absent`` is a column that the table lacks."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    rows = S.derived_features(spark.sql(_PARTS), {"feed": ["absent", "a", "c"]}, {"support": [("feed", 0.35), ("b", 0.45), ("absent", 0.2)]}, {"excess": ("feed", "b")})
    return rows.select("l_orderkey", "l_linenumber", "feed", F.round("support", 6).alias("support"), "excess")


@query("P10", """WITH f AS (SELECT p_partkey, p_type, p_retailprice / 25 AS price, p_size * 2.0::DOUBLE AS size FROM part)
SELECT p_partkey, round(least(greatest((least(price, 100) * 2 + (100 - size) * 1) / 3 - CASE WHEN p_type LIKE '%BRASS%' THEN 10 ELSE 0 END - CASE WHEN size > 60 THEN least(15, (size - 60) / 3) ELSE 0 END, 0), 100), 6) AS fit FROM f""")
def p10(spark, sf_dir):
    price, size = F.least(F.col("p_retailprice") / 25, F.lit(100.0)), F.col("p_size") * 2.0
    fit = S.fit_score({"price": (price, 2.0), "size": (size, -1.0)}, [(F.contains("p_type", F.lit("BRASS")), 10.0)], [(size, 60.0)])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fit, 6).alias("fit"))


@query("P11", """WITH h AS (SELECT *, (position('the' IN text) > 0)::INT + (position('ing' IN text) > 0)::INT + (position('eau' IN text) > 0)::INT AS hits FROM documents)
SELECT doc_id, round(greatest(coalesce(least(n_chars / 20000, 1), 0), doc_id % 50 / 100, CASE WHEN lang IN ('en', 'de') THEN 0.15 WHEN lang = 'fr' THEN 0.4 ELSE 0 END, coalesce(CASE WHEN hits > 0 THEN least(0.2 + 0.12 * hits, 0.85) ELSE 0 END, 0)), 6)::DOUBLE AS rate FROM h""")
def p11(spark, sf_dir):
    rate = S.derived_rate(F.col("n_chars") / 20000, F.col("doc_id") % 50 / 100, S.level_rate(F.col("lang"), [("en", 0.15), ("de", 0.15), ("fr", 0.4)]), S.hit_rate(F.col("text"), ["the", "ing", "eau"], 0.2))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rate, 6).alias("rate"))


@query("P12", """WITH s AS (SELECT p_partkey, 0.6 * least(p_retailprice / 20, 100) + 0.4 * (100 - p_size * 2) AS score, p_type, p_size FROM part),
t AS (SELECT p_partkey, round(score, 6) AS score, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 60 THEN 'weak' END AS level, score >= 75 AS a, p_type LIKE '%STEEL%' AS b, p_size > 40 AS c FROM s)
SELECT p_partkey, score, level, concat_ws('|', CASE WHEN a THEN 'good' END, CASE WHEN b AND NOT a THEN 'steel' WHEN b AND a THEN 'good steel' END, CASE WHEN c AND NOT (b AND NOT a) THEN 'large' END) AS tags FROM t""")
def p12(spark, sf_dir):
    score = 0.6 * F.least(F.col("p_retailprice") / 20, F.lit(100.0)) + 0.4 * (100 - F.col("p_size") * 2)
    found = S.tags([(score >= 75, "good"), (F.contains("p_type", F.lit("STEEL")), "steel"), (F.col("p_size") > 40, "large")])
    found = S.drop_conflicts(found, [("good", "steel", "good steel"), ("steel", "large", None)])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"), S.level(score).alias("level"), F.array_join(found, "|").alias("tags"))


#: (name, expression, top of the scale, is a burden) of the six dimensions of a portrait.
_PORTRAIT = [("balance", "s_acctbal / 10000", 1, True), ("place", "s_nationkey / 20", 1, True), ("load", "s_suppkey % 13 / 10", 1, True),
             ("fibre", "s_suppkey % 7", 5, False), ("carbs", "s_suppkey % 8", 5, True), ("aid", "s_nationkey % 7", 5, False)]


def _portrait_level_sql(name: str, expression: str, top: int, burden: bool) -> str:
    (low, medium), third = ((0.35, 0.65) if burden and top == 1 else (0.25, 0.5)), "elevated" if burden else "medium_high"
    v = f"({expression})"
    return f"CASE WHEN {v} IS NULL OR {v} NOT BETWEEN 0 AND {top} THEN 'missing' WHEN {v} / {top} <= {low} THEN 'low' WHEN {v} / {top} <= {medium} THEN 'medium_low' WHEN {v} / {top} <= 0.75 THEN '{third}' ELSE 'high' END AS {name}"


@query("P13", f"""SELECT s_suppkey, {", ".join(_portrait_level_sql(*d) for d in _PORTRAIT)},
 sha256('{{"key":' || s_suppkey || ',"fibre":' || CASE WHEN s_suppkey % 7 <= 5 THEN (s_suppkey % 7)::VARCHAR ELSE 'null' END || ',"carbs":' || CASE WHEN s_suppkey % 8 <= 5 THEN (s_suppkey % 8)::VARCHAR ELSE 'null' END || '}}') AS source_hash FROM supplier""")
def p13(spark, sf_dir):
    value = {name: S.on_scale(F.expr(e), top) for name, e, top, _ in _PORTRAIT}
    levels = [(S.burden_level if burden else S.support_level)(value[name], top).alias(name) for name, _, top, burden in _PORTRAIT]
    source = F.to_json(F.struct(F.col("s_suppkey").alias("key"), value["fibre"].alias("fibre"), value["carbs"].alias("carbs")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "supplier").select("s_suppkey", *levels, F.sha2(source, 256).alias("source_hash"))
