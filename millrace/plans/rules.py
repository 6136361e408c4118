"""Queries for rule labelling (R1-R15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from .registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


_D = "(SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)"


@query("R1", f"""WITH a(alias, std, i) AS (VALUES ('thing', 'T', 0), ('ing', 'I', 1), ('eau', 'E', 2), ('the', 'H', 3), ('keit', 'K', 4)),
m AS (SELECT doc_id, arg_max(std, length(alias) * 100 - i) AS brand FROM {_D} d JOIN a ON contains(lower(text), alias) GROUP BY doc_id)
SELECT d.doc_id, brand, coalesce(brand, CASE WHEN regexp_matches(text, '[0-9]{{3}}') THEN 'numbered' WHEN regexp_matches(text, '\\ber') THEN 'er-word' END) AS product FROM {_D} d LEFT JOIN m USING (doc_id)""")
def r1(spark, sf_dir):
    tag = R.longest_alias([("thing", "T"), ("ing", "I"), ("eau", "E"), ("the", "H"), ("keit", "K")])
    brands = _docs(spark, sf_dir).select("doc_id", "text", tag("text").alias("brand"))
    category = R.first_category(F.col("text"), [("numbered", "[0-9]{3}"), ("er-word", r"\ber")])
    return brands.select("doc_id", "brand", F.coalesce("brand", category).alias("product"))


@query("R2", f"""WITH l AS (SELECT doc_id, regexp_matches(text, '[*$%&#]{{3}}') AS blocked, regexp_matches(text, 'threat|erstand') OR regexp_matches(text, 'eaux|keiten') AS body,
 regexp_matches(CASE WHEN regexp_matches(text, 'threat|erstand|eaux|keiten') THEN text ELSE lang || ' eaux' END, 'threat|erstand') AS a, regexp_matches(CASE WHEN regexp_matches(text, 'threat|erstand|eaux|keiten') THEN text ELSE lang || ' eaux' END, 'eaux|keiten') AS b FROM {_D})
SELECT doc_id, CASE WHEN blocked THEN '' WHEN a AND b THEN 'first|second|ambiguous' WHEN a THEN 'first' WHEN b THEN 'second' ELSE '' END AS labels FROM l""")
def r2(spark, sf_dir):
    labels = R.route(F.col("text"), F.concat("lang", F.lit(" eaux")), F.col("source"), {"first": "threat|erstand", "second": "eaux|keiten"}, r"[*$%&#]{3}")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(labels, "|").alias("labels"))


@query("R3", f"""WITH s AS (SELECT doc_id, regexp_matches(text, 'ing\\b') AS a, regexp_matches(text, '[0-9]') AS b, regexp_matches(text, '\\bth') AS c, contains(text, 'eaux') AS condition, regexp_full_match(text, '\\s*(ok|thanks)[.!]*\\s*') AS weak FROM {_D}),
v AS (SELECT *, (a OR b) AND (b OR c) AND NOT weak AS chosen, (a::INT * 3 + b::INT * 2 + c::INT * 2)::BIGINT AS score, concat_ws('|', CASE WHEN a THEN 'Need' END, CASE WHEN c THEN 'Switch' END) AS found FROM s)
SELECT doc_id, concat_ws('|', CASE WHEN a THEN 'need' END, CASE WHEN b THEN 'number' END, CASE WHEN c THEN 'switch' END) AS signals, score, condition OR (chosen AND score >= 5) AS keep,
 CASE WHEN found <> '' THEN found WHEN condition THEN 'Need' WHEN chosen THEN 'Decision' ELSE '' END AS intents FROM v""")
def r3(spark, sf_dir):
    text = F.col("text")
    names, score = R.signal_score(text, [("need", r"ing\b", 3), ("number", "[0-9]", 2), ("switch", r"\bth", 2)])
    condition, weak = F.contains(text, F.lit("eaux")), text.rlike(r"^\s*(ok|thanks)[.!]*\s*\z")
    keep, intents = R.choice_verdict(names, score, {"need": "Need", "switch": "Switch"}, ["need", "number"], ["number"], condition, weak)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(names, "|").alias("signals"), score.alias("score"), keep.alias("keep"), F.array_join(intents, "|").alias("intents"))


@query("R4", """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text), '') AS prior FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'tion\\b') THEN 'high' WHEN regexp_matches(text, 'ing') AND regexp_matches(prior, 'tion\\b') THEN 'medium' WHEN regexp_matches(prior, 'tion\\b') THEN 'low' END AS confidence FROM c""")
def r4(spark, sf_dir):
    from pyspark.sql import Window

    prior = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")), F.lit(""))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), prior.alias("prior"))
    return turns.select("conv_id", "turn", R.condition_confidence(F.col("text"), F.col("prior"), r"tion\b", "ing").alias("confidence"))


_R5 = [("form", "list", r"\|"), ("form", "loud", "!!"), ("form", "list", r" \| "), ("data", "mail", "@"), ("data", "number", "[0-9]{6}")]


@query("R5", f"""SELECT doc_id, concat_ws('|', CASE WHEN contains(text, '|') THEN 'form>list' END, CASE WHEN contains(text, '!!') THEN 'form>loud' END, CASE WHEN contains(text, '@') THEN 'data>mail' END, CASE WHEN regexp_matches(text, '[0-9]{{6}}') THEN 'data>number' END) AS labels FROM {_D}""")
def r5(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(R.two_level_labels(F.col("text"), _R5), "|").alias("labels"))


@query("R6", f"""SELECT doc_id, CASE WHEN contains(text, '@') THEN 'data>mail' WHEN contains(text, '!!') THEN 'form>loud' WHEN contains(text, '|') THEN 'form>list' ELSE 'plain' END AS label FROM {_D}""")
def r6(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.first_of(R.two_level_labels(F.col("text"), _R5), ["data>mail", "form>loud", "form>list"], "plain").alias("label"))


_NEXT = "CASE WHEN event_id % 3 = 0 THEN 'click' ELSE 'signup' END"


@query("R7", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type IS NOT NULL THEN 'view' WHEN event_type <> {_NEXT} THEN event_type END AS source, CASE WHEN event_id % 2 = 0 AND event_type IS NOT NULL OR event_type <> {_NEXT} THEN {_NEXT} END AS target FROM events""")
def r7(spark, sf_dir):
    path = R.switch_path(["click", "view", "purchase", "error", "signup"], (r"from (?P<a>BRAND) to (?P<b>BRAND)", r"left (?P<a>BRAND) for (?P<b>BRAND)"))
    events = table(spark, sf_dir, "events")
    text = F.concat(F.lit("Once "), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, " then moved from view to ").otherwise(" and later "), F.when(F.col("event_id") % 3 == 0, "click").otherwise("signup"))
    return events.select("event_id", path(text).alias("p")).select("event_id", "p.source", "p.target")


_WORDS = "that|the|and|of"


@query("R7b", f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM {_D}), p(pattern, glue, i) AS (VALUES ('({_WORDS}) in ({_WORDS})', ' in ', 1), ('({_WORDS}) [a-z]+, ({_WORDS})', ', ', 2)),
u AS (SELECT doc_id, i, unnest(regexp_extract_all(t, pattern)) AS hit, unnest(regexp_split_to_array(t, pattern)[:len(regexp_extract_all(t, pattern))]) AS gap, unnest(range(1, len(regexp_extract_all(t, pattern)) + 1)) AS n FROM d, p),
m AS (SELECT doc_id, i, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, i ORDER BY n) - length(hit) AS place FROM u),
v AS (SELECT doc_id, i, place, regexp_extract(hit, '^({_WORDS})') AS a, regexp_extract(hit, '(?:^|.*[ ])({_WORDS})$', 1) AS b FROM m),
l AS (SELECT doc_id, arg_max({{'a': a, 'b': b}}, place * 10 + i) AS s FROM v WHERE a <> b GROUP BY 1),
f AS (SELECT doc_id, m[1] AS a, list_filter(m, lambda x: x <> m[1])[1] AS b FROM (SELECT doc_id, regexp_extract_all(t, '{_WORDS}') AS m FROM d))
SELECT doc_id, CASE WHEN s IS NOT NULL THEN s.a WHEN f.b IS NOT NULL THEN f.a END AS source, CASE WHEN s IS NOT NULL THEN s.b ELSE f.b END AS target FROM f LEFT JOIN l USING (doc_id)""")
def r7b(spark, sf_dir):
    """Paths in whole texts: sentences of two patterns, else the first two names."""
    path = R.switch_path(_WORDS.split("|"), ("(?P<a>BRAND) in (?P<b>BRAND)", "(?P<a>BRAND) [a-z]+, (?P<b>BRAND)"))
    return _docs(spark, sf_dir).select("doc_id", path(F.lower("text")).alias("p")).select("doc_id", "p.source", "p.target")


@query("R8")
def r8(spark, sf_dir):
    spans = R.mention_spans(["thing", "nothing", "tion"], {"better": r"bl[ey]", "worse": r"\bno"}, ["the ", "un"], onsets={"before": r"\bsince\b|\bold", "after": r"\bafter\b|\bnew"})
    return _docs(spark, sf_dir).select("doc_id", F.explode(spans("text")).alias("m")).select("doc_id", "m.*")


@query("R9", f"""WITH d AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), 'that|the|and|of') AS m, regexp_split_to_array(lower(text), 'that|the|and|of') AS p FROM {_D}),
u AS (SELECT doc_id, t, unnest(m) AS name, unnest(p[:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM d),
m AS (SELECT doc_id, t, i, name, (sum(length(gap) + length(name)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM u),
n AS (SELECT x.doc_id, x.t, x.name AS a, y.name AS b, greatest(0, x.e - length(x.name) - 24) AS low, least(length(x.t), y.e + 36) AS high, substr(x.t, x.e + 1, y.e - length(y.name) - x.e) AS between_ FROM m x JOIN m y ON x.doc_id = y.doc_id AND y.i = x.i + 1 WHERE x.name <> y.name AND NOT (x.name = 'of' AND y.name = 'the')),
c AS (SELECT *, substr(t, low + 1, high - low) AS ctx FROM n WHERE length(between_) <= 12 AND CASE WHEN contains(between_, ',') THEN regexp_matches(between_, ' in | to ') ELSE regexp_matches(between_, ' in | to |,') END),
k AS (SELECT c.doc_id, a, b, c.low, c.high FROM c JOIN m ON m.doc_id = c.doc_id AND m.e - length(m.name) >= c.low AND m.e <= c.high WHERE regexp_matches(ctx, ' (or|if|for|is) ') AND NOT contains(ctx, ' by ') GROUP BY ALL HAVING count(DISTINCT m.name) <= 2)
SELECT DISTINCT doc_id, least(a, b) AS first, greatest(a, b) AS second, 0.9::DOUBLE AS confidence FROM k""")
def r9(spark, sf_dir):
    names = {n: n for n in ("the", "that", "and", "of")}
    pairs = R.comparison_pairs(R.PairRules(names, " in | to |,", " in | to ", " (or|if|for|is) ", excluded=" by ", compounds=frozenset({("of", "the")})))
    return R.best_pairs(_docs(spark, sf_dir).select("doc_id", F.explode(pairs("text")).alias("p")).select("doc_id", "p.*"), "doc_id")


@query("R10", f"""WITH k(category, symptom, word) AS (VALUES ('a', 'x', 'threat'), ('a', 'x', 'thing'), ('a', 'y', 'eaux'), ('b', 'z', 'keit'))
SELECT doc_id, category, symptom, string_agg(word, '|' ORDER BY word DESC) AS matched FROM {_D} JOIN k ON contains(lower(text), word) GROUP BY doc_id, category, symptom""")
def r10(spark, sf_dir):
    found = R.keyword_recall(F.col("text"), {"a": {"x": ["threat", "thing"], "y": ["eaux"]}, "b": {"z": ["keit"]}})
    return _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.category", "f.symptom", F.array_join("f.matched", "|").alias("matched"))


@query("R11", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_type), 'econ') AND p_size IN (1, 5, 9, 14, 23, 36, 45, 49) AND p_retailprice >= 902")
def r11(spark, sf_dir):
    return R.search(table(spark, sf_dir, "part"), {"p_type": "Econ"}, {"p_size": [1, 5, 9, 14, 23, 36, 45, 49]}, {"p_retailprice": (902.0, None)}).select("p_partkey", "p_name", "p_retailprice")


@query("R12", "SELECT page_id, url FROM pages WHERE page_id IS NOT NULL AND regexp_matches(url, '^https?://[^/\\s]+/') AND regexp_matches(html, '<title>[^<]+</title>')")
def r12(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("page_id").isNotNull() & F.col("url").rlike(r"^https?://[^/\s]+/") & F.col("html").rlike("<title>[^<]+</title>")).select("page_id", "url")


@query("R13", """WITH f AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r, count(DISTINCT l_suppkey) AS sources,
 count(*) AS lines, max(l_quantity) AS most, min(l_quantity) AS least, count(DISTINCT l_linestatus) AS states, max(year(l_shipdate)) - min(year(l_shipdate)) AS years FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, unnest(list_filter([CASE WHEN a IS NULL AND n IS NULL AND r IS NULL THEN NULL WHEN coalesce(a, -1) >= coalesce(n, -1) AND coalesce(a, -1) >= coalesce(r, -1) THEN 'main:A' WHEN coalesce(n, -1) >= coalesce(r, -1) THEN 'main:N' ELSE 'main:R' END,
 CASE WHEN sources >= 3 THEN 'sources:many' WHEN sources = 2 THEN 'sources:two' ELSE 'sources:one' END, CASE WHEN lines >= 35 THEN 'lines:many' WHEN lines < 25 THEN 'lines:few' END, CASE WHEN most = 50 THEN 'order:full' END,
 CASE WHEN most >= 10 * least THEN 'spread:wide' WHEN most < 4 * least THEN 'spread:narrow' END, CASE WHEN states > 1 THEN 'state:mixed' ELSE 'state:single' END, CASE WHEN years >= 5 THEN 'life:long' WHEN years < 2 THEN 'life:short' END], lambda x: x IS NOT NULL)) AS label FROM f""")
def r13(spark, sf_dir):
    q = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    year = F.year("l_shipdate")
    f = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        q("A").alias("a"), q("N").alias("n"), q("R").alias("r"), F.countDistinct("l_suppkey").alias("sources"), F.count("*").alias("lines"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"),
        F.countDistinct("l_linestatus").alias("states"), (F.max(year) - F.min(year)).alias("years"))
    c = F.col
    labels = R.structure_labels([
        ("main", R.arg_max_label({"A": c("a"), "N": c("n"), "R": c("r")})),
        ("sources", F.when(c("sources") >= 3, "many").when(c("sources") == 2, "two").otherwise("one")),
        ("lines", F.when(c("lines") >= 35, "many").when(c("lines") < 25, "few")),
        ("order", F.when(c("most") == 50, "full")),
        ("spread", F.when(c("most") >= 10 * c("least"), "wide").when(c("most") < 4 * c("least"), "narrow")),
        ("state", F.when(c("states") > 1, "mixed").otherwise("single")),
        ("life", F.when(c("years") >= 5, "long").when(c("years") < 2, "short"))])
    return f.select("l_partkey", F.explode(labels).alias("label"))


_RULES = [("c1", "A-F", "required_any", 2.0), ("c1", "N-F", "required_any", 2.0), ("c1", "R-F", "negative", 1.0), ("c2", "A-O", "required_all", 3.0), ("c2", "N-O", "required_all", 3.0), ("c2", "R-O", "optional", 1.0)]


@query("R14", f"""WITH rules(rule, tag_key, role, weight) AS (VALUES {", ".join(str(r) for r in _RULES)}),
t AS (SELECT l_suppkey, l_returnflag || '-' || l_linestatus AS tag_key, max(l_quantity / 50) AS s FROM lineitem GROUP BY 1, 2),
n AS (SELECT rule, count(*) FILTER (role = 'required_all') AS all_n, count(*) FILTER (role = 'required_any') AS any_n FROM rules GROUP BY rule),
h AS (SELECT l_suppkey, rule, count(*) FILTER (role = 'required_all') AS has_all, count(*) FILTER (role = 'required_any') AS has_any, sum(CASE WHEN role = 'negative' THEN -1 ELSE 1 END * weight::DOUBLE * s) AS score FROM t JOIN rules USING (tag_key) GROUP BY 1, 2)
SELECT l_suppkey, rule, round(score, 6) AS score, CASE WHEN score >= 7 THEN 'strong' WHEN score >= 4 THEN 'medium' ELSE 'weak' END AS level FROM h JOIN n USING (rule) WHERE has_all = all_n AND (any_n = 0 OR has_any > 0) AND score > 0""")
def r14(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "rule string, tag_key string, role string, weight double")
    tags = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat_ws("-", "l_returnflag", "l_linestatus").alias("tag_key"), (F.col("l_quantity") / 50).alias("tag_score"))
    return R.capability_scores(tags, rules, "l_suppkey").withColumn("score", F.round("score", 6))


_ATTRIBUTES = [("joint", "and", r"\band\b"), ("joint", "or", r"\bor\b"), ("mark", "digits", "[0-9]{4}"), ("mark", "loud", "!!")]


@query("R15", f"""WITH e AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\\band\\b') AND regexp_matches(text, '!!|[*]{{3}}') THEN 'mixed' WHEN regexp_matches(text, '\\band\\b') THEN 'positive' WHEN regexp_matches(text, '!!|[*]{{3}}') THEN 'negative' ELSE 'neutral' END AS polarity,
 CASE WHEN regexp_matches(text, '\\bwas\\b') THEN 'lasting' ELSE 'once' END AS durability,
 unnest([{{'kind': 'joint', 'attributes': concat_ws('|', CASE WHEN regexp_matches(text, '\\band\\b') THEN 'and' END, CASE WHEN regexp_matches(text, '\\bor\\b') THEN 'or' END)}},
  {{'kind': 'mark', 'attributes': concat_ws('|', CASE WHEN regexp_matches(text, '[0-9]{{4}}') THEN 'digits' END, CASE WHEN contains(text, '!!') THEN 'loud' END)}}]) AS g FROM {_D} WHERE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 6)
SELECT doc_id, g.kind AS kind, g.attributes AS attributes, polarity, durability FROM e WHERE g.attributes <> ''""")
def r15(spark, sf_dir):
    from ..functions.text import matches, substantive_length

    rows = _docs(spark, sf_dir).where(substantive_length(F.col("text")) >= 6)
    found = rows.select("doc_id", R.polarity(F.col("text"), r"\band\b", "!!|[*]{3}").alias("polarity"), F.when(matches(F.col("text"), r"\bwas\b"), "lasting").otherwise("once").alias("durability"), F.explode(R.grouped_attributes(F.col("text"), _ATTRIBUTES)).alias("g"))
    return found.select("doc_id", "g.kind", F.array_join("g.attributes", "|").alias("attributes"), "polarity", "durability")
