"""Dictionaries of names in texts: against plain Python, on overlapping names, odd texts and a large dictionary."""

import random

from pyspark.sql import functions as F

from millrace.operators import rules


def _texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abC ") for _ in range(r.randrange(40))) for _ in range(n)] + ["", None, "ab" * 20_000]


def _names(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("ab c") for _ in range(r.randrange(1, 6))) for _ in range(n)]


def test_all_overlapping_mentions():
    names = _names(1, 60)
    known = rules.Dictionary([*names, ""])
    for text in _texts(2, 200)[:-2] + ["abcabc"]:
        text = text.lower()
        expected = sorted((i, a, a + len(n)) for i, n in enumerate(dict.fromkeys(names)) for a in range(len(text)) if text.startswith(n, a))
        assert sorted(known.mentions(text)) == expected
    assert list(rules.Dictionary([]).mentions("abc")) == []


def test_longest_alias_against_plain_python(spark):
    aliases = [(n.upper() if i % 3 else n, f"s{i}") for i, n in enumerate(_names(3, 80))]
    texts = _texts(4, 150)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", rules.longest_alias(aliases)("t").alias("s")).collect()

    def plain(text):
        hits = [(-len(a), i, s) for i, (a, s) in enumerate(aliases) if a.lower() in (text or "").lower()]
        return min(hits)[2] if hits else None

    assert {r["i"]: r["s"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_recall_by_automaton_equals_built_in_functions(spark):
    names = _names(5, 60)
    keywords = {"x": {"one": names[:20], "two": names[10:30]}, "y": {"one": [*names[30:], "", names[0]], "none": []}}
    rows = spark.createDataFrame([(t,) for t in _texts(6, 100)], "t string")
    both = rows.select(rules.keyword_recall(F.col("t"), keywords, few=1000).alias("a"), rules.keyword_recall(F.col("t"), keywords, few=0).alias("b"))
    assert all(r["a"] == r["b"] for r in both.where("t IS NOT NULL").collect())
    assert all(not r["b"] for r in both.where("t IS NULL").collect())


def test_large_dictionary_is_read_once_per_text(spark):
    """200,000 names: an alternation or one test per name would take minutes on these texts."""
    names = [f"name{i:06d}" for i in range(200_000)]
    texts = spark.range(2_000).select(F.concat(F.lit("before Name"), F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit(" and more text"), 50)).alias("t"), "id")
    got = texts.select("id", rules.longest_alias([(n, n[4:]) for n in names])("t").alias("s"), rules.keyword_recall(F.col("t"), {"a": {"b": names}}).alias("k"))
    assert got.where("cast(s AS long) = id AND k[0].matched[0] = concat('name', s) AND size(k) = 1 AND size(k[0].matched) = 1").count() == 2_000


def test_many_mentions_in_one_long_text(spark):
    """Overlap and nearest words are looked up, not searched through: 30,000 mentions in one text."""
    spans = rules.mention_spans(["pain", "ain"], {"better": "good", "worse": "bad"}, ["no "], window=5)
    rows = spark.createDataFrame([("no pain good pain bad " * 15_000,)], "t string")
    got = rows.select(F.explode(spans("t")).alias("m")).groupBy("m.symptom", "m.negated", "m.outcome").count().collect()
    assert sorted(map(tuple, got)) == [("pain", False, "better", 15_000), ("pain", True, "better", 15_000)]
