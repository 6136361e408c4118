"""Operators that SQL can't check, against plain Python; boundaries and properties of others."""

import collections
import difflib
import itertools
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.functions import parse, scores, text
from millrace.operators import incremental, match, ranking, rules, similar, stats


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def values(df):
    return [tuple(r) for r in df.collect()]


def test_normalize_text_drops_noise_and_is_idempotent(spark):
    raw = "A​ see http://x.y/z #topic# [smile] ☀ @you  ok"
    df = spark.createDataFrame([(raw,), (None,), ("",)], "t string").select(text.normalize_text(F.col("t")).alias("t"))
    assert values(df) == [("A see ok",), ("",), ("",)]
    assert values(df.select(text.normalize_text(F.col("t")))) == values(df)


def test_noise_classes_and_fillers(spark):
    raw = {"‪a‮b": "ab", "x WWW.site.example/y z": "x z", "go ➡ ⬛️ 1️⃣ 🇫🇷 on": "go 1 on", "[sixteen letters!] [seventeen letters] k": "[seventeen letters] k", "hi @na·me-1.x, you": "hi , you", "@a☀b c": "b c"}
    df = spark.createDataFrame([(t,) for t in raw], "t string").select("t", text.normalize_text(F.col("t")).alias("clean"))
    assert dict(values(df)) == raw
    lines = {"7 7": True, "7": False, "ok": False, "OK !!": False, "o k": False, "ok then": True, "。。": False, "666～": False, "": False}
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", text.is_meaningful(F.col("t"), "ok|6+").alias("m"))
    assert dict(values(df)) == lines


def test_fold_and_grams(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ-Width ß",), (None,), ("abcdefghabcdefgh",)], "t string")
    got = values(df.select(text.fold_text("t"), text.repeated_gram_share()("t")))
    assert [g[0] for g in got] == ["fullwidthss", None, "abcdefghabcdefgh"]
    assert got[0][1] == 0.0 or got[0][1] is not None
    assert abs(got[2][1] - (1 - 8 / 9)) < 1e-12


def test_nested_names_and_segmentation():
    assert parse.split_nested("Chicken (fresh, 20%), Rice 5%; Fish[a,b], water", ("water",), {"fish": "cod"}) == ["chicken", "rice", "cod"]
    assert parse.split_nested(None, (), {}) == []
    grouped = "Fish products 43% (tuna, sardine (smoked); oil), Meat products 42%, chicken, meal), Plum (open, end"
    assert parse.split_nested(grouped, (), {}, headers=("products",)) == ["tuna", "sardine", "oil", "chicken", "meal", "plum"]
    assert parse.split_nested("A products (b products (c, d), e)", (), {}, headers=("products",)) == ["c", "d", "e"]
    known = frozenset({"ab", "c", "abc", "d"})
    assert parse.only_segmentation("abd", known) == ["ab", "d"]
    assert parse.only_segmentation("abc", known) == []  # two ways
    assert parse.only_segmentation("xyz", known) == []


def test_longest_alias_prefers_length_then_order(spark):
    tag = rules.longest_alias([("cat", "C"), ("catnip", "F"), ("dogfood", "D")])
    df = spark.createDataFrame([("CatNip and dogfood",), ("cat",), (None,), ("none",)], "t string")
    assert values(df.select(tag("t"))) == [("D",), ("C",), (None,), (None,)]


def test_words_of_rules_are_ascii_words(spark):
    """As in RE2 (the SQL) and Python's re.ASCII: letters outside ASCII are no parts of words. The whole texts of the small
    tables have none of the few places where this tells."""
    texts = ["schüer", "schier", "éer", "e\u0301er", "er", "xer", "ünder üer", "_er", "1er", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = values(df.select("t", rules.first_category(F.col("t"), [("er-word", r"\ber")]).alias("c")))
    assert dict(got) == {t: "er-word" if t and re.search(r"\ber", t, re.A) else None for t in texts}
    for pattern in (r"\ber\b", r"e\b", r"\Be", r"\bx?er", r"n\B", r"\b\w\w\b", r"\bx*é", r"\\b|\bs"):
        got = dict(values(df.select("t", text.matches(F.col("t"), pattern))))
        assert got == {t: None if t is None else bool(re.search(pattern, t, re.A)) for t in texts}, pattern
    assert text.word_edges(r"\Q\b\E\\b") == r"\Q\b\E\\b"


def test_condition_words_end_before_letters_outside_ascii(spark):
    rows = [("tionê", ""), ("action", ""), ("tionx", ""), ("doing", "tionê"), ("x", "tionê"), ("x", "tionx")]
    df = spark.createDataFrame(rows, "own string, prior string").select(rules.condition_confidence(F.col("own"), F.col("prior"), r"tion\b", "ing"))
    assert [r[0] for r in values(df)] == ["high", "high", None, "medium", "low", None]


def test_switch_path_last_sentence_wins(spark):
    path = rules.switch_path(["alpha", "beta", "gamma"], (r"from (?P<a>BRAND) to (?P<b>BRAND)",))
    df = spark.createDataFrame([("from alpha to beta, later from beta to gamma",), ("gamma then alpha",), ("from beta to beta",), (None,)], "t string")
    assert values(df.select(path("t").alias("p")).select("p.*")) == [("beta", "gamma"), ("gamma", "alpha"), (None, None), (None, None)]


def test_mention_spans_negation_and_outcome(spark):
    spans = rules.mention_spans(["soft stool", "stool"], {"better": "better", "worse": "worse"}, ["no "], window=20)
    df = spark.createDataFrame([("no soft stool now better, stool worse",)], "t string")
    got = values(df.select(F.explode(spans("t")).alias("m")).select("m.*"))
    assert got == [("soft stool", 3, 13, True, "better"), ("stool", 26, 31, False, "worse")]


def test_comparison_pairs_best_confidence(spark):
    rule = rules.PairRules(
        {"royal": "royal", "roy": "royal", "acme": "acme", "apex": "apex", "a&b": "a&b", "cat": "cat", "dog": "dog"}, " or | and |,", " or | and ", "which|choose", leading="torn", excluded="as well as",
        compounds=frozenset({("cat", "dog")}), phrases=((r"between (?P<a>.{1,20}?)(?P<connector> and |,)(?P<b>(?:my )?\S+)(?P<tail>.*)", 0.8),))
    texts = {
        1: "Which one, ACME or Royal?",  # connector and choice
        2: "acme royal which",  # no connector
        3: "acme, royal which",  # a comma alone joins nothing
        4: "acme, or royal which",
        5: "acme or royal are fine",  # no choice
        6: "torn: acme or roy",
        7: "acme or royal or apex which",  # three names
        8: "acme or royal which, as well as more",
        9: "which: cat and dog",  # one name
        10: "which: roy or royal",
        11: "acme " + "x" * 12 + " or royal which",
        12: "which " + "y" * 40 + " acme or royal",  # the choice is too far
        13: "between the acme thing and my royal",  # a phrase
        14: "between acme,royal it is",
        15: "between acme,royal i choose",
        16: "which is it between acme and royal",  # both ways: the better one counts
        17: None,
    }
    df = spark.createDataFrame(list(texts.items()), "id int, t string").select("id", F.explode(rules.comparison_pairs(rule)("t")).alias("p")).select("id", "p.*")
    assert sorted(values(rules.best_pairs(df, "id"))) == [(1, "acme", "royal", 0.9), (4, "acme", "royal", 0.9), (6, "acme", "royal", 0.9), (13, "acme", "royal", 0.8), (15, "acme", "royal", 0.8), (16, "acme", "royal", 0.9)]


def test_sequence_and_ordered_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in values(df.select(match.sequence_ratio("a", "b")))] == [difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in (("abcd", "bcde"), ("", ""), (None, "x"))]
    lists = spark.createDataFrame([(["a", "b"], ["a", "c", "b"]), ([], [])], "x array<string>, y array<string>")
    got = [r[0] for r in values(lists.select(match.ordered_similarity(F.col("x"), F.col("y"))))]
    assert abs(got[0] - (0.5 * 6 / 11 + 0.3 * 1.25 / 1.5 + 0.2 * 2 / 3)) < 1e-5 and got[1] == 0.0


def test_view_boundary(spark):
    rows = [("p", "v", f"2024-01-01 00:{m:02d}:{s:02d}") for m, s in ((0, 0), (29, 59), (30, 0), (59, 59))] + [("p", "w", None)]
    df = spark.createDataFrame(rows, "post string, viewer string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(values(incremental.counted_views(df, ["post", "viewer"], "at"))) == [("p", "v", 2, 4), ("p", "w", 0, 1)]


def test_stream_counts_like_batch(spark, tmp_path):
    from millrace.streaming.views import stream_counted_views

    rows = [("p", f"v{i % 3}", f"2024-01-01 {h:02d}:{(i * 7) % 60:02d}:00") for h in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "post string, viewer string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_counted_views(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "post", "viewer", "at")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(p, v): n for p, v, n, _ in values(incremental.counted_views(df, ["post", "viewer"], "at"))}
    assert {(p, v): n for p, v, n in values(spark.sql("SELECT post, viewer, count(*) FROM counted GROUP BY 1, 2"))} == want


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", "ok"), (2, "b", "rejected")], "k int, v string, s string")
    n = spark.createDataFrame([(1, "A", "ok"), (2, "B", "ok"), (3, "C", "ok")], "k int, v string, s string")
    once = incremental.upsert(t, n, ["k"], ["v", "s"], "s = 'rejected'")
    assert sorted(values(once)) == [(1, "A", "ok"), (2, "b", "rejected"), (3, "C", "ok")]
    assert sorted(values(incremental.upsert(once, n, ["k"], ["v", "s"], "s = 'rejected'"))) == sorted(values(once))


def test_clusters_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    up = {i: i for p in pairs for i in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = dict(values(similar.clusters(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {i: top(i) for p in pairs for i in p if p[0] != p[1]}
    assert values(similar.clusters(spark.createDataFrame([], "a long, b long"))) == []


def test_average_tie_percentile_is_permutation_invariant(spark):
    rows = [(i, float(i // 3)) for i in range(20)] + [(99, None)]
    a = spark.createDataFrame(rows, "k int, v double")
    b = spark.createDataFrame(rows[::-1], "k int, v double").repartition(3)
    x, y = (dict(values(scores.average_tie_percentile(d, "v", [], "r").select("k", "r"))) for d in (a, b))
    assert x == y and x[99] is None and abs(x[0] - 2 / 20 * 100) < 1e-9


def test_quantiles_and_places_against_plain_python(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1e15, -5.0, *(rng.gauss(0, 1) for _ in range(20))])) for _ in range(700)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for slots in (2, 256):
        got = {tuple(r) for r in values(scores.value_places(df, "v", ["g"], slots).select("__e_g", "__v", "__n", "__before", "__all"))}
        want = set()
        for g in {r[0] for r in rows}:
            own = [v for h, v in rows if h == g and v is not None]
            want |= {(g, v, own.count(v), sum(x < v for x in own), len(own)) for v in own}
        assert got == want
    got = {r.g: (r.q, r.m) for r in scores.exact_quantiles(df, "v", ["g"], {"q": 0.25, "m": 0.5}).collect()}
    assert got.keys() == {"a", "b", None, "one"}
    for g, (q, m) in got.items():
        own = [v for h, v in rows if h == g and v is not None]
        assert np.allclose([q, m], np.quantile(own, [0.25, 0.5]), rtol=1e-12)
    empty = stats.pool_position(df.limit(0), "v")
    assert values(empty) == [] and stats.nearest_rank(df.limit(0), "v", 0.5).first().threshold is None


def test_wilson_and_outcomes_count_a_clue_once(spark):
    rows = [("s", 1, "improved"), ("s", 1, "improved"), ("s", 2, "worsened")]
    got = stats.outcome_stats(spark.createDataFrame(rows, "g string, c int, o string"), ["g"], "c", "o").first()
    assert (got.n, got.improved, got.worsened, got.uncertain) == (2, 1, 1, 0) and 0 < got.wilson < 0.5


def test_coverage_meets_classes_of_products(spark):
    """Against plain Python; 50 groups that reach 4,000 products each join a few rows, not 200,000."""
    draw = random.Random(5)
    products = [(p, v) for p in range(300) for v in draw.sample("abcdef", draw.choice([1, 1, 1, 2, 3]))] + [(p, "a") for p in range(300, 310)] * 2 + [(None, "a"), (400, None), (401, "z")]
    mentions = [(g, draw.choice("abcdef")) for g in range(20) for _ in range(draw.randint(1, 4))] + [(98, "y"), (99, None), (None, "b")]
    df = stats.coverage(spark.createDataFrame(mentions, "g int, via string"), spark.createDataFrame(products, "p int, via string"), "g", "via", "p")
    expected = {}
    for g, v in mentions:
        expected.setdefault(g, set()).update(p for p, w in products if v is not None and w == v and p is not None)
    total = len({p for p, _ in products if p is not None})
    assert sorted(values(df), key=str) == sorted(((g, len(s), len(s) / total) for g, s in expected.items() if s), key=str)
    many = spark.range(4000).selectExpr("id AS p", "'v' AS via")
    df = stats.coverage(spark.range(50).selectExpr("id AS g", "'v' AS via"), many, "g", "via", "p")
    assert {r[1] for r in values(df)} == {4000}
    assert max(joined_rows(df)) <= 50


def joined_rows(df):
    """Rows out of each join of a DataFrame's plan that has run."""
    found = []

    def walk(node):
        plan = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan() if "QueryStage" in node.getClass().getSimpleName() else None
        if plan is not None:
            walk(plan)
        metrics = node.metrics()
        if "Join" in node.getClass().getSimpleName() and metrics.contains("numOutputRows"):
            found.append(metrics.apply("numOutputRows").value())
        children = node.children()
        for i in range(children.length()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_md5_modulo_and_ordered_clusters(spark):
    import hashlib

    df = spark.createDataFrame([("a", 7), ("b", 3)], "k string, n long")
    assert [r[0] for r in values(df.select(ranking.md5_modulo("k", "n")))] == [int(hashlib.md5(k.encode()).hexdigest(), 16) % n for k, n in (("a", 7), ("b", 3))]


def plain_ordered(x, y):
    """(similarity, share of equal names among the first five places) of two lists."""
    if not x or not y:
        return 0.0, 0.0
    longer = max(len(x), len(y))
    equal = sum(1 / (i + 1) for i in range(min(len(x), len(y))) if x[i] == y[i]) / sum(1 / (i + 1) for i in range(longer))
    shared = set(x) & set(y)
    last = [{n: i for i, n in enumerate(v)} for v in (x, y)]
    w = {n: 1 / (last[0][n] + 1) for n in shared}
    near = sum(v / (1 + abs(last[0][n] - last[1][n])) for n, v in w.items()) / sum(w.values()) if shared else 0
    top = min(5, len(x), len(y))
    return round(0.5 * equal + 0.3 * near + 0.2 * len(shared) / len(set(x) | set(y)), 5), sum(x[i] == y[i] for i in range(top)) / top


def plain_nutrition(m, o):
    both = set(m or {}) & set(o or {})
    alike = sum(abs(m[k] - o[k]) <= max(0.05, abs(m[k]) * 0.01, abs(o[k]) * 0.01) for k in both)
    return (round(alike / len(both), 5) if both else 0.0), len(both)


def formulas(rng, n, groups):
    for i in range(n):
        names = list("abcdefgh")[: rng.choice([0, 1, 3, 6, 8])]
        if rng.random() < 0.5 and len(names) > 1:
            at = rng.randrange(len(names) - 1)
            names[at : at + 2] = rng.choice([names[at : at + 2][::-1], ["z"], names[at : at + 2] * 2])
        nutrition = rng.choice([None, {}, {"p": 1.0, "q": 2.0}, {"p": 1.0, "q": 2.0, "r": rng.choice([5.0, 5.04, 9.0]), "s": 100.0 + rng.choice([0, 0.5, 40])}])
        yield rng.choice(groups), i * 3 % 101 + (1 << 60), None if rng.random() < 0.03 else names, nutrition


def test_first_in_batch_and_conflicts(spark):
    df = spark.createDataFrame([(5, "a", 1), (3, "b", 1), (9, "b", 2), (4, "c", 3), (7, None, 4), (8, None, 5)], "id long, t string, n int")
    assert sorted(values(similar.first_in_batch(df, "id", ["t"], ["n"]).select("id", "first"))) == [(3, 3), (4, 4), (5, 3), (7, 7), (8, 8), (9, 3)]
    points = spark.createDataFrame([(1, ["cat"], None), (2, ["dog"], [1]), (3, [], [2]), (4, ["cat", "dog"], [1])], "id long, s array<string>, l array<int>")
    pairs = spark.createDataFrame(list(itertools.combinations(range(1, 5), 2)), "a long, b long")
    assert sorted(values(similar.without_conflicts(pairs, points, "id", ["s", "l"]))) == [(1, 3), (1, 4), (2, 4)]


def test_ordered_clusters_against_plain_python(spark):
    schema = "g long, id long, names array<string>, nutrition map<string,double>, cluster string"
    rng = random.Random(11)
    for rule in ({}, {"least": 0.7, "top_least": 0.3, "metrics": 2, "nutrition_least": 0.5}):
        least, top_least, metrics, enough = ({"least": 0.96, "top_least": 0.8, "metrics": 4, "nutrition_least": 0.95} | rule).values()
        rows = list(formulas(rng, 100, [1, 1, 1, 2, None]))
        want, newest = set(), collections.defaultdict(list)
        for g, i, names, nutrition in sorted(rows, key=lambda r: r[1]):
            if g is None or names is None:
                continue

            def agree(x, m, y, o):
                (a, t), (n, c) = plain_ordered(x, y), plain_nutrition(m, o)
                return x == y or a >= least and t >= top_least and c >= metrics and n >= enough

            hits = [c for c in newest[g] if agree(names, nutrition, c[1], c[2])]
            if len(hits) == 1:
                hits[0][1:] = [names, nutrition]
            else:
                hits = [[i, names, nutrition]]
                newest[g].append(hits[0])
            want.add((g, i, hits[0][0]))
        df = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(5)
        assert {tuple(r) for r in values(similar.ordered_clusters(df, "g", "id", "names", "nutrition", **rule))} == want
    assert any(i != c for _, i, c in want)
    assert values(similar.ordered_clusters(df.limit(0), "g", "id", "names", "nutrition")) == []


def test_formula_matches_against_plain_python(spark):
    rng = random.Random(12)
    rows = [(i, names, nutrition) for _, i, names, nutrition in formulas(rng, 90, [1])]
    df = spark.createDataFrame(rows, "id long, names array<string>, nutrition map<string,double>")
    for least in (0.3, 0.4, 0.5, 0.7, 0.89, 0.9, 0.96):
        want = set()
        for (a, x, m), (b, y, o) in itertools.permutations(rows, 2):
            if x is None or y is None:
                continue
            (s, t), (n, c) = plain_ordered(x, y), plain_nutrition(m, o)
            if x == y or s >= least:
                want.add((a, b, x == y, s, n, round(s * 0.75 + n * 0.25, 5), (x == y or s >= 0.96 and t >= 0.8) and c >= 4 and n >= 0.95))
        got = {r[:2]: r[2:] for r in values(match.formula_matches(df, df, "id", "names", "nutrition", least))}
        assert len(got) == match.formula_matches(df, df, "id", "names", "nutrition", least).count()
        want = {r[:2]: r[2:] for r in want}
        assert got.keys() == want.keys()
        for k, (exact, *scores_, auto) in got.items():
            assert (exact, auto) == (want[k][0], want[k][-1])
            assert all(abs(x - y) < 2e-5 for x, y in zip(scores_, want[k][1:-1]))


def test_no_pair_needs_less_equal_weight_than_is_asked_for():
    rng = random.Random(21)
    weight = lambda x, y: sum(1 / (i + 1) for i in range(min(len(x), len(y))) if x[i] == y[i])
    for _ in range(4000):
        x = [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))]
        y = rng.choice([list(x), x[::-1], sorted(x), [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))]])
        for _ in range(rng.randrange(3)):
            y[rng.randrange(len(y))] = rng.choice("abcdefghij")
        score = plain_ordered(x, y)[0]
        if score >= 0.36:
            assert weight(x, y) >= match.equal_weight_needed((len(x), len(set(x))), [(len(y), len(set(y)))], score) - 1e-9
    assert match.equal_weight_needed((7, 7), [(7, 7)], 0.5) > 0.5


def test_popular_names_make_no_pairs_by_themselves(spark):
    """All lists share their third name; none is alike."""
    rows = [(i, [f"a{i}", f"b{i}", "common", f"c{i}", f"d{i}"]) for i in range(300)]
    one = spark.createDataFrame(rows, "a long, x array<string>")
    assert match.sharing_places(one, one.toDF("b", "y"), 0.5).where("a <> b").count() == 0


def test_sources_round_trip(spark, tmp_path):
    from millrace.sources import files

    (tmp_path / "a.csv").write_text("﻿id,title\n1,one\nx,bad\n2,two\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,title\n1,again\n3,three\n", encoding="utf-8")
    good, bad = files.read_posts(spark, str(tmp_path / "*.csv"), {"id": "long", "title": "string"}, "id")
    assert sorted(values(good.select("id", "title", "source_file"))) == [(1, "one", "a.csv"), (2, "two", "a.csv"), (3, "three", "b.csv")]
    assert bad.count() == 1
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{"items": [{"item_id": "7", "title": "t",\n "brand": "b"}, {"title": "none"}]}')
    (tmp_path / "j" / "2.json").write_text('{"items": [')
    assert values(files.read_items(spark, str(tmp_path / "j"), "b1").select("item_id", "batch")) == [("7", "b1")]


def plain_near(rows, threshold):
    def one(x, y):
        p, q = (collections.Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (x, y))
        return sum(v * q[k] for k, v in p.items()) / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))

    scored = {(*sorted((a, b)),): max(one(x, y), 0.9 * difflib.SequenceMatcher(None, *((x, y) if a < b else (y, x)), autojunk=False).ratio() if threshold <= 0.9 else 0) for (a, g, x), (b, h, y) in itertools.combinations(rows, 2) if g == h}
    return {(a, b, round(v, 6)) for (a, b), v in scored.items() if v >= threshold}


def test_near_texts_compares_all_pairs_of_a_bucket(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (38, 39, 79, 180, 700)]
    rows = [(0, "x", "ab" * 10), (1, "x", "ab" * 40)]  # nearly one direction, far from one length
    for i in range(2, 60):
        t = rng.choice(base)
        at = rng.randrange(len(t))
        rows.append((i, rng.choice("xxy"), t[:at] + rng.choice(["", "q", "qr", "a" * 25]) + t[at:]))
    df = spark.createDataFrame(rows, "id long, g string, t string")
    for threshold, tile in ((0.94, 7), (0.94, 2048), (0.7, 7)):
        got = {(a, b, round(v, 6)) for a, b, v in values(similar.near_texts_in_blocks(df, "id", "t", ["g"], threshold, tile))}
        assert got == plain_near(rows, threshold)
        assert {(a, b, round(v, 6)) for a, b, v in values(similar.near_texts(df, "id", "t", ["g"], threshold))} == got
    assert any(len(rows[a][2]) // 20 != len(rows[b][2]) // 20 for a, b, _ in plain_near(rows, 0.94))


@pytest.mark.parametrize("products", [0, 20, 1e9])
def test_near_texts_meets_few_pairs_that_are_not_near(spark, monkeypatch, products):
    """Texts over a large alphabet make far fewer candidates than pairs; either way loses none."""
    monkeypatch.setattr(similar, "PRODUCTS", products)
    rng = random.Random(6)
    words = ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = [(i, "x", " ".join(rng.choice(words) for _ in range(12))) for i in range(300)]
    rows += [(1000 + i, "x", t[:-1] + "é") for i, _, t in rows[:40]] + [(2000, "x", "a"), (2001, "x", "a"), (2002, "x", ""), (2003, "y", ""), (2004, "x", None), (2005, "x", "")]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    got = {(a, b, round(v, 6)) for a, b, v in values(similar.near_texts(df, "id", "t", ["g"], 0.94))}
    assert got == {(i, 1000 + i, round(v, 6)) for (i, j, v) in plain_near([r for r in rows if r[2] and len(r[2]) > 1], 0.94) if j == 1000 + i} | {(2000, 2001, 1.0), (2002, 2005, 1.0)}
    assert similar.candidates(similar.prefixes(df.where("t IS NOT NULL").select(F.col("id").alias("k"), F.col("t").alias("v"), "g"), ["g"], 0.94), ["g"], 0.94).count() < 5000  # of 58,653 pairs


def test_near_vectors_by_planes_recall(spark):
    """Recall against the exact block products is 0.9 or more at what the number of tables promises; no false pair."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    near = [b + rng.normal(size=32) * s * np.linalg.norm(b) / 32**0.5 for b in base for s in (0.2, 0.4, 0.55, 0.6)]
    rows = [(i, "xy"[i % 5 == 0], v.tolist()) for i, v in enumerate([*base, *near, *rng.normal(size=(200, 32))])] + [(9000, "x", None), (9001, "x", [0.0] * 32), (9002, "x", [1.0, None])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(3)
    exact = {(a, b): round(s, 9) for a, b, s in values(similar.near_vectors(df.where("id <> 9002"), "id", "v", ["g"], 0.85))}
    got = {(a, b): round(s, 9) for a, b, s in values(similar.near_vectors_by_planes(df, "id", "v", ["g"], 0.85))}
    assert len(exact) > 150 and got.items() <= exact.items() and len(got) >= 0.9 * len(exact)
    assert similar.tables_for(0.85, 0.95, 12) < 10 < similar.tables_for(0.7, 0.95, 12)


def test_near_lines_of_whole_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "source", "text").collect()
    least = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        for n, line in enumerate(d.text.split("\n")):
            if len(line) > 10:
                least.setdefault((d.lang, d.source, line), f"{d.doc_id}:{n}")
    rows = [(at, (g, h), line) for (g, h, line), at in least.items()]
    want = plain_near(rows, 0.94)
    assert any(not a.endswith(":0") for a, _, _ in want)
    assert {tuple(r) for r in plans.QUERIES["C6"](spark, DATA).select("a", "b", "similarity").collect()} == want


def test_best_candidates_of_all_parts(spark):
    def lifted(a, b, floor):
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        return max(ratio, floor) if a in b or b in a else ratio

    def plain(rows):
        out = set()
        for a, g, t, x in rows:
            scored = [(0.4 * lifted(t, u, 0.95) + 0.6 * lifted(x, y, 0.92), -b) for b, h, u, y in rows if g == h and a != b]
            if scored:
                best = max(scored)
                out.add((a, -best[1], round(best[0], 6)))
        return out

    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    rows = [(p.p_partkey, p.p_brand, p.p_type.lower(), p.p_name.lower()) for p in parts]
    assert {tuple(r) for r in plans.QUERIES["J9"](spark, DATA).select("a", "b", "score").collect()} == plain(rows)
    rng = random.Random(8)
    rows = [(i, rng.choice("ggggh"), rng.choice(["ab", "abc", "x"]), rng.choice(["one", "one two", "two", "tow", "three"])) for i in range(80)] + [(90, "alone", "ab", "one"), (-3, "g", "x", "three")]
    df = spark.createDataFrame(rows, "id long, g string, t string, x string")
    for tile in (512, 4):
        got = {(a, b, round(v, 6)) for a, b, v in values(match.best_candidates(df, "id", "g", "t", "x", tile).select("a", "b", "score"))}
        assert got == plain(rows)


def test_bounds_spare_most_ratios(monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = [(i, rng.choice(["acme", "apex"]), " ".join(rng.sample(words, 3))) for i in range(300)]
    rows += [(1000 + i, t, x[:-1] + "é") for i, t, x in rows[:60]] + [(5000, None, "a"), (5001, "acme", None), (5002, "", "")]
    asked = []
    real = match._ratio
    monkeypatch.setattr(match, "_ratio", lambda a, b: asked.append(1) or real(a, b))
    got = match.bounded_best(rows, rows, [None] * len(rows))
    few = len(asked)
    want = [max((0.4 * match._lifted(t, u, 0.95) + 0.6 * match._lifted(x, y, 0.92), -j) for j, u, y in rows if j != i) for i, t, x in rows]
    assert got == want
    assert few < len(rows) ** 2 / 4


def test_containing_pairs_in_both_directions(spark):
    rng = random.Random(2)
    texts = [("g", None), (None, "ab"), ("h", "")] + [(rng.choice("gh"), "".join(rng.choice("abé") for _ in range(rng.randrange(0, 9)))) for _ in range(120)]
    df = spark.createDataFrame(texts, "g string, t string")
    pairs = match.containing_pairs(df.select("g", F.col("t").alias("x")), df.select("g", F.col("t").alias("y")), ["g"])
    known = {x for x in texts if None not in x}
    assert sorted(map(tuple, pairs.collect())) == sorted((g, x, y) for g, x in known for h, y in known if g == h and y in x)
    assert match.containing_pairs(df.select(F.col("t").alias("x")), df.select(F.col("t").alias("y")).where(F.lit(False)), []).count() == 0


def test_best_in_block_with_popular_tokens(spark):
    """Every name shares a token; the best come from rarer ones, containment and small keys."""
    rng = random.Random(11)
    words = ["common", "frequent", "odd", "queer", "rare", "seldom", "x", "yz"]
    name = lambda: " ".join(["common"] + rng.sample(words, rng.randrange(0, 4)))
    products = [(i, rng.choice("aab"), name()) for i in range(90)]
    items = [(i, g, rng.choice(["", "new "]) + n) for i, g, n in products[:60]] + [(500, "a", "zzz"), (501, "b", "uncommonly"), (502, "a", None)]
    got = match.best_in_block(spark.createDataFrame(items, "item long, g string, title string"), spark.createDataFrame(products, "p long, g string, n string"), "g", "item", "title", "p", "n")
    want = []
    for i, g, x in items:
        found = []
        for p, h, y in products:
            if x is not None and g == h and p != i:
                score = min(len(x), len(y)) if x in y or y in x else sum(map(len, set(x.split()) & set(y.split())))
                found += [(score, -p)] if score >= 4 else []
        if found:
            want.append((i, -max(found)[1], max(found)[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want)



def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mention_spans_against_plain_python(spark):
    rng = random.Random(8)
    words = ["sore", "sores", "no ", "well", "bad", "since", "after", "xx", " ", "old sore "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, ""]
    outcomes, onsets = {"good": "well", "ill": "bad"}, {"before": "since|old", "after": "after"}
    spans = rules.mention_spans(["sore", "sores", "old sore"], outcomes, ["no "], window=12, onsets=onsets)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.id, *r.m) for r in df.select("id", F.explode(spans("t")).alias("m")).collect()}

    def near(text, patterns, a, b):
        best = None
        for name in sorted(patterns):
            for part in patterns[name].split("|"):
                for x in range(len(text)):
                    y = x + len(part)
                    if text[x:y] == part and (x >= b or y <= a):
                        gap = x - b if x >= b else a - y
                        if gap <= 12 and (best is None or gap < best[0]):
                            best = (gap, name)
        return best and best[1]

    want = set()
    for i, text in enumerate(texts):
        free = [True] * len(text or "")
        for w in ("old sore", "sores", "sore"):
            for a in range(len(text or "")):
                b = a + len(w)
                if text[a:b] == w and all(free[a:b]):
                    free[a:b] = [False] * len(w)
                    want.add((i, w, a, b, "no " in text[max(0, a - 6) : a], near(text, outcomes, a, b), near(text, onsets, a, b)))
    assert got == want and len(want) > 200


def test_choice_verdict(spark):
    rows = [(["need"], 3, False, False), (["need", "number"], 5, False, False), (["number"], 2, False, False), (["need", "switch"], 5, False, True), ([], 0, True, False), (["switch"], 2, False, False), (["number"], 6, False, False)]
    df = spark.createDataFrame(rows, "n array<string>, s int, c boolean, w boolean")
    keep, intents = rules.choice_verdict(F.col("n"), F.col("s"), {"need": "Need", "switch": "Switch"}, ["need", "number"], ["number"], F.col("c"), F.col("w"))
    got = [tuple(r) for r in df.select(keep.alias("k"), intents.alias("i")).collect()]
    assert got == [(False, ["Need"]), (True, ["Need"]), (False, ["Decision"]), (False, ["Need", "Switch"]), (True, ["Need"]), (False, ["Switch"]), (True, ["Decision"])]


def test_rates_levels_and_directions(spark):
    from millrace.functions import scores
    from millrace.operators import stats

    df = spark.createDataFrame([(0.3, 1.7, "very high", "aa bb"), (None, None, "none", "zz"), (None, None, None, None)], "p double, x double, l string, t string")
    by_level = scores.level_rate(F.col("l"), [("very high", 0.85), ("high", 0.65)])
    rate = scores.derived_rate(F.col("p"), F.col("x") / 10, by_level, scores.hit_rate(F.col("t"), ["aa", "bb"], 0.2))
    assert [r[0] for r in df.select(rate).collect()] == [0.85, 0.0, 0.0]
    v = spark.createDataFrame([(None,), (0.0,), (0.3,), (0.6,), (0.7,), (1.0,)], "v double")
    assert [r[0] for r in v.select(scores.burden_level(F.col("v"), 1)).collect()] == ["missing", "low", "low", "medium_low", "elevated", "high"]
    assert [r[0] for r in v.select(scores.support_level(F.col("v"), 1)).collect()] == ["missing", "low", "medium_low", "medium_high", "medium_high", "high"]
    m = spark.createDataFrame([("u", "a", True), ("u", "b", False), ("w", "b", True)], "k string, m string, c boolean")
    got = stats.direction_states(m, ["k"], "m", F.col("c"), {"d": (["a"], ["a", "b"]), "e": (["x"], ["b"])})
    assert sorted(tuple(r) for r in got.select("k", "direction", "state", "evidence", "missing").collect()) == [
        ("u", "d", "abnormal", ["a"], []), ("u", "e", "normal", [], []), ("w", "d", "insufficient", [], ["a"]), ("w", "e", "normal", [], [])]


def test_label_texts_with_headers_and_stops():
    def split(text):
        return parse.split_nested(text, ("x",), {}, headers=("products",), exact=("fish", "prawn"), prefixes=("live", "ad "))

    assert split("Fish 5%(tuna, Prawn (red 2%, blue))。oil") == ["tuna", "red", "blue", "oil"]
    assert split("Meat products 8%, meat products, Fish, x, fishy (tuna)") == ["meat products", "fish", "fishy"]
    assert split("LIVE: beef; ad plum；live") == ["beef", "plum"]
    assert split(None) == split("。，") == []


def test_first_line_of_an_id_wins(spark, tmp_path):
    """Lines of one id stand against their content's order, inside a file, over files, and beside quoted line ends."""
    from millrace.sources import files

    (tmp_path / "b.csv").write_text("id,title\n7,a\n8,b\n")
    (tmp_path / "a.csv").write_text("﻿id,title\n7,z\n9,\"two\nlines\"\n7,a\nx1,bad\n9,a\n" + "".join(f"{i},{'zy'[i < 1000]}\n" for i in (*range(100, 2000), *range(100, 999))))
    posts, errors = files.read_posts(spark, str(tmp_path / "*.csv"), {"id": "long", "title": "string"}, "id")
    got = {r["id"]: (r["title"], r["source_file"]) for r in posts.collect()}
    assert posts.columns == ["id", "title", "source_file"] and errors.count() == 1
    assert got[7] == ("z", "a.csv") and got[8] == ("b", "b.csv") and got[9] == ("two\nlines", "a.csv")
    assert len(got) == 3 + 1900 and got[100][0] == "y" and got[1500][0] == "z"


def test_assembled_sources(spark):
    rows = [(1, "cat", ["a", "a", "unspecified"], "f", " t ", True), (2, "cat", ["a"], "f", "t", True), (3, "", ["a"], "f", "t", True), (4, None, ["a"], "f", "t", True), (5, "cat", [], "f", "t", True), (6, "cat", None, "f", "t", True), (7, "cat", ["a"], None, "t", True), (8, "cat", ["a"], "f", None, True), (9, "cat", ["a"], "f", "t", None), (2, "cat", ["a"], "f", "t", True)]
    df = spark.createDataFrame(rows, "id int, k string, stages array<string>, f string, content string, ok boolean")
    entries, links, out = stats.assembled_sources(df, ["k"], "id", F.col("ok"), "stages", F.col("f"), "content")
    assert sorted(tuple(r) for r in entries.select("k", "stage", "field", "content", "sources").collect()) == [("cat", "a", "f", "", 1), ("cat", "a", "f", " t ", 2), ("cat", "all_stages", "f", " t ", 1)]
    assert sorted((r["stage"], r["id"]) for r in links.collect()) == [("a", 1), ("a", 2), ("a", 8), ("all_stages", 1)]
    assert sorted(tuple(r) for r in out.collect()) == [(3, "pending"), (4, "pending"), (5, "pending"), (6, "pending"), (7, "unassigned"), (9, "pending")]
    empty = stats.assembled_sources(df.limit(0), ["k"], "id", F.col("ok"), "stages", F.col("f"), "content")
    assert [f.count() for f in empty] == [0, 0, 0]


def test_text_check_and_derived_features(spark):
    from millrace.functions import scores, text

    rows = [(0.5, 0.0, 3, False), (0.6, 0.9, 1, False), (0.6, 0.0, 2, False), (0.6, 0.0, 0, True), (0.8, 0.36, 3, False), (0.8, 0.35, 1, None), (0.8, 0.35, 2, None)]
    df = spark.createDataFrame(rows, "e double, r double, h int, s boolean")
    assert [r[0] for r in df.select(text.text_check(F.col("e"), F.col("r"), F.col("h"), F.col("s"))).collect()] == ["characters", "characters and evidence", "accept", "accept", "repetition", "evidence", "accept"]
    df = spark.createDataFrame([(80.0, 30.0), (20.0, 50.0), (None, 50.0), (50.0, None)], "q double, s double")
    got = scores.derived_features(df, {"p": ["none", "q", "s"]}, {"m": [("p", 1.0), ("s", 3.0), ("none", 5.0)]}, {"x": ("q", "s")})
    assert [tuple(r) for r in got.select("p", "m", "x").collect()] == [(80.0, 42.5, 40.0), (20.0, 42.5, 0.0), (50.0, 50.0, None), (50.0, 50.0, None)]
