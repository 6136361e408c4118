"""Searches that return all pairs: tile by tile, against plain Python and SQL."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.operators import similar

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def by_hand(targets, vectors):
    """Weighted Jaccard as SQL has it: sums and least() pass over nulls."""

    def summed(rows):
        out = {}
        for e, k, w in rows:
            if e is not None and k is not None:
                out.setdefault(e, {}).setdefault(k, []).extend([] if w is None else [w])
        return {e: {k: sum(w) if w else None for k, w in v.items()} for e, v in out.items()}

    a, b, found = summed(targets), summed(vectors), {}
    total = lambda v: sum(w for w in v.values() if w is not None)
    for x, u in a.items():
        for y, v in b.items():
            if x != y and (both := u.keys() & v.keys()):
                low = [min(w for w in (u[k], v[k]) if w is not None) for k in both if u[k] is not None or v[k] is not None]
                found[x, y] = sum(low) / (total(u) + total(v) - sum(low)) if low else None
    return found


@pytest.mark.parametrize("odd", [False, True])
def test_weighted_jaccard_of_all_pairs(spark, monkeypatch, odd):
    monkeypatch.setattr(similar, "TILE", 24)
    draw = random.Random(3)
    rows = [(f"e{e}", draw.randint(0, 30), draw.choice([1.0, 2.5, 0.25])) for e in range(200) for _ in range(draw.randint(1, 5))]
    if odd:
        rows += [("e3", 4, None), ("n", 99, None), ("m", 99, None), ("z", 7, 0.0), ("y", 7, 0.0), ("x", 7, 3.0), (None, 7, 1.0), ("x", None, 1.0)]
        rows = [r for r in rows if r[0] != "y"] + [("y", 7, 0.0), ("y", 8, 1.0)]
    others = rows[:150] + [("f", 4, 2.0), ("far", 1000, 1.0)]
    for targets, vectors in ((rows, rows), (rows, others)):
        v = spark.createDataFrame(vectors, "e string, k int, w double")
        t = v if targets is vectors else spark.createDataFrame(targets, "e string, k int, w double")
        got = [tuple(r) for r in similar.weighted_jaccard(t, v, "e", "k", "w", lines=10).collect()]
        expected = by_hand(targets, vectors)
        assert len(got) == len(expected) and {(a, b) for a, b, _ in got} == expected.keys()
        for a, b, s in got:
            assert (s is None) == (expected[a, b] is None) and (s is None or math.isclose(s, expected[a, b], abs_tol=1e-12))


def test_pairs_never_meet_as_joined_rows(spark):
    """60 entities that share 40 keys are 3,540 pairs: no join and no shuffle holds a row per pair and key, or per pair."""
    v = spark.range(60).selectExpr("id AS e", "explode(sequence(1, 40)) AS k", "1.0D + id % 7 AS w")
    df = similar.weighted_jaccard(v, v, "e", "k", "w", digits=6)
    assert df.count() == 60 * 59
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Join")  # the pairs come after the last join


def test_lines_without_a_part_count_in_totals(spark, tmp_path):
    for name in ("part", "lineitem"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        if name == "lineitem":
            df = df.withColumn("l_partkey", F.when(F.col("l_linenumber") == 2, -5).when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_partkey")))
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {(r.target, r.other): round(r.similarity, 6) for r in plans.QUERIES["C1"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): round(s, 6) for a, b, s in con.sql(f"SELECT target, other, similarity FROM ({plans.ORACLES['C1']})").fetchall()}


def test_numeric_pairs_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 16)
    draw = random.Random(9)
    rows = [(n, draw.choice([0, 1, 2, 3, None]), draw.choice([None, 0.25, 0.5, draw.random()]), draw.choice([None, draw.random()])) for n in range(120)]
    df = similar.numeric_pairs(spark.createDataFrame(rows, "e int, g int, x double, y double"), "e", "g", {"x": 2.0, "y": 1.0}, digits=6)
    expected = {}
    for a, g, *u in rows:
        for b, h, *v in rows:
            if g is not None and h is not None and g != h:
                some = [(abs((p or 0) - (q or 0)) * w, w) for p, q, w in zip(u, v, (2.0, 1.0)) if p is not None or q is not None]
                expected[a, b] = (h, 1 - sum(s for s, _ in some) / sum(w for _, w in some) if some else None)
    got = df.collect()
    assert len(got) == len(expected)
    for r in got:
        g, s = expected[r.target, r.other]
        assert r.g == g and (r.numeric is None) == (s is None) and (s is None or abs(r.numeric - s) <= 5.1e-7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # these deal nothing out: a table of one file is one task


def test_round_half_up_as_the_sql(spark):
    some = [0.1234565, 0.5, -0.1234565, 0.9999995, 1e-9, -1e-9, 0.0, 0.3333333333, None]
    got = [r[0] for r in spark.createDataFrame([(n, x) for n, x in enumerate(some)], "n int, x double").select("n", "x").orderBy("n").select(similar.round_half_up(F.col("x"), 6)).collect()]
    assert got == [r[0] for r in duckdb.sql("SELECT round(x, 6) FROM (VALUES " + ", ".join(f"({n}, {'NULL' if x is None else repr(x)}::DOUBLE)" for n, x in enumerate(some)) + ") t(n, x) ORDER BY n").fetchall()]


def test_pair_jaccard_sends_vectors_as_rows(spark):
    """Against plain Python, with nulls, zero weights, unknown entities and copies; joins hold pairs and entities, no keys."""
    draw = random.Random(12)
    rows = [(e, draw.randint(0, 12), draw.choice([1.0, 2.0, 0.5])) for e in range(40) for _ in range(draw.randint(1, 6))]
    rows += [(e + 100, k, w) for e, k, w in rows if e < 20] + [(30, None, 2.0), (31, 3, None), (32, 5, 0.0), (50, 1, None), (51, None, 1.0)]
    pairs = [(draw.randint(0, 119), draw.randint(0, 119), "x") for _ in range(600)] + [(50, 50, "x"), (51, 0, "x"), (51, 51, "x"), (999, 1, "x")]
    df = similar.pair_jaccard(spark.createDataFrame(pairs, "target int, other int, note string"), spark.createDataFrame(rows, "e int, k int, w double"), "e", "k", "w")
    keys, total = {}, {}
    for e, k, w in rows:
        total[e] = total.get(e, 0) + (w or 0)
        keys.setdefault(e, {})
        if k is not None:
            keys[e].setdefault(k, []).extend([] if w is None else [w])
    expected = []
    for a, b, note in pairs:
        if a in keys and b in keys:
            low = sum(min([sum(x) for x in (keys[a][k], keys[b][k]) if x], default=0) for k in keys[a].keys() & keys[b].keys())
            expected.append((a, b, note, round(low / (total[a] + total[b] - low), 9) if low > 0 else 0.0))
    assert df.columns == ["target", "other", "note", "similarity"]
    assert sorted((*r[:3], round(r[3], 9)) for r in df.collect()) == sorted(expected)


def test_pair_jaccard_rows_do_not_grow_with_keys(spark):
    from test_operators import joined_rows

    rows = spark.range(30).selectExpr("id AS e", "explode(sequence(1, 200)) AS k", "1.0D + id % 4 AS w")
    pairs = spark.range(30).selectExpr("id AS target").crossJoin(spark.range(30).selectExpr("id AS other"))
    df = similar.pair_jaccard(pairs, rows, "e", "k", "w")
    assert len(df.collect()) == 900
    assert max(joined_rows(df)) <= 900


def test_explained_pairs_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def found(x):
        seen.add(1)
        return x

    pairs = spark.range(20).select(found("id").alias("target"), (F.col("id") + 1).cast("int").alias("other"))
    vectors = spark.range(21).selectExpr("CAST(id AS int) AS e", "explode(array('p', 'q')) AS k", "0.5D AS w")
    shared, different = similar.explain_pairs(pairs, vectors, "e", "k", "w", 1)
    assert shared.count() == 20 and different.count() == 0
    assert seen.value == 20


def test_formula_candidates_go_without_nutrition(spark):
    """Nutrition is joined to the pairs that are left, above the union of both kinds, not to every candidate."""
    from millrace.operators import match

    rows = [(n, ["p", "q", f"r{n % 3}"] if n < 8 else [], {"fat": 1.0 * n}) for n in range(10)] + [(10, None, {"fat": 1.0}), (11, ["p", None], None), (12, ["p", None], {"fat": 1.0})]
    lists = spark.createDataFrame(rows, "k int, names array<string>, nutrition map<string,double>")
    df = match.formula_matches(lists.where("k % 2 = 0"), lists.where("k % 2 = 1"), "k", "names", "nutrition", least=0.5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Union")
    got = {(r.a, r.b): (r.exact, r.nutrition) for r in df.collect()}
    x = {k: n for k, n, _ in rows}
    assert got.keys() == {(a, b) for a in (0, 2, 4, 6, 12) for b in (1, 3, 5, 7, 11)} | {(8, 9)}
    assert all(exact == (x[a] == x[b]) for (a, b), (exact, _) in got.items())
    assert got[0, 3] == (True, 0.0) and got[12, 11] == (True, 0.0)


@pytest.mark.parametrize("products, kept", [(10**9, 0), (0, 40)])
def test_prefixes_are_kept_where_they_are_used_only(spark, monkeypatch, products, kept):
    """Those of a dense bucket are counted, never written: its pairs come from block products."""
    monkeypatch.setattr(similar, "PRODUCTS", products)
    asked, plain = [], similar.prefixes
    monkeypatch.setattr(similar, "prefixes", lambda named, *more: asked.append(named) or plain(named, *more))
    rows = spark.range(40).selectExpr("id AS k", "concat('the same long line of text, number ', id % 20) AS t", "'g' AS g")
    found = {(r.a, r.b) for r in similar.near_texts(rows, "k", "t", ["g"]).collect()}
    assert {(a, a + 20) for a in range(20)} <= found
    assert [d.count() for d in asked] == [40, kept]
