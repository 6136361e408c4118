"""SimHash fingerprints and the trie self-join against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def components(values, budget):
    """The smallest index that each value reaches."""
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def near_values(rng, n):
    """Random values, chains of near ones, a dense cluster, and many of one long prefix."""
    out = {0, 1, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        v = rng.choice(sorted(out)) if rng.random() < 0.5 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 1, 2, 3])):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    hub = 0xABCDEF << 40
    return sorted(out | {hub | rng.getrandbits(12) for _ in range(n // 2)} | {hub ^ (1 << i) for i in range(64)})


@pytest.mark.parametrize("direct, frontier", [(16, 1 << 20), (1, 40)])
def test_walk(monkeypatch, direct, frontier):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = random.Random(3)
    for budget in (0, 1, 2, 3):
        values = near_values(rng, 120)
        x = np.array(values, np.uint64)
        a, b = simhash.walk(x, None, 0, 0, budget)
        place = {v: i for i, v in enumerate(values)}
        up = list(range(len(values)))
        for p, q in zip(a.tolist(), b.tolist()):
            up[place[p]] = place[q]
        assert len(a) <= len(values) and all((values[i] ^ values[j]).bit_count() <= 64 for i, j in enumerate(up))
        assert [up[up[i]] for i in range(len(values))] == components(values, budget)


@pytest.mark.parametrize("leaf, budget", [(16_384, 2), (12, 2), (3, 3), (1, 1)])
def test_links_hold_components_together(spark, leaf, budget):
    values = near_values(random.Random(leaf), 150)
    frame = spark.createDataFrame([(signed(v),) for v in values], "f long")
    placed = simhash.leaves(frame, leaf).collect()
    assert max(np.unique([(r["depth"], (r["f"] % (1 << 64)) >> (64 - r["depth"])) for r in placed], axis=0, return_counts=True)[1]) <= leaf
    place = {signed(v): i for i, v in enumerate(values)}
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in simhash.links(frame, budget, leaf).collect():
        i, j = top(place[a]), top(place[b])
        up[max(i, j)] = min(i, j)
    assert [top(i) for i in range(len(values))] == components(values, budget)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 50)
    rng = random.Random(8)
    words = lambda n: [rng.choice(["Ab", "cd", "Éé", "x"]) + str(rng.randrange(60)) for _ in range(n)]
    rows = [(5, None), (3, ""), (9, " \n\t"), (None, ""), (7, "one"), (8, "ONE"), (10, "one two"), (11, "one\ttwo"), (12, "a b c"), (None, "a b c"), (None, "lonely text of a null id"), (13, "É b c"), (13, "É b c"), (14, "é b c")]
    for i in range(20, 60):
        base = words(rng.choice([3, 4, 5, 30, 200]))
        for k in range(3):
            copy = list(base)
            if k:
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((i + 100 * k, " ".join(copy)))
    rows.append((999, " ".join(words(30_000))))
    frame = spark.createDataFrame([(i, t, "x", "x", "x", 1) for i, t in rows], "doc_id long, text string, id string, f string, least string, depth int")
    prints = [brute_fingerprint(t) for _, t in rows]
    comp = components(prints, 2)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = [(str(r[0]), signed(f), least[c]) for r, f, c in zip(rows, prints, comp)]
    got = [(str(r["id"]), r["f"], r["component_id"]) for r in simhash.similar_fingerprints(frame, leaf=4).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert simhash.similar_fingerprints(spark.createDataFrame([(1, "x")], "doc_id long, text string").where(F.lit(False))).count() == 0
