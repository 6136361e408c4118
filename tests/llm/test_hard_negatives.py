"""Hard negatives against brute force, and their edge cases."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, key string, part string, q string"


def rows_of(seed, n, dims, hot):
    """Vectors with ties, a popular vector, popular labels, negative and odd components, null ids, repeated rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.choice([-0.5, -0.25, 0.0, 0.004, 0.25, 0.5, rng.gauss(0, 0.3)]) for _ in range(dims)]
        if rng.random() < hot:
            v = [0.25] * dims
        out.append((i if rng.random() < 0.97 else None, v, rng.choice([0, 0, 0, 1, 2, 9])))
    out += [(50, [0.5] * dims, 0), (50, [0.5] * dims, 0), (100, [0.1] * (dims - 2), 1), (7001, None, 1), (7002, [0.1] * dims, None), (7003, [float("nan")] * dims, 1), (7004, [0.1, None], 1), (7005, [float("inf")] * dims, 2), (150, [], 3)]
    rng.shuffle(out)
    return out


def brute(rows, positives=5, negatives=3):
    live = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            live.append((k, i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for k, i, label, q in live:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, r)), j, other == label) for n, j, other, r in live if n != k]
        for s, j, _ in sorted((c for c in scored if c[2]), key=order)[:positives]:
            fits = [c for c in scored if not c[2] and 50 * s <= 100 * c[0] <= 95 * s]
            out += [(i, j, n, c[1], s, c[0]) for n, c in enumerate(sorted(fits, key=order)[:negatives], 1)]
    return out


@pytest.mark.parametrize("seed, part, leaf, page, block, hits", [(1, 1024, 64, 1024, 8192, 1 << 20), (2, 40, 4, 3, 4, 1 << 20), (3, 25, 1, 2, 3, 10)])
def test_against_brute_force(spark, monkeypatch, seed, part, leaf, page, block, hits):
    for name, value in zip(("PART", "LEAF", "PAGE", "BLOCK", "HITS"), (part, leaf, page, block, hits)):
        monkeypatch.setattr(H, name, value)
    rows = rows_of(seed, 260, 6, 0.3)
    frame = spark.createDataFrame([(i, v, x, "x", "x", "x") for i, v, x in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.hard_negatives(H.quantised(frame, F.col("vec_id"), label, F.col("embedding")), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_boxes_bound_every_product():
    rng = np.random.default_rng(4)
    m = np.floor(rng.normal(0, 60, (500, 12)))
    q = np.floor(rng.normal(0, 60, (40, 12)))
    tree = H.Tree(m, rng.integers(0, 3, 500))
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
    least, most = H._bounds(q, tree.lo, tree.hi)
    for n, leaf in enumerate(tree.leaves):
        s = q @ m[leaf].T
        assert (s.min(1) >= least[:, tree.inner + n]).all() and (s.max(1) <= most[:, tree.inner + n]).all()


def test_boxes_are_pruned(monkeypatch):
    """Clusters far apart: a query opens the leaves of its own cluster only."""
    centres = np.array([[900.0, 0], [0, 900], [-900, 0], [0, -900]])
    m = np.concatenate([c + np.arange(64)[:, None] % 8 for c in centres])
    rows = pd.DataFrame({"key": np.arange(256), "id": np.arange(256), "no_id": False, "label": 0, "q": list(m)})
    asks = pd.DataFrame({"aid": [3], "label": [0], "q": [m[3]], "lows": [np.array([-np.inf])], "highs": [np.array([np.inf])], "kth": [np.zeros(0)]})
    opened = []
    real = H.Tree

    class Watched(real):
        def __init__(self, *args):
            super().__init__(*args)
            self.leaves = type("Leaves", (list,), {"__getitem__": lambda s, i: opened.append(i) or list.__getitem__(s, i)})(self.leaves)

    monkeypatch.setattr(H, "Tree", Watched)
    assert len(H.search_part(rows, asks, 5, True)) == 5 and len(opened) < 4


def test_empty_table(spark):
    rows = H.quantised(spark.createDataFrame([], SCHEMA), F.col("vec_id"), F.col("label"), F.col("embedding"))
    assert H.hard_negatives(rows, F.col("id") % 50 == 0).count() == 0
