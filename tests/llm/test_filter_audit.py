"""The filter audit against counting by hand, and its edge cases."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import filter_audit

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_failures(rows):
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = SPACE.findall(t)
        bits = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
        bits += 8 * any(c in "#$%&*|" for c in t) + 16 * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        out.append(bits)
    return out


def brute_audit(rows, labels):
    fails = ["".join(f for k, f in enumerate("ABCDE") if b >> k & 1) for b in brute_failures(rows)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        report = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                failing = [x for x in mine if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed[f] += len(gone)
                report.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(x[1] == f for x in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
        out += [(*r[:-1], removed[r[-1]]) for r in report]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(0, None, "a"), (1, "", None), (1, "", ""), (None, "", "a"), (2, " \n\t ", "a"), (3, "É" * 50, "b"), (3, "É" * 50, "b"), (2**60 + 1, "É" * 50, "b"), (2**60 + 2, "x", "b"), (4, "lone\x1fword " * 300, "b"), (5, "UPPER " * 90_000, "c")]
    for i in range(10, 120):
        words = [rng.choice(["word", "Other", "thing", "n"]) + str(rng.randrange(rng.choice([3, 500]))) for _ in range(rng.choice([5, 199, 200, 260]))]
        out.append((i, " ".join(words) + rng.choice(["", "", " #", "|"]), rng.choice(["a", "a", "b", None])))
    out += [(i + 200, out[rng.randrange(11, 110)][1], "c") for i in range(40)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", 1) for i, t, s in rows], "doc_id long, text string, source string, id string, part string, shard string, digest string, failed int")


@pytest.mark.parametrize("shard_bytes", [4 << 20, 1500])
def test_failures_and_audit(spark, rows, shard_bytes, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(filter_audit, "BUCKET_WORDS", 100)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 200, 3)] + [(12, 1, 1), (12, 0, 0), (None, 1, 1)]
    failed = filter_audit.failures(frame(spark, rows)).cache()
    assert sorted((str(r["id"]), r["failed"]) for r in failed.collect()) == sorted((str(r[0]), b) for r, b in zip(rows, brute_failures(rows)))
    report = filter_audit.audit(failed, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, report.select(names).collect())) == sorted(brute_audit(rows, labels))


@pytest.mark.parametrize("buckets", [1, 7])
def test_matrix_is_the_document_term_matrix(spark, rows, monkeypatch, buckets):
    import numpy as np

    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 3000)
    shards = filter_audit.local_shards(frame(spark, rows)).cache()
    assert abs(filter_audit.distinct_words(shards) / len({w for _, t, _ in rows for w in SPACE.findall(t or "")}) - 1) < 0.2
    numbers = filter_audit.term_numbers(shards, buckets).cache()
    terms = filter_audit.dictionary(numbers, buckets).collect()
    known = {r["term"]: r["word"] for r in terms}
    assert len(known) == len(terms) == len(set(known.values()))
    got = []
    matrix = filter_audit.term_matrix(shards, numbers, buckets).cache()
    assert sorted(map(str, filter_audit.row_statistics(matrix).collect())) == sorted(map(str, filter_audit.term_matrix(shards, numbers, buckets, statistics=True).collect()))
    for r in matrix.collect():
        at, cols, n = np.frombuffer(r["indptr"], np.int64), np.frombuffer(r["indices"], r["width"]), np.frombuffer(r["counts"], r["size"])
        for k, i in enumerate(r["ids"]):
            assert (np.diff(cols[at[k] : at[k + 1]].astype(np.int64)) > 0).all()
            got.append((str(i), sorted((known[int(c)], int(x)) for c, x in zip(cols[at[k] : at[k + 1]], n[at[k] : at[k + 1]]))))
    want = []
    for i, t, _ in rows:
        words = SPACE.findall(t or "")
        want.append((str(i), sorted((w, words.count(w)) for w in set(words))))
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    empty = frame(spark, [(1, "x", "a")]).where(F.lit(False))
    assert filter_audit.audit(filter_audit.failures(empty), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
