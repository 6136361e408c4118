"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, linked where few bits differ by a self-join of the
binary trie of all distinct fingerprints.

The trie's upper part is cut into leaves of bounded size: a node with too many fingerprints is split below their common
prefix, by as many bits as its size asks for, until none is too large; a hot prefix so only goes deeper. Pairs of nodes are
then walked together from the pair (root, root): each step takes both sides to their children, adds the bits in which
these differ and drops pairs over the budget. A pair of leaves that is left is one row, with both sides' fingerprints as
two sorted arrays, and its walk goes on inside a task, where a subtree is a range of a sorted array; ranges of few
fingerprints are compared directly. A task passes on only links that join something, at most one for each fingerprint,
so a dense cluster's many links don't leave it; a last step gives the components of all links.

Edge cases: a null, empty or wordless text has the fingerprint zero and is linked like any other; fewer words than the
width are one shingle; texts of any length are hashed whole, in blocks of words; repeated rows share a fingerprint and a
component; rows with a null id are linked like others but never name a component that has an id; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read
from .near_duplicates import components

LEAF = 16_384  # fingerprints of a leaf at most
DIRECT = 16  # pairs of two ranges that are compared directly
FRONTIER = 1 << 20  # pairs of ranges held at once, about
_BLOCK = 1 << 16  # words hashed at once
_SIGN = np.uint64(1 << 63)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is set if it is set in over half of the hashes (XXH64, seed 42) of the text's word shingles, A-Z lower-cased,
    repeats included; as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    width = min(width, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for low in range(0, n, _BLOCK):
        block = words[low : low + _BLOCK + width - 1]
        joined = b" ".join(block)
        size = np.fromiter(map(len, block), np.int64, len(block))
        end = np.cumsum(size + 1) - 1
        m = len(block) - width + 1
        shingles = [joined[s:e] for s, e in zip((end - size)[:m].tolist(), end[width - 1 :].tolist())]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, m)
        for a in range(0, m, 4096):
            ones += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, f`` of every row."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), hashed(F.col(text_col)).alias("f"))


def _prefix(f: Column, depth: Column) -> Column:
    """The first ``depth`` bits of f."""
    return F.when(depth > 0, F.call_function("shiftrightunsigned", f, (64 - depth).cast("int"))).otherwise(F.lit(0).cast("long"))


def leaves(values: DataFrame, leaf: int) -> DataFrame:
    """``f, depth``: each distinct fingerprint with the depth of its leaf of the trie. Leaves hold ``leaf`` fingerprints at
    most; the depth of a larger node moves below its fingerprints' common prefix by as many bits as its size asks for."""
    placed = cut(values.select("f", F.lit(0).alias("depth")))
    while True:
        at = placed.withColumn("prefix", _prefix(F.col("f"), F.col("depth")))
        big = at.groupBy("depth", "prefix").agg(F.count("*").alias("n"), F.bit_and("f").alias("all"), F.bit_or("f").alias("any")).where(F.col("n") > leaf)
        apart = F.col("all").bitwiseXOR(F.col("any"))  # bits that aren't the same in all
        common = F.when(apart < 0, 0).otherwise(63 - F.floor(F.log2(apart.cast("double"))).cast("int"))  # a bit short at worst, where rounding lifts the logarithm
        more = F.ceil(F.log2(F.col("n") / leaf)).cast("int")
        big = cut(big.select("depth", "prefix", F.least(F.lit(64), F.greatest(F.col("depth") + 1, common + more)).alias("deeper")))
        if big.isEmpty():
            return placed
        placed = cut(at.join(big, ["depth", "prefix"], "left").select("f", F.coalesce("deeper", "depth").alias("depth")))


def leaf_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """``ud, up, vd, vp, diff``: pairs of leaves (``depth, prefix``), each once, whose known bits differ in ``diff`` places,
    ``budget`` at most. Pairs of nodes are taken down together, from one depth that occurs to the next."""
    depths = sorted(r[0] for r in nodes.select("depth").distinct().collect())  # at most 65
    zero = F.lit(0).cast("long")
    pairs = nodes.sparkSession.range(1).select(*[F.lit(0).alias(c) if c != "up" and c != "vp" else zero.alias(c) for c in ("ud", "up", "vd", "vp", "diff")])
    if not depths:
        return pairs.where(F.lit(False))
    before = 0
    for depth in [d for d in depths if d > 0]:
        # the children of a node of the depth before; a leaf is its own child, of whose further bits nothing is known
        low = nodes.select(F.least("depth", F.lit(before)).alias("d"), F.least("depth", F.lit(depth)).alias("cd"), "depth", "prefix")
        up = lambda c: F.call_function("shiftrightunsigned", F.col("prefix"), (F.col("depth") - F.col(c)).cast("int"))
        step = low.select("d", F.when(F.col("d") > 0, up("d")).otherwise(zero).alias("p"), "cd", up("cd").alias("cp")).distinct()
        last = F.col("cp").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cd") - F.col("d")).cast("int")) - 1)
        step = cut(step.withColumn("bits", F.when(F.col("cd") > F.col("d"), last)))
        side = lambda s: step.select(F.col("d").alias(f"{s}d"), F.col("p").alias(f"{s}p"), F.col("cd").alias(f"{s}cd"), F.col("cp").alias(f"{s}cp"), F.col("bits").alias(f"{s}b"))
        down = pairs.join(side("u"), ["ud", "up"]).join(side("v"), ["vd", "vp"])
        # differing bits are known where both sides went down
        down = down.withColumn("diff", (F.col("diff") + F.coalesce(F.bit_count(F.col("ub").bitwiseXOR(F.col("vb"))), F.lit(0))).cast("int")).where(F.col("diff") <= budget)
        once = (F.col("ud") != F.col("vd")) | (F.col("up") != F.col("vp")) | (F.col("ucd") < F.col("vcd")) | ((F.col("ucd") == F.col("vcd")) & (F.col("ucp") <= F.col("vcp")))
        pairs = cut(down.where(once).select(F.col("ucd").alias("ud"), F.col("ucp").alias("up"), F.col("vcd").alias("vd"), F.col("vcp").alias("vp"), "diff"))
        before = depth
    return pairs


def _joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels (the smallest known member) after the links (i, j)."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        least = np.minimum(a, b)
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels = deeper


def walk(x: np.ndarray, y: np.ndarray | None, depth: int, diff: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two subtrees of one depth, given as their sorted fingerprints (y None: x with itself), ``diff`` bits
    being known to differ already; as fingerprints (a, b), one link at most for each, by which what is linked hangs together."""
    twin = y is None
    both = x if twin else np.concatenate([x, y])
    labels = np.arange(len(both))
    offset = 0 if twin else len(x)
    one = np.zeros(1, np.int64)
    stack = [(depth, one, one + len(x), one + offset, one + len(both), one + diff)]
    while stack:
        depth, a, b, c, d, differ = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, *(v[half:] for v in (a, b, c, d, differ))), (depth, *(v[:half] for v in (a, b, c, d, differ)))]
            continue
        few = ((b - a) * (d - c) <= DIRECT) | (depth == 64)
        if few.any():
            ra, rb, rc, rd = a[few], b[few], c[few], d[few]
            size = (rb - ra) * (rd - rc)
            of = np.repeat(np.arange(len(ra)), size)
            k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            wide = (rd - rc)[of]
            i, j = ra[of] + k // wide, rc[of] + k % wide
            near = np.bitwise_count(both[i] ^ both[j]) <= budget
            near &= i != j
            labels = _joined(labels, i[near], j[near])
            a, b, c, d, differ = (v[~few] for v in (a, b, c, d, differ))
        if not len(a):
            continue
        zeros = np.r_[0, np.cumsum((both >> np.uint64(63 - depth)) & np.uint64(1) == 0)]
        m, n = a + zeros[b] - zeros[a], c + zeros[d] - zeros[c]
        same = a == c  # a node with itself: its two mixed pairs are one
        spare = differ < budget
        parts = [(a, m, c, n, differ, (m > a) & (n > c)), (m, b, n, d, differ, (b > m) & (d > n)), (a, m, n, d, differ + 1, spare & (m > a) & (d > n)), (m, b, c, n, differ + 1, spare & ~same & (b > m) & (n > c))]
        stack.append((depth + 1, *(np.concatenate([p[v][p[5]] for p in parts]) for v in range(5))))
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    return both[tied], both[labels[tied]]


def links(values: DataFrame, budget: int = 2, leaf: int | None = None) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``f`` that differ in ``budget`` bits at most: not all, but enough to hold
    together whatever all links hold together."""
    placed = leaves(values, leaf or LEAF)
    blocks = cut(placed.groupBy("depth", _prefix(F.col("f"), F.col("depth")).alias("prefix")).agg(F.collect_list("f").alias("fs")))  # of bounded size
    pairs = leaf_pairs(blocks.select("depth", "prefix"), budget)
    one = (F.col("ud") == F.col("vd")) & (F.col("up") == F.col("vp"))
    x = pairs.withColumn("twin", one).join(blocks.toDF("ud", "up", "x"), ["ud", "up"])
    y = x.join(blocks.toDF("vd", "vp", "y"), ["vd", "vp"])
    rows = y.select(F.least("ud", "vd").alias("depth"), "diff", "twin", "x", F.when(~F.col("twin"), F.col("y")).alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = lambda v: np.sort(np.asarray(v, np.int64).view(np.uint64))
        for batch in batches:
            for depth, diff, twin, x, y in batch.itertuples(index=False, name=None):
                a, b = walk(order(x), None if twin else order(y), depth, diff, budget)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.mapInPandas(run, "a long, b long")


def similar_fingerprints(docs: DataFrame, width: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text", leaf: int | None = None) -> DataFrame:
    """``id, f, component_id`` of every row; the smallest id of a component names it."""
    rows = cut(fingerprints(docs, width, id_col, text_col))
    classes = cut(rows.groupBy("f").agg(F.min("id").alias("least")))
    comp = components(links(classes.select("f"), budget, leaf))
    named = classes.join(comp.withColumnRenamed("id", "f"), "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    place = cut(named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("f", "component_id"))
    return rows.join(place, "f").select("id", "f", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similar_fingerprints(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash": op13_simhash}
ORACLES: dict[str, str] = {}
