"""Hard negatives from an R-tree over vectors, packed by sort-tile-recursive.

Spark does the upper packing: rows are range-partitioned by label and the widest coordinate, each slab is sorted by label and
the next one and cut into parts of bounded size, so a popular label or vector only makes more parts. Inside a part the same
is done again down to leaves. A box (least and greatest value of each coordinate) bounds an inner product from below and
above, one interval for each coordinate. A search goes through the directory of parts first, in pages; the box that can
score highest is searched to learn a k-th score, then all parts whose boxes reach a score window and aren't strictly below
that. In a part the box with the greatest bound is opened first, for all queries of a block at once, until no open box can
still matter. Equal scores are never pruned, so ties are settled by id.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors count as
padded with zeros; rows with a null id are no anchors and come last in ties; repeated rows are rows of their own, and each
repeated anchor has its own results; scores are exact up to 2^53 and rounded to double precision beyond; an anchor without
positives, or a positive without negatives, has no rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, read

PART = 1024  # rows of a part
PAGE = 1024  # parts of a page of the directory
LEAF = 64  # rows of a leaf
BLOCK = 8192  # queries that meet a part at once
HITS = 1 << 20  # hits held before they are cut to the best


def quantised(rows: DataFrame, id_: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """``key, id, no_id, label, q`` of the rows that take part; q is floor(scale * x) of each component, as double."""
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select(id_.alias("id"), label.alias("label"), vector.cast("array<double>").alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    q = F.transform("v", lambda x: whole(x * scale))
    return cut(kept.select(F.monotonically_increasing_id().alias("key"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("no_id"), F.col("label").cast("long").alias("label"), q.alias("q")))


def packed(rows: DataFrame) -> DataFrame:
    """The rows with ``part``: parts hold PART rows at most."""
    widest = rows.select(F.posexplode("q").alias("pos", "x")).groupBy("pos").agg(F.stddev_pop("x").alias("s")).orderBy(F.desc("s"), "pos").limit(2).collect()
    first, second = ([r["pos"] for r in widest] + [0, 0])[:2]
    slabs = max(1, int(np.ceil(np.sqrt(rows.count() / PART))))
    at = lambda p: F.get("q", F.lit(p))
    dealt = rows.repartitionByRange(slabs, F.col("label"), at(first), F.col("key")).sortWithinPartitions("label", at(second), "key")
    place = F.monotonically_increasing_id()
    numbered = dealt.withColumn("place", place)
    part = F.shiftright("place", 33) * (1 << 24) + F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / PART)
    return cut(numbered.withColumn("part", part.cast("long")).drop("place"))


def _matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """The vectors as rows, padded with zeros."""
    size = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def directory(parts: DataFrame) -> DataFrame:
    """``part, lo, hi, labels``: the box of every part."""

    def box(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(rows["q"])
        return pd.DataFrame([(key[0], m.min(0), m.max(0), sorted(set(rows["label"])))], columns=["part", "lo", "hi", "labels"])

    return cut(parts.groupBy("part").applyInPandas(box, "part long, lo array<double>, hi array<double>, labels array<long>"))


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of every query with any vector of every box: each coordinate adds its own interval."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T


def _reach(q: np.ndarray, lows: np.ndarray, highs: np.ndarray, lo: np.ndarray, hi: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """(queries, boxes, windows): the greatest score inside the window that a box may hold, -inf if none."""
    least, most = _bounds(q, lo, hi)
    inside = open_[:, :, None] & (most[:, :, None] >= lows[:, None]) & (least[:, :, None] <= highs[:, None])
    return np.where(inside, np.minimum(most[:, :, None], highs[:, None]), -np.inf)


def _labelled(sets: list, wanted: np.ndarray, same: bool) -> np.ndarray:
    """(queries, boxes): whether a box has a row of the query's label (``same``), or one of another label."""
    known = {x: i for i, x in enumerate(sorted({x for s in sets for x in s} | set(wanted.tolist())))}
    has = np.zeros((len(sets), len(known)), bool)
    for i, s in enumerate(sets):
        has[i, [known[x] for x in s]] = True
    own = has[:, [known[x] for x in wanted.tolist()]].T
    return own if same else has.sum(1)[None, :] > own


def _queries(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, window ends and known k-th scores of the queries; missing windows are empty."""
    n = max(len(w) for w in rows["lows"])
    ends = [np.full((len(rows), n), fill) for fill in (np.inf, -np.inf, -np.inf)]
    for out, name in zip(ends, ("lows", "highs", "kth")):
        for i, v in enumerate(rows[name]):
            out[i, : len(v)] = v
    return _matrix(rows["q"], width), *ends


class Tree:
    """The R-tree of one part: slabs by the widest coordinate, leaves by the next one inside each slab."""

    def __init__(self, m: np.ndarray, labels: np.ndarray):
        self.m, n = m, len(m)
        slabs = max(1, int(np.ceil(np.sqrt(n / LEAF))))
        wide = lambda rows: int(np.argmax(np.ptp(m[rows], axis=0))) if m.shape[1] else 0
        by = lambda rows: rows[np.argsort(m[rows, wide(rows)], kind="stable")] if m.shape[1] else rows
        self.leaves: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        for slab in np.array_split(by(np.arange(n)), slabs):
            cuts = np.array_split(by(slab), max(1, int(np.ceil(len(slab) / LEAF))))
            self.children.append(slabs + len(self.leaves) + np.arange(len(cuts)))
            self.leaves += cuts
            groups.append(slab)
        self.inner = slabs
        groups += self.leaves
        self.lo, self.hi = np.stack([m[g].min(0) for g in groups]), np.stack([m[g].max(0) for g in groups])
        self.labels = [set(labels[g].tolist()) for g in groups]


def search_part(rows: pd.DataFrame, asks: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """``aid, w, key, id, no_id, score``: for every query and window the part's best k rows, of those that aren't strictly
    below the k-th score known before."""
    columns = ["aid", "w", "key", "id", "no_id", "score"]
    if not len(rows) or not len(asks):
        return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else bool if c == "no_id" else "int64") for c in columns})
    q, lows, highs, kth = _queries(asks, max(len(v) for v in rows["q"]))
    m = _matrix(rows["q"], q.shape[1])
    labels, keys, ids, no_id = (rows[c].to_numpy() for c in ("label", "key", "id", "no_id"))
    wanted, own = asks["label"].to_numpy(), asks["aid"].to_numpy()
    tree = Tree(m, labels)
    reach = _reach(q, lows, highs, tree.lo, tree.hi, _labelled(tree.labels, wanted, same))
    open_ = np.zeros(reach.shape[:2], bool)
    open_[:, : tree.inner] = True
    best = np.full((*lows.shape, k), -np.inf)
    hits: list[tuple] = []
    held = 0

    def cut_hits() -> tuple:
        a, w, r, s = (np.concatenate(x) for x in zip(*hits))
        good = s >= kth[a, w]
        a, w, r, s = a[good], w[good], r[good], s[good]
        order = np.lexsort((keys[r], ids[r], no_id[r], -s, w, a))
        a, w, r, s = a[order], w[order], r[order], s[order]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(a) else np.zeros(0, np.int64)
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        return a[place < k], w[place < k], r[place < k], s[place < k]

    while True:
        value = np.where(open_, np.where(reach >= kth[:, None, :], reach, -np.inf).max(2), -np.inf)
        pick = value.argmax(1)
        active = np.flatnonzero(value[np.arange(len(pick)), pick] > -np.inf)
        if not len(active):
            break
        open_[active, pick[active]] = False
        for node in np.unique(pick[active]):
            who = active[pick[active] == node]
            if node < tree.inner:
                open_[np.ix_(who, tree.children[node])] = True
                continue
            leaf = tree.leaves[node - tree.inner]
            score = q[who] @ m[leaf].T
            fits = (labels[leaf][None, :] == wanted[who][:, None]) == same
            fits &= keys[leaf][None, :] != own[who][:, None]
            for w in range(lows.shape[1]):
                inside = fits & (score >= np.maximum(lows[who, w], kth[who, w])[:, None]) & (score <= highs[who, w][:, None])
                if not inside.any():
                    continue
                all_ = np.concatenate([best[who, w], np.where(inside, score, -np.inf)], axis=1)
                best[who, w] = np.partition(all_, all_.shape[1] - k, axis=1)[:, -k:]
                kth[who, w] = np.maximum(kth[who, w], best[who, w].min(1))
                a, r = np.nonzero(inside)
                hits.append((who[a], np.full(len(a), w), leaf[r], score[a, r]))
                held += len(a)
            if held > HITS:
                hits = [cut_hits()]
                held = len(hits[0][0])
    if not hits:
        hits = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    a, w, r, s = cut_hits()
    return pd.DataFrame({"aid": own[a], "w": w, "key": keys[r], "id": ids[r], "no_id": no_id[r], "score": s})


def best_in_windows(parts: DataFrame, boxes: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """``aid, w, place, key, id, no_id, score``: for every query (``aid`` a row's key, ``label, q, lows, highs``) and each of its
    score windows the best k other rows of its label (``same``) or of other labels, over all parts."""
    pages = max(1, -(-boxes.count() // PAGE))
    blocks = max(1, -(-asks.count() // BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int")

    def route(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"aid": pd.Series(dtype="int64"), "part": pd.Series(dtype="int64"), "reach": pd.Series(dtype=object)})
        width = max(len(v) for c in ("lo", "hi") for v in rows[c])
        q, lows, highs, kth = _queries(queries.assign(kth=queries["lows"].map(lambda v: v[:0])), width)
        lo, hi = _matrix(rows["lo"], q.shape[1]), _matrix(rows["hi"], q.shape[1])
        found = _reach(q, lows, highs, lo, hi, _labelled([set(x) for x in rows["labels"]], queries["label"].to_numpy(), same))
        a, p = np.nonzero((found > -np.inf).any(2))
        return pd.DataFrame({"aid": queries["aid"].to_numpy()[a], "part": rows["part"].to_numpy()[p], "reach": pd.Series(list(found[a, p]), dtype=object)})

    paged = boxes.withColumn("page", F.pmod(F.xxhash64("part"), F.lit(pages)).cast("int")).withColumn("block", spread(blocks))
    asked = asks.withColumn("block", block).withColumn("page", spread(pages))
    routed = cut(paged.groupBy("page", "block").cogroup(asked.groupBy("page", "block")).applyInPandas(route, "aid long, part long, reach array<double>"))
    probe = routed.groupBy("aid").agg(F.max(F.struct(F.array_max("reach").alias("m"), "part")).alias("p")).select("aid", "p.part")

    def search(visits: DataFrame) -> DataFrame:
        left = parts.withColumn("block", spread(blocks))
        right = visits.join(asks, "aid").withColumn("block", block)
        schema = "aid long, w int, key long, id long, no_id boolean, score double"
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(lambda a, b: search_part(a, b, k, same), schema)

    none = F.array().cast("array<double>")
    hits = cut(search(probe.withColumn("kth", none)))
    floor = hits.groupBy("aid", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
    floor = floor.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("known"))  # one entry a window
    known = F.transform("reach", lambda x, w: F.coalesce(F.element_at("known", w), F.lit(float("-inf"))))
    rest = routed.join(probe, ["aid", "part"], "left_anti").join(floor, "aid", "left").withColumn("kth", known)
    rest = rest.where(F.exists(F.zip_with("reach", "kth", lambda r, s: (r > float("-inf")) & (r >= s)), lambda x: x)).select("aid", "part", "kth")
    order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "no_id", "id", "key")
    return hits.union(search(rest)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor row and each of its best
    positives the best negatives whose score is ``least`` to ``most`` percent of the positive's. ``rows`` are ``quantised``."""
    parts = packed(rows)
    boxes = directory(parts)
    anchors = cut(parts.where(~F.col("no_id") & anchor).select(F.col("key").alias("aid"), F.col("id").alias("anchor_id"), "label", "q"))
    ends = lambda v: F.array(F.lit(v))
    asks = anchors.select("aid", "label", "q", ends(float("-inf")).alias("lows"), ends(float("inf")).alias("highs"))
    found = cut(best_in_windows(parts, boxes, asks, positives, True))
    s = F.col("score")
    low = F.ceil(s * least / 100).cast("double")
    high = F.floor(s * most / 100).cast("double")
    exact = F.abs(s) < 2.0**46  # so that the products above have no rounding
    windows = found.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("place", F.when(exact, low).otherwise(s * (least / 100)).alias("lo"), F.when(exact, high).otherwise(s * (most / 100)).alias("hi")))).alias("w"))
    second = cut(anchors.join(windows, "aid").select("aid", "label", "q", F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs")))
    far = best_in_windows(parts, boxes, second, negatives, False).select("aid", (F.col("w") + 1).alias("w"), F.col("place").alias("rank"), _id().alias("negative_id"), _score().alias("negative_score"))
    near = found.select("aid", F.col("place").alias("w"), _id().alias("positive_id"), _score().alias("positive_score"))
    return near.join(far, ["aid", "w"]).join(anchors.select("aid", "anchor_id"), "aid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _id() -> Column:
    return F.when(~F.col("no_id"), F.col("id"))


def _score() -> Column:
    return F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.col("score"))).cast("long")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(read(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": OP12_SQL}
