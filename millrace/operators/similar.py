"""Similarity, deduplication and clustering."""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .match import jaccard_bound, nutrition_similarity, ordered_similarity, sequence_ratio, sharing_rare_names, top_exact_share
from .ranking import rank_in_group


def use_checkpoints(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


TILE = 2048  # entities of a tile; two tiles and a slice of their product are in a task's memory at once


def tile_count(n: int) -> int:
    """Tiles for n entities: of ``TILE`` at most, or up to 8, so that few entities are compared side by side too."""
    return max(-(-n // TILE), min(8, -(-n // 64)), 1)


def tile_pairs(left: DataFrame, right: DataFrame, i: int, j: int) -> DataFrame:
    """All pairs of a row of ``left`` (column ``i``, below the number i) and one of ``right`` (``j``), dealt out by pair."""
    parts = min(i * j, 2048)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.withColumn("j", every(j)).repartition(parts, "i", "j").join(right.withColumn("i", every(i)).repartition(parts, "i", "j").hint("shuffle_hash"), ["i", "j"])


def _vector_tiles(rows: DataFrame, entity: str, key: str, weight: str, side: str) -> tuple[DataFrame, int]:
    """Sparse vectors in long form as one packed row per tile (``side, {side}_ids, {side}_of, {side}_k, {side}_w``) and the
    number of tiles."""
    known = rows.where(F.col(entity).isNotNull() & F.col(key).isNotNull())
    summed = known.groupBy(F.col(entity).alias("id"), F.xxhash64(key).alias("k")).agg(F.sum(F.col(weight).cast("double")).alias("w")).checkpoint()
    tiles = tile_count(summed.select("id").distinct().count())
    kind = summed.schema["id"].dataType.simpleString()

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        of, ids = pd.factorize(group["id"], sort=True)
        order = np.lexsort((of, group["k"].to_numpy()))
        packed = [x[order].tobytes() for x in (of.astype(np.int64), group["k"].to_numpy(np.int64), group["w"].to_numpy(np.float64))]
        return pd.DataFrame([(key[0], list(ids), *packed)], columns=["t", "ids", "of", "k", "w"])

    dealt = summed.withColumn("t", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    packed = dealt.groupBy("t").applyInPandas(pack, f"t int, ids array<{kind}>, of binary, k binary, w binary")
    return packed.withColumnsRenamed({"t": side} | {c: f"{side}_{c}" for c in ("ids", "of", "k", "w")}), tiles


def weighted_jaccard(targets: DataFrame, vectors: DataFrame, entity: str, key: str, weight: str, digits: int | None = None, lines: int = 256) -> DataFrame:
    """(target, other, similarity) of all sparse vectors in long form that share a key: sum of mins over sum of maxes, as
    sum max = sum a + sum b - sum min, rounded to ``digits`` if given. Vectors are dealt into tiles and each pair of tiles
    is compared by itself, ``lines`` rows at a time, so nothing but the pairs themselves grows with their number. Keys are
    told apart by 64-bit hashes."""
    use_checkpoints(targets.sparkSession)
    left, m = _vector_tiles(targets, entity, key, weight, "i")
    right, n = (left.withColumnsRenamed({c: c.replace("i", "j", 1) for c in left.columns}), m) if targets is vectors else _vector_tiles(vectors, entity, key, weight, "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                of, k, w = (np.frombuffer(x, d) for x, d in ((row.i_of, np.int64), (row.i_k, np.int64), (row.i_w, np.float64)))
                to, l, v = (np.frombuffer(x, d) for x, d in ((row.j_of, np.int64), (row.j_k, np.int64), (row.j_w, np.float64)))
                a, b = np.asarray(row.i_ids), np.asarray(row.j_ids)
                total, other_total = np.bincount(of, np.nan_to_num(w), len(a)), np.bincount(to, np.nan_to_num(v), len(b))
                plain = bool((w > 0).all() and (v > 0).all())  # then a pair shares a key just if its sum of mins isn't 0
                for low in range(0, len(a), lines):
                    size = min(lines, len(a) - low)
                    mine = (of >= low) & (of < low + size)
                    s_of, s_k, s_w = of[mine] - low, k[mine], w[mine]
                    keys, start = np.unique(s_k, return_index=True)
                    end = np.append(start[1:], len(s_k))
                    first, last = np.searchsorted(l, keys), np.searchsorted(l, keys, "right")
                    least, met = np.zeros((size, len(b))), None if plain else np.zeros((size, len(b)), np.int8)
                    for x, y, p, q in zip(start.tolist(), end.tolist(), first.tolist(), last.tolist()):
                        if p == q:
                            continue
                        part = np.fmin.outer(s_w[x:y], v[p:q])  # a missing weight is passed over
                        if y - x == size and q - p == len(b):
                            least += part if plain else np.nan_to_num(part)
                            if met is not None:
                                np.maximum(met, 2 - np.isnan(part), out=met)
                        else:
                            at = np.ix_(s_of[x:y], to[p:q])
                            least[at] += part if plain else np.nan_to_num(part)
                            if met is not None:
                                met[at] = np.maximum(met[at], 2 - np.isnan(part))
                    rest = total[low : low + size, None] + other_total - least
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = least / rest
                    if met is not None:
                        s[met == 1] = np.nan  # all weights that meet are missing
                    if digits is not None:
                        s = np.floor(s * 10.0**digits + 0.5) / 10.0**digits
                    there = (least > 0) if met is None else met > 0
                    there &= a[low : low + size, None] != b
                    p, q = np.nonzero(there)
                    yield pd.DataFrame({"target": a[low : low + size][p], "other": b[q], "similarity": s[p, q]})

    kind, other = left.schema["i_ids"].dataType.elementType.simpleString(), right.schema["j_ids"].dataType.elementType.simpleString()
    return tile_pairs(left, right, m, n).mapInPandas(compare, f"target {kind}, other {other}, similarity double")


def numeric_similarity(pairs: list[tuple[Column, Column, float]]) -> Column:
    """1 - weighted mean |a - b| over the features that either side has; null if neither has any."""
    total = reduce(lambda x, y: x + y, [F.when(a.isNull() & b.isNull(), 0.0).otherwise(F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) * w) for a, b, w in pairs])
    weight = reduce(lambda x, y: x + y, [F.when(a.isNull() & b.isNull(), 0.0).otherwise(F.lit(w)) for a, b, w in pairs])
    return F.when(weight > 0, 1 - total / weight)


def round_half_up(c: Column, digits: int) -> Column:
    """As round() of SQL engines that work on binary numbers, without a decimal per row."""
    scale = F.lit(10.0**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def numeric_pairs(rows: DataFrame, entity: str, group: str, features: dict[str, float], digits: int) -> DataFrame:
    """(target, other, group of other, numeric) of all rows of different groups, by ``numeric_similarity``. Rows are dealt into
    tiles and pairs of tiles into tasks, where a row meets a tile of others at a time."""
    known = rows.where(F.col(group).isNotNull())
    n = tile_count(known.count())
    tile = F.pmod(F.xxhash64(entity), F.lit(n)).cast("int")
    side = lambda name, t, g, s: known.select(F.col(entity).alias(name), tile.alias(t), F.col(group).alias(g), *[F.col(f).alias(f"__{s}_{f}") for f in features])
    pairs = tile_pairs(side("target", "i", "__own", "a"), side("other", "j", group, "b"), n, n).where(F.col("__own") != F.col(group))
    score = numeric_similarity([(F.col(f"__a_{f}"), F.col(f"__b_{f}"), w) for f, w in features.items()])
    return pairs.select("target", "other", group, round_half_up(score, digits).alias("numeric"))


def recall(pairs: DataFrame, scores: dict[str, float], top: int, n: int, brand: str) -> DataFrame:
    """Pairs (target, other, brand, scores) among the ``top`` of any score, re-ranked by the weighted score, the best of
    each brand, n per target."""
    for s in scores:
        pairs = rank_in_group(pairs, ["target"], [F.desc(s), F.asc("other")], f"__r_{s}")
    kept = pairs.where(reduce(lambda a, b: a | b, [F.col(f"__r_{s}") <= top for s in scores])).drop(*[f"__r_{s}" for s in scores])
    return rerank(kept, scores, n, brand)


@F.pandas_udf(DoubleType())
def _sum_of_mins(ka: pd.Series, wa: pd.Series, kb: pd.Series, wb: pd.Series) -> pd.Series:
    """Sum of the lesser weights of the keys that both of two sparse vectors have; a missing weight is passed over."""
    flat = lambda lists, kind: np.concatenate([np.asarray(x, kind) for x in lists]) if len(lists) else np.array([], kind)
    row = lambda lists: np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    x, y, v, w = flat(ka, np.int64), flat(kb, np.int64), flat(wa, np.float64), flat(wb, np.float64)
    names, code = np.unique(np.r_[x, y], return_inverse=True)
    x, y = row(ka) * len(names) + code[: len(x)], row(kb) * len(names) + code[len(x) :]
    order = np.argsort(y, kind="stable")
    if not len(y):
        return pd.Series(np.zeros(len(ka)))
    at = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    low = np.where(y[order][at] == x, np.nan_to_num(np.fmin(v, w[order][at])), 0.0)
    return pd.Series(np.bincount(row(ka), low, len(ka)))


def pair_jaccard(pairs: DataFrame, vectors: DataFrame, entity: str, key: str, weight: str) -> DataFrame:
    """The pairs (target, other) with their weighted Jaccard, 0 without a shared key. A vector is one row, never a row per
    pair and key; entities of equal vectors are one class, and a pair of classes is compared once."""
    use_checkpoints(pairs.sparkSession)
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(key))  # a null key weighs in the total only
    summed = vectors.groupBy(F.col(entity).alias("__e"), hashed.alias("k")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    rows = summed.groupBy("__e").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("s"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "w")))).alias("v")).withColumn("__h", F.sha2(F.to_json(F.struct("s", "v")), 256)).checkpoint()
    named = rows.groupBy("__h").agg(F.min("__e").alias("__c"))
    member = rows.select("__e", "__h").join(named, "__h").select("__e", "__c").checkpoint()
    vector = rows.join(named, F.col("__e") == F.col("__c")).select("__c", "s", F.col("v.k").alias("k"), F.col("v.w").alias("w"))
    placed = pairs.join(member.toDF("target", "__a"), "target").join(member.toDF("other", "__b"), "other")
    met = placed.select("__a", "__b").distinct().join(vector.toDF("__a", "__sa", "__ka", "__wa"), "__a").join(vector.toDF("__b", "__sb", "__kb", "__wb"), "__b")
    scored = met.select("__a", "__b", "__sa", "__sb", _sum_of_mins("__ka", "__wa", "__kb", "__wb").alias("__low"))
    similarity = F.when(F.col("__low") > 0, F.col("__low") / (F.col("__sa") + F.col("__sb") - F.col("__low"))).otherwise(0.0)
    return placed.join(scored.select("__a", "__b", similarity.alias("similarity")), ["__a", "__b"]).select("target", "other", *[c for c in pairs.columns if c not in ("target", "other")], "similarity")


def rerank(kept: DataFrame, scores: dict[str, float], n: int, brand: str) -> DataFrame:
    """Recalled pairs by their weighted score: the best of each brand, n per target."""
    kept = kept.withColumn("final", F.round(reduce(lambda a, b: a + b, [F.col(s) * w for s, w in scores.items()]), 9))
    best = rank_in_group(kept, ["target", brand], [F.desc("final"), F.asc("other")], "__b").where("__b = 1").drop("__b")
    return rank_in_group(best, ["target"], [F.desc("final"), F.asc("other")]).where(F.col("rank") <= n)


def explain_pairs(pairs: DataFrame, vectors: DataFrame, entity: str, key: str, weight: str, k: int, gap: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(shared, different): each pair's k shared keys with the greatest minimum, and k keys that differ by ``gap`` or more."""
    use_checkpoints(pairs.sparkSession)
    a = vectors.select(F.col(entity).alias("target"), key, F.col(weight).alias("wa"))
    b = vectors.select(F.col(entity).alias("other"), key, F.col(weight).alias("wb"))
    named = pairs.select("target", "other").checkpoint()  # read twice, found once
    left = named.join(a, "target")
    right = named.join(b, "other")
    both = left.join(right, ["target", "other", key], "full").fillna(0.0, ["wa", "wb"])
    shared = rank_in_group(both.where("wa > 0 AND wb > 0").withColumn("least", F.least("wa", "wb")), ["target", "other"], [F.desc("least"), F.asc(key)]).where(F.col("rank") <= k)
    different = both.withColumn("gap", F.abs(F.col("wa") - F.col("wb"))).where(F.col("gap") >= gap)
    return shared, rank_in_group(different, ["target", "other"], [F.desc("gap"), F.asc(key)]).where(F.col("rank") <= k)


def closeness(seed: DataFrame, rows: DataFrame, features: dict[str, float], labels: str, bonus: float = 0.1, malus: float = 0.15) -> DataFrame:
    """Weighted closeness of every row to the seed's mean features (percent scale), plus a bonus if labels overlap with
    the seed's, minus a malus if not."""
    mean = seed.agg(*[F.avg(f).alias(f"__m_{f}") for f in features], F.array_distinct(F.flatten(F.collect_set(labels))).alias("__labels"))
    total = sum(features.values())
    close = reduce(lambda a, b: a + b, [(1 - F.abs(F.col(f) - F.col(f"__m_{f}")) / 100) * w for f, w in features.items()]) / total
    joined = rows.crossJoin(F.broadcast(mean))
    return joined.withColumn("closeness", close + F.when(F.arrays_overlap(labels, "__labels"), bonus).otherwise(-malus)).drop("__labels", *[f"__m_{f}" for f in features])


def bigram_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct character bigrams of a text as numbers, and their counts; a shorter text is a feature of its own."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-1] << 21) | c[1:], return_counts=True) if len(c) > 1 else (c if len(c) else np.array([-1]), np.ones(1, np.int64))


@F.pandas_udf(DoubleType())
def bigram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the character bigram counts of two texts; a batch counts each of its texts once."""
    if not len(a):
        return pd.Series([], dtype="float64")
    at, texts = pd.factorize(pd.concat([a, b], ignore_index=True).fillna(""))
    lists = [bigram_codes(t) for t in texts]
    size = np.array([len(x) for x, _ in lists])
    end = np.cumsum(size)
    feature = np.unique(np.concatenate([x for x, _ in lists]), return_inverse=True)[1]
    n = np.concatenate([y for _, y in lists])
    square = np.bincount(np.repeat(np.arange(len(size)), size), n * n)
    most = int(feature.max()) + 1
    key = np.repeat(np.arange(len(size)), size) * most + feature  # ascending
    x, y = at[: len(a)], at[len(a) :]
    of = np.repeat(np.arange(len(x)), size[x])
    mine = np.arange(len(of)) - np.repeat(np.cumsum(size[x]) - size[x], size[x]) + (end - size)[x][of]
    wanted = y[of] * most + feature[mine]
    there = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    dot = np.bincount(of, np.where(key[there] == wanted, n[mine] * n[there], 0), minlength=len(x))
    return pd.Series(dot / np.sqrt((square[x] * square[y]).astype(np.float64)))


SLOTS = 1 << 16  # of the table of bigram counts
PRODUCTS = 20  # pairs that a block product compares in the time of one that prefixes meet in, about


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def near_texts(rows: DataFrame, key: str, text: str, bucket: list[str], threshold: float = 0.94) -> DataFrame:
    """Pairs (a < b) of one bucket whose bigram cosine, or 0.9 x sequence ratio, reaches the threshold, exactly. Above a
    threshold of 0.9 the ratio can't matter and a bucket takes the cheaper of two exact ways: where its prefixes
    (``prefixes``) meet far less often than its texts are pairs, work grows with the candidates; where they don't, as the
    alphabet is small and the lines are long, block products (``near_texts_in_blocks``) compare all its pairs."""
    if threshold <= 0.9:
        return near_texts_in_blocks(rows, key, text, bucket, threshold)
    use_checkpoints(rows.sparkSession)
    named = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("v"), *bucket)
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    meets = prefixes(named, bucket, threshold).groupBy(*bucket, "f").agg(F.count("*").alias("n")).groupBy(*bucket).agg(F.sum(pairs("n")).alias("meets"))  # counted where they are made, not kept
    dense = named.groupBy(*bucket).agg(F.count("*").alias("n")).join(meets, bucket).where(PRODUCTS * F.col("meets") > pairs("n")).select(*bucket).checkpoint()
    post = prefixes(named.join(dense, bucket, "left_anti"), bucket, threshold).checkpoint()
    texts = named.select("k", "v")
    both = candidates(post, bucket, threshold).join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    found = both.withColumn("similarity", bigram_cosine("x", "y")).where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    return found.union(near_texts_in_blocks(named.join(dense, bucket, "left_semi"), "k", "v", bucket, threshold))


def prefixes(named: DataFrame, bucket: list[str], threshold: float) -> DataFrame:
    """``k, bucket, f, w, rest`` of texts (``k, v``): in one order of all bigrams, rare ones first, the first bigrams until the
    norm of the rest is below the threshold, each with its weight and that norm. The order comes from counts in a table of
    fixed size."""
    kind = named.schema["k"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for v in batch["v"]:
                total += np.bincount(_slot(bigram_codes(v)[0]), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    often = np.zeros(SLOTS, np.int64)
    for slot, n in named.select("v").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():  # SLOTS rows at most
        often[slot] = n

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = []
            for v in batch["v"]:
                codes, n = bigram_codes(v)
                order = np.lexsort((codes, often[_slot(codes)]))
                square = n[order].astype(np.float64) ** 2
                rest = np.sqrt(np.maximum(0, 1 - np.cumsum(square) / square.sum()))  # the norm of what follows
                size = int(np.searchsorted(-rest, -(threshold - 1e-9), "right")) + 1
                lists.append((codes[order][:size], np.sqrt(square / square.sum())[:size], rest[:size]))
            out = batch.drop(columns="v")
            for name, i in (("f", 0), ("w", 1), ("rest", 2)):
                out[name] = pd.Series([x[i] for x in lists], index=batch.index, dtype=object)
            yield out

    kinds = ", ".join(f"`{c}` {named.schema[c].dataType.simpleString()}" for c in bucket)
    listed = named.mapInPandas(first, f"k {kind}, {kinds}, f array<long>, w array<double>, rest array<double>")
    return listed.select("k", *bucket, F.explode(F.arrays_zip("f", "w", "rest")).alias("e")).select("k", *bucket, "e.*")


def candidates(post: DataFrame, bucket: list[str], threshold: float) -> DataFrame:
    """Pairs (a < b) of one bucket that may reach the threshold: they share a bigram of both prefixes, and what they share
    first, with the norms of what follows it on either side, bounds their cosine; pairs whose bound is lower end in the join."""
    right = post.withColumnsRenamed({"k": "b", "w": "wb", "rest": "rb"})
    found = post.join(right, [*bucket, "f"]).where((F.col("k") < F.col("b")) & (F.col("w") * F.col("wb") + F.col("rest") * F.col("rb") >= threshold - 1e-9))
    return found.select(F.col("k").alias("a"), "b").distinct()


def near_texts_in_blocks(rows: DataFrame, key: str, text: str, bucket: list[str], threshold: float = 0.94, tile: int = 2048) -> DataFrame:
    """``near_texts`` of any threshold by comparing every pair of a bucket: the bucket is dealt into tiles, each pair of tiles
    is one group and one block product of bigram counts. Up to a threshold of 0.9 every pair's ratio is worked out."""
    named = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("v"), *bucket)
    sized = named.groupBy(*bucket).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = named.join(sized, bucket).withColumn("t", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int"))
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("t")).alias("i"), F.greatest(t, F.col("t")).alias("j"))))
    dealt = dealt.withColumn("p", spread).select(*bucket, "p.i", "p.j", "t", "k", "v")
    kind = named.schema["k"].dataType.simpleString()
    least = threshold if threshold > 0.9 else -1.0

    def block(group: pd.DataFrame) -> pd.DataFrame:
        places: dict[str, int] = {}
        counts = [Counter(x[n : n + 2] for n in range(len(x) - 1)) or Counter([x]) for x in group["v"]]
        at = np.fromiter((places.setdefault(g, len(places)) for c in counts for g in c), np.int64)
        of = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        n = np.fromiter((v for c in counts for v in c.values()), np.float64)
        square = np.bincount(of, n * n)
        share = (n / np.sqrt(square)[of]).astype(np.float32)
        i, j, t = group["i"].iat[0], group["j"].iat[0], group["t"].to_numpy()
        left, right = np.flatnonzero(t == i), np.flatnonzero(t == j)
        c = np.zeros((len(left), len(right)), np.float32)
        row = np.empty(len(t), np.int64)
        for low in range(0, len(places), 2048):  # so many bigrams at once: the memory doesn't grow with the alphabet
            inside = (at >= low) & (at < low + 2048)

            def part(side: np.ndarray) -> np.ndarray:
                row[:] = -1
                row[side] = np.arange(len(side))
                mine = inside & (row[of] >= 0)
                m = np.zeros((len(side), min(2048, len(places) - low)), np.float32)
                m[row[of[mine]], at[mine] - low] = share[mine]
                return m

            m = part(left)
            c += m @ (m if i == j else part(right)).T
        p, q = np.nonzero(c >= least - 1e-3)
        if i == j:
            p, q = p[p < q], q[p < q]
        a, b = left[p], right[q]
        cosine = np.array([sum(v * counts[y][g] for g, v in counts[x].items()) / math.sqrt(square[x] * square[y]) for x, y in zip(a, b)], np.float64)
        good = cosine >= least
        a, b = a[good], b[good]
        k, v = group["k"].tolist(), group["v"].tolist()
        ordered = [(x, y) if k[x] < k[y] else (y, x) for x, y in zip(a, b)]
        lists = {"a": [k[x] for x, _ in ordered], "b": [k[y] for _, y in ordered], "x": [v[x] for x, _ in ordered], "y": [v[y] for _, y in ordered]}
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in lists.items()} | {"cosine": cosine[good]})

    pairs = dealt.groupBy(*bucket, "i", "j").applyInPandas(block, f"a {kind}, b {kind}, x string, y string, cosine double")
    similarity = F.col("cosine") if threshold > 0.9 else F.greatest("cosine", 0.9 * sequence_ratio("x", "y"))
    return pairs.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def near_vectors(rows: DataFrame, key: str, vector: str, bucket: list[str], threshold: float = 0.85, tile: int = 512) -> DataFrame:
    """Pairs (a < b) of one bucket with a cosine of the threshold or more: a bucket is dealt into tiles, each pair of tiles
    is one group and one block product, so a large bucket spreads over many tasks."""
    known = rows.where(F.col(vector).isNotNull())
    sized = known.groupBy(*bucket).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = known.select(key, vector, *bucket).join(sized, bucket).withColumn("t", F.pmod(F.xxhash64(key), F.col("tiles")).cast("int"))
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("t")).alias("i"), F.greatest(t, F.col("t")).alias("j"))))
    dealt = dealt.withColumn("p", spread).select(*bucket, "p.i", "p.j", "t", F.col(key).alias("k"), F.col(vector).alias("v"))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(group["v"].to_numpy()).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-12
        k, t = group["k"].to_numpy(), group["t"].to_numpy()
        i, j = group["i"].iat[0], group["j"].iat[0]
        left = np.flatnonzero(t == i)
        right = np.flatnonzero(t == j)
        c = m[left] @ m[right].T
        p, q = np.nonzero(c >= threshold)
        a, b, s = k[left[p]], k[right[q]], c[p, q]
        keep = a < b if i == j else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s[keep]})

    return dealt.groupBy(*bucket, "i", "j").applyInPandas(block, "a long, b long, similarity double")


def tables_for(threshold: float, recall: float, bits: int) -> int:
    """Hash tables of ``bits`` hyperplanes after which a pair at the threshold has met with the probability ``recall``, if one
    differing bit is probed: planes part two vectors with the probability angle / pi."""
    p = 1 - math.acos(threshold) / math.pi
    met = p**bits + bits * p ** (bits - 1) * (1 - p)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1


def near_vectors_by_planes(rows: DataFrame, key: str, vector: str, bucket: list[str], threshold: float = 0.85, recall: float = 0.95, bits: int = 12, probes: int = 3, crowd: int = 256, seed: int = 7) -> DataFrame:
    """``near_vectors`` for large buckets, by random-hyperplane tables: in each table a vector lies under the signs of its
    ``bits`` projections, and under ``probes`` more codes, each with one of its least certain signs turned (multi-probe).
    Vectors that share a code are compared exactly, those of a crowded one (over ``crowd``) by block products; the number of tables follows from
    the recall wanted for pairs at the threshold (``tables_for``), and nearer pairs meet more often. What it returns is
    exact; it may lack pairs. ``near_vectors`` is the exact mode."""
    tables = tables_for(threshold, recall, bits)

    @F.pandas_udf("array<long>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            out = []
            for v in batch:
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(seed).normal(size=(tables * bits, len(v)))
                side = (planes[len(v)] @ np.asarray(v, np.float64)).reshape(tables, bits)
                own = (side > 0) @ weights
                unsure = np.argsort(np.abs(side), axis=1)[:, :probes]
                each = np.concatenate([own[:, None], own[:, None] ^ weights[unsure]], axis=1)
                out.append((each + (np.arange(tables)[:, None] << bits)).ravel())
            yield pd.Series(out, dtype=object)

    use_checkpoints(rows.sparkSession)
    known = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(F.col(key).alias("k"), F.col(vector).alias("v"), *bucket)
    coded = known.select("k", *bucket, F.explode(codes(F.col("v"))).alias("__code")).checkpoint()
    where = [*bucket, "__code"]
    full = coded.groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > crowd).drop("n").checkpoint()
    few = coded.join(full, where, "left_anti")
    pairs = few.join(few.withColumnRenamed("k", "b"), where).where("k < b").select(F.col("k").alias("a"), "b").distinct()
    vectors = known.select("k", "v")
    met = pairs.join(vectors.toDF("a", "__x"), "a").join(vectors.toDF("b", "__y"), "b")
    found = met.select("a", "b", _cosine("__x", "__y").alias("similarity")).where(F.col("similarity") >= threshold)
    crowded = near_vectors(coded.join(full, where).join(vectors, "k"), "k", "v", where, threshold)
    return found.union(crowded).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


@F.pandas_udf(DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.stack(c.to_numpy()).astype(np.float64) for c in (a, b))
    norm = lambda m: np.linalg.norm(m, axis=1) + 1e-12
    return pd.Series((x * y).sum(1) / (norm(x) * norm(y)))


def without_conflicts(pairs: DataFrame, points: DataFrame, key: str, conditions: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets of no condition, if neither is null or empty, are disjoint."""
    side = lambda k, n: points.select(F.col(key).alias(k), *[F.col(c).alias(f"__{n}{i}") for i, c in enumerate(conditions)])
    joined = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    for i in range(len(conditions)):
        x, y = F.col(f"__x{i}"), F.col(f"__y{i}")
        joined = joined.where((F.coalesce(F.size(x), F.lit(0)) <= 0) | (F.coalesce(F.size(y), F.lit(0)) <= 0) | (F.size(F.array_intersect(x, y)) > 0))
    return joined.select(*pairs.columns)


def clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, cluster`` (the smallest id reachable) for every id in a pair: alternating large and small stars, checkpointed
    each round, until nothing changes. Only ids in pairs appear, so each cluster has two members at least."""
    use_checkpoints(pairs.sparkSession)
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("cluster"))
    return members.union(members.select(F.col("cluster").alias("id"), "cluster").distinct())


def merge_clusters(members: DataFrame, points: DataFrame, key: str, content: str, sources: str) -> DataFrame:
    """Per cluster: the canonical point (longest content, most sources, least id), its members and distinct sources."""
    rows = members.withColumnRenamed("id", key).join(points, key)
    best = F.max(F.struct(F.length(content).alias("l"), F.size(sources).alias("s"), (-F.col(key)).alias("k")))
    out = rows.groupBy("cluster").agg(best.alias("b"), F.count("*").alias("merged"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(sources)))).alias("sources"))
    return out.select("cluster", (-F.col("b.k")).alias("canonical"), "merged", "sources")


def rewrite_votes(votes: DataFrame, members: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Votes on canonical ids, each once."""
    to = members.join(merged.select("cluster", "canonical"), "cluster").select(F.col("id").alias(key), "canonical")
    return votes.join(to, key, "left").withColumn(key, F.coalesce("canonical", key)).drop("canonical").distinct()


def existing_by_two_keys(new: DataFrame, old: DataFrame, id_: str, first: list[str], second: list[str]) -> DataFrame:
    """New rows with the least id of an old row that has the same first or the same second key, else null."""
    a = old.groupBy(*first).agg(F.min(id_).alias("__a"))
    b = old.groupBy(*second).agg(F.min(id_).alias("__b"))
    return new.join(a, first, "left").join(b, second, "left").withColumn("existing", F.least("__a", "__b")).drop("__a", "__b")


def first_in_batch(new: DataFrame, id_: str, first: list[str], second: list[str]) -> DataFrame:
    """New rows with ``first``, the least id of the rows of the batch that are linked to it by either key, directly or not.
    Each key's rows are linked to its least id only. Keys with a null link nothing."""
    def linked(keys: list[str]) -> DataFrame:
        hubs = new.groupBy(*keys).agg(F.min(id_).alias("b"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
        return new.select(F.col(id_).alias("a"), *keys).join(hubs, keys).select("a", "b")

    members = clusters(linked(first).union(linked(second))).withColumnsRenamed({"id": id_, "cluster": "first"})
    return new.join(members, id_, "left").withColumn("first", F.coalesce("first", id_))


def mergeable_lists(classes: DataFrame, least: float = 0.96, top_least: float = 0.8, metrics: int = 4, nutrition_least: float = 0.95) -> DataFrame:
    """(ga, gb, a, b), directed: the class ``a`` agrees with the class ``b`` of its group whose list is another, as names and
    nutrition are near. Classes: ``grp, list, cls, names, nutrition``; ``list`` names a group's list. Lists are compared
    once, whatever classes they have."""
    lists = classes.groupBy("grp", "list").agg(F.first("names").alias("n"))
    one, other = lists.toDF("grp", "a", "x"), lists.toDF("grp", "b", "y")
    near = sharing_rare_names(one, other, jaccard_bound(least), ["grp"]).where("a <> b").join(one, ["grp", "a"]).join(other, ["grp", "b"])
    near = near.where((top_exact_share(F.col("x"), F.col("y")) >= top_least) & (ordered_similarity(F.col("x"), F.col("y")) >= least)).select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    both = near.join(classes.select(F.col("list").alias("ga"), F.col("cls").alias("a"), F.col("nutrition").alias("m")), "ga").join(classes.select(F.col("list").alias("gb"), F.col("cls").alias("b"), F.col("nutrition").alias("o")), "gb")
    score, comparable = nutrition_similarity(F.col("m"), F.col("o"))
    return both.where((comparable >= metrics) & (score >= nutrition_least)).select("ga", "gb", "a", "b")


def ordered_clusters(rows: DataFrame, group: str, id_: str, names: str, nutrition: str, **rule: float) -> DataFrame:
    """(group, id, cluster): in id order, a row joins the cluster whose newest row it agrees with (equal lists, or the rule of
    ``mergeable_lists``), if there is exactly one, else it opens a cluster, named by its id. Only lists that are linked,
    directly or not, bear on each other, so each such set of a group is a stream of its own: a task keeps its links and one
    count and cluster for each class of equal names and nutrition, never the rows. Rows with a null group, id or list are
    left out; ids are unique in a group."""
    use_checkpoints(rows.sparkSession)
    r = rows.where(F.col(group).isNotNull() & F.col(id_).isNotNull() & F.col(names).isNotNull())
    metrics = F.coalesce(F.to_json(F.array_sort(F.map_entries(nutrition))), F.lit(""))
    r = r.select(F.col(group).alias("grp"), F.col(id_).alias("id"), F.col(names).alias("names"), F.col(nutrition).alias("nutrition"), F.xxhash64(F.col(group), F.to_json(names)).alias("list"), metrics.alias("metrics"))
    r = r.withColumn("cls", F.xxhash64("list", "metrics"))
    links = mergeable_lists(r.groupBy("grp", "list", "cls").agg(F.first("names").alias("names"), F.first("nutrition").alias("nutrition")).checkpoint(), **rule).checkpoint()
    sets = clusters(links, "ga", "gb").toDF("list", "set")
    edges = links.join(sets, links["ga"] == sets["list"]).select("set", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("list"), "a", "b", F.lit(None).cast(rows.schema[group].dataType).alias("grp"))
    events = r.join(sets, "list", "left").select(F.coalesce("set", "list").alias("set"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), "list", F.col("cls").alias("a"), F.lit(0).cast("long").alias("b"), "grp")
    dealt = edges.union(events).repartition("set").sortWithinPartitions("set", "kind", "id")
    schema = rows.select(group, F.col(id_), F.col(id_).alias("cluster")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for batch in batches:
            out = []
            for s, kind, key, listed, a, b, g in batch.itertuples(index=False, name=None):
                if s != at:
                    at, agrees, newest, of = s, {}, {}, {}
                if not kind:
                    agrees.setdefault(a, []).append(b)
                    continue
                same = of.setdefault(listed, set())  # classes of this list that a newest row has
                hits = [*same, *(d for d in agrees.get(a, ()) if d in newest)] if len(same) < 2 else ()
                if len(hits) == 1 and newest[hits[0]][0] == 1:
                    _, where, cluster = newest.pop(hits[0])
                    of[where].discard(hits[0])
                else:
                    cluster = key
                newest[a] = (newest[a][0] + 1 if a in newest else 1, listed, cluster)  # of several only the number matters
                same.add(a)
                out.append((g, key, cluster))
            yield pd.DataFrame(out, columns=schema.names)

    return dealt.mapInPandas(run, schema)
