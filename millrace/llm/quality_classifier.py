"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata of the text.

score(x) = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the pairwise interactions of all
features in time linear in the features, by the sum-of-squares identity. Features are computed and scored in Arrow batches
on the executors, and so is the training, on every labelled row that is not held out: rows are dealt by their ids into shards
of about ``shard_rows``, each round all shards descend from one model side by side, and the mean of what they reach, a feature
weighted by the rows of a shard that have it, is the next round's model. The driver gets that mean, whose size is fixed.

Edge cases: null and empty texts have the bias and structure features alone and get a score like any other; a null id is
never held out; repeated rows get equal scores; an id with contradictory labels teaches nothing, and of several texts of
one labelled id the one with the least hash does, so reruns agree; without any labelled row every score is 0.5; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read

WORD_BITS = 15
#: Structure features sit after the word buckets: a bin of each statistic is one feature.
BINS = 10
_STATISTICS = 10
WIDTH = (1 << WORD_BITS) + BINS * _STATISTICS
RANK = 8
BLOCK = 1 << 22  # features of rows that a task holds at once
#: A model's rows: each feature's weight, its factors and AdaGrad's sums of squares of both; the bias is the last row's weight.
W, GW, V, GV = 0, 1, slice(2, 2 + RANK), slice(2 + RANK, 2 + 2 * RANK)
SLICES = 16  # of rows, that are averaged apart

_buckets: dict[bytes, int] = {}


def _ids(words: list[bytes]) -> np.ndarray:
    if len(_buckets) > 100_000:
        _buckets.clear()
    for w in set(words).difference(_buckets):
        _buckets[w] = zlib.crc32(w) & ((1 << WORD_BITS) - 1)
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))


def structure(text: str, words: list[bytes]) -> list[float]:
    """Statistics of form, each scaled to about 0..1; the last two are metadata of length."""
    n, c = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    raw, low = (np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in (text, text.lower()))
    upper = (np.count_nonzero(raw != low) if len(raw) == len(low) else sum(map(str.isupper, text))) / c
    return [
        sum(map(text.count, "#*$%&|<>")) / n / 3,
        text.count("|") / n,
        text.count("!") / n / 2,
        upper,
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        (c - n) / n / 20,
        (len(lines) - len(set(lines))) / len(lines),
        np.log1p(len(words)) / 12,
        np.log1p(len(lines)) / 8,
    ]


def featurise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a batch: word buckets with L2-normalised square-root counts, and one bin per statistic."""
    rows, ids, values = [], [], []
    for r, text in enumerate(texts):
        text = text or ""
        words = text.lower().encode("utf-8", "surrogatepass").split()
        u, n = np.unique(_ids(words), return_counts=True)
        x = np.sqrt(n)
        bins = np.minimum(np.maximum(np.array(structure(text, words)) * BINS, 0), BINS - 1).astype(np.int64)
        ids += [u, (1 << WORD_BITS) + np.arange(_STATISTICS) * BINS + bins]
        values += [x / max(1e-9, np.sqrt((x * x).sum())), np.full(_STATISTICS, 0.5)]
        rows.append(np.full(len(u) + _STATISTICS, r))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values)


def logits(row: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output per row, and the sums s_f = sum_i v_if x_i that its gradient needs. Rows are in order."""
    starts = np.searchsorted(row, np.arange(n))
    vx = v[ids] * x[:, None]
    s = np.add.reduceat(vx, starts, 0)
    return bias + np.add.reduceat(w[ids] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts, 0)).sum(1), s


def untrained(seed: int = 5) -> np.ndarray:
    model = np.zeros((WIDTH + 1, 2 + 2 * RANK), np.float32)
    model[:-1, V] = np.random.default_rng(seed).normal(0, 0.05, (WIDTH, RANK))
    model[:, GW] = model[:-1, GV] = 1e-6
    return model


def descend(m: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, share: float, rng: np.random.Generator, rate: float = 0.1, penalty: float = 1e-5) -> None:
    """One round over the rows, which changes the model: AdaGrad on the log loss, classes weighted evenly (``share`` of all
    rows are of label 1), in mini-batches of 256 rows."""
    n = len(y)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    starts = np.searchsorted(row, np.arange(n + 1))
    w, gw, v, gv = m[:, W], m[:, GW], m[:, V], m[:, GV]
    order = rng.permutation(n)
    for a in range(0, n, 256):
        part = order[a : a + 256]
        at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in part])
        local = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
        i, xi = ids[at], x[at]
        z, s = logits(local, i, xi, len(part), w[-1], w, v)
        d = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
        dx = d[local] * xi
        u, where = np.unique(i, return_inverse=True)
        dw = np.bincount(where, dx, len(u)) + penalty * w[u]
        each = dx[:, None] * (s[local] - v[i] * xi[:, None])
        dv = np.stack([np.bincount(where, each[:, f], len(u)) for f in range(RANK)], 1) + penalty * v[u]
        gw[-1] += d.sum() ** 2
        gw[u] += dw**2
        gv[u] += dv**2
        w[-1] -= rate * d.sum() / np.sqrt(gw[-1])
        w[u] -= rate * dw / np.sqrt(gw[u])
        v[u] -= rate * dv / np.sqrt(gv[u])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, row, feature, value, label) of rows that come shard by shard: a shard at once, or about ``BLOCK`` features of it."""
    held: list[tuple] = []
    size = 0

    def block() -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, x = (np.frombuffer(b"".join(r[k] for r in held), t) for k, t in ((2, np.int32), (3, np.float32)))
        return held[0][0], np.repeat(np.arange(len(held), dtype=np.int32), [len(r[2]) // 4 for r in held]), ids, x, np.array([r[1] for r in held])

    for batch in batches:
        for r in zip(batch["shard"], batch["y"], batch["ids"], batch["x"]):
            if held and (r[0] != held[0][0] or size >= BLOCK):
                yield block()
                held, size = [], 0
            held.append(r)
            size += len(r[2]) // 4
    if held:
        yield block()


def _round(shards: DataFrame, model: np.ndarray, share: float, seed: int) -> np.ndarray:
    """The mean of the models that the shards reach from this one, summed on the executors by slices of rows."""
    width, columns = -(-len(model) // SLICES), model.shape[1]

    def told(shard: int, m: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(SLICES):
            seen = i * width + np.flatnonzero(rows[i * width : (i + 1) * width]).astype(np.int32)
            if len(seen):
                yield pd.DataFrame({"slice": [i], "shard": [shard], "seen": [seen.astype(np.int32).tobytes()], "rows": [rows[seen].astype(np.int32).tobytes()], "m": [m[seen].astype(np.float32).tobytes()]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for key, row, ids, x, y in _blocks(batches):
            if key != shard:
                if shard is not None:
                    yield from told(shard, m, rows)
                shard, m, rows, rng = key, model.astype(float), np.zeros(len(model), np.int64), np.random.default_rng([seed, key])
            descend(m, row, ids, x, y, share, rng)
            rows[:-1] += np.bincount(ids, minlength=WIDTH)  # a row has a feature once
            rows[-1] += len(y)
        if shard is not None:
            yield from told(shard, m, rows)

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        i = int(group["slice"].iat[0])
        rows, total = np.zeros(width), np.zeros((width, columns))
        for r in group.sort_values("shard").itertuples():  # in this order, so that reruns agree
            at, n = np.frombuffer(r.seen, np.int32) - i * width, np.frombuffer(r.rows, np.int32)
            rows[at] += n
            total[at] += n[:, None] * np.frombuffer(r.m, np.float32).reshape(len(at), -1)
        at = np.flatnonzero(rows)
        return pd.DataFrame({"seen": [(i * width + at).astype(np.int32).tobytes()], "m": [(total[at] / rows[at, None]).astype(np.float32).tobytes()]})

    reached = shards.mapInPandas(learn, "slice int, shard int, seen binary, rows binary, m binary")
    out = model.copy()  # features of no row stay as they are
    for r in reached.groupBy("slice").applyInPandas(mean, "seen binary, m binary").collect():
        at = np.frombuffer(r["seen"], np.int32)
        out[at] = np.frombuffer(r["m"], np.float32).reshape(len(at), -1)
    return out


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = 12_000, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[float, np.ndarray, np.ndarray] | None:
    """The machine, learnt from all labelled rows that are not held out, in ``rounds`` rounds. Of an id's documents one text is
    taken. Neither texts nor features come to the driver."""
    learns = F.col("__id").isNotNull() & ~held_out(F.col("__id"))
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y")).where(learns & F.col("y").isNotNull())
    marks = marks.groupBy("__id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")

    @F.pandas_udf("ids binary, x binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        row, ids, x = featurise(list(texts))
        starts = np.searchsorted(row, np.arange(1, len(texts)))
        parts = zip(np.split(ids.astype(np.int32), starts), np.split(x.astype(np.float32), starts))
        return pd.DataFrame([(i.tobytes(), v.tobytes()) for i, v in parts], columns=["ids", "x"])

    one = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).where(learns).groupBy("__id").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = cut(one.join(marks, "__id").select("__id", "y", features("t").alias("f")).select("__id", "y", "f.ids", "f.x"))
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return None
    count = math.ceil(n / shard_rows)
    shard = F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(count)).cast("int")
    shards = rows.select(shard.alias("shard"), "__id", "y", "ids", "x").repartitionByRange(count, "shard").sortWithinPartitions("shard", "__id").persist(StorageLevel.DISK_ONLY)
    model = untrained()
    for k in range(rounds):
        model = _round(shards, model, ones / n, k)
    shards.unpersist()
    return float(model[-1, W]), model[:-1, W], model[:-1, V]


def scorer(model: tuple[float, np.ndarray, np.ndarray] | None):
    """A Pandas UDF text -> score. The model has a fixed size (WIDTH x RANK floats)."""
    if model is not None:
        model = model[0], model[1].astype(np.float32), model[2].astype(np.float32)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.full(len(texts), 0.5)
            if model is not None:
                for a in range(0, len(texts), 500):
                    part = list(texts[a : a + 500])
                    row, ids, x = featurise(part)
                    out[a : a + 500] = 1 / (1 + np.exp(-np.clip(logits(row, ids, x, len(part), *model)[0], -30, 30)))
            yield pd.Series(out)

    return score


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = scorer(fit(docs, read(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
