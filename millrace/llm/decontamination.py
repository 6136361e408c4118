"""Benchmark decontamination by latent semantic retrieval.

Document frequencies of hashed words are counted over all documents. A randomised SVD of the TF-IDF passages of all
documents, copies included (two distributed passes), gives a latent space, scaled so that every direction has unit variance.
Candidates are regions of a document, one at every 8th word, an item's length and half of it longer, whose
window has a latent cosine of ``cosine`` or more with the item. Cosines are only computed where an item can pass at all;
two bounds that lose none say so: of an item's rarest words some must be in the region, as the others can't make up the
least subsequence, and the region must have enough words of the item. The region's longest common subsequence with the
item, and with the item's answer (its last words), decides. Where that leaves a document without a hit on an item, its
other plausible regions are judged as well, so that a rewording which the latent space can't see isn't lost. Items are held in blocks of about ``item_block``: each block is
a pass of its own whose hits are written before the next block is read, so a large benchmark costs passes, not memory.

Edge cases: null and empty texts or items match nothing; items under ``min_words`` words are matched as an exact sequence of
words; items of any length have regions of their own length; an item without id is searched like any other and has a null
``item_id`` (items of one id are judged one by one); texts are read whole, in segments that overlap by more than an item's
region; of equal hits of a document with one item the best is given (ties: the first in the text); repeated rows are
judged one by one; an empty corpus or benchmark gives no hits; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read

BITS = 15
DIMS = 1 << BITS
RANK, EXTRA = 64, 8
STEP = 8  # words of a block
RARE = 3  # rare words of an item that a region must have
SEGMENT = 60_000  # words searched at once
PIECE = 1 << 17  # bytes hashed at once
RUN = 1 << 19  # bytes multiplied at once
TASKS = 256  # that make the latent space, at most: their sums are added up
_BASE = 0xD6E8FEB86659FD93
#: ASCII letters are lower-cased; ASCII punctuation and control characters separate words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def _raw(text: str | None) -> bytes:
    """UTF-8 in lower case, with a space for everything that separates words."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""


def words_of(text: str | None) -> list[bytes]:
    return _raw(text).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse, modulo 2^64."""
    base = np.array([_BASE, pow(_BASE, -1, 1 << 64)], np.uint64)
    out = np.ones((2, n), np.uint64)
    np.cumprod(np.broadcast_to(base[:, None], (2, n - 1)), axis=1, out=out[:, 1:])
    return out[0], out[1]


_usual: list[tuple[np.ndarray, np.ndarray]] = []  # the powers for pieces of PIECE bytes, made once in a worker


def _piece_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a piece starts, and its bucket: a polynomial of its bytes modulo 2^64, mixed, of all words at once."""
    b = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], b != 32, [False]])))
    starts, ends = edges[::2], edges[1::2]
    if len(b) <= PIECE and not _usual:
        _usual.append(_powers(PIECE))
    power, inverse = _usual[0] if len(b) <= PIECE else _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * power[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return starts, (h >> np.uint64(64 - BITS)).astype(np.int32)


def _located(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a raw text starts, and its bucket. Pieces end between words."""
    if len(raw) <= PIECE:
        return _piece_words(raw)
    starts, ids, a = [], [], 0
    while a < len(raw):
        z = raw.rfind(b" ", a + 1, a + PIECE) if a + PIECE < len(raw) else len(raw)
        z = z if z > 0 else raw.find(b" ", a + PIECE)  # a word longer than a piece
        z = z if z > 0 else len(raw)
        s, i = _piece_words(raw[a:z])
        starts.append(s + a)
        ids.append(i)
        a = z
    return np.concatenate(starts), np.concatenate(ids)


def _ids(words: list[bytes]) -> np.ndarray:
    return _located(b" ".join(words))[1]


def _runs(texts: Iterable[str | None], most: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in runs of about ``most`` bytes (a longer text is a run of its own): (raw bytes, where words start, their buckets,
    the number of words before each text and in all)."""

    def run() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        raw = b" ".join(held)
        starts, ids = _located(raw)
        return raw, starts, ids, np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in held)]))

    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = _raw(text)
        if held and size + len(raw) >= most:
            yield run()
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield run()


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents with each word bucket, and documents: summed on the executors, DIMS numbers come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, _, ids, at in _runs(batch["t"]):
                for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                    total[ids[a:z]] += 1  # once, however often it comes
            n += len(batch)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.r_[at, -1], "n": np.r_[total[at], n]})

    got = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMS)
    inner = got[got["bucket"] >= 0]
    df[inner["bucket"].to_numpy()] = inner["n"].to_numpy()
    return df, int(got.loc[got["bucket"] == -1, "n"].sum())


def _passages(texts: Iterable[str | None], passage: int, inverse: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word buckets, passage starts, 1 / squared norm of each passage's TF-IDF row) of runs of texts."""
    for _, _, ids, at in _runs(texts, RUN):
        if len(ids):
            n = -(-np.diff(at) // passage)
            starts = np.repeat(at[:-1], n) + passage * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            yield ids, starts, 1 / (np.add.reduceat(inverse[ids] ** 2, starts) + 1e-9)


def _sums(ids: np.ndarray, starts: np.ndarray, weighted: np.ndarray, passage: int) -> np.ndarray:
    """The sum of each passage's rows of ``weighted``, whose last row is zeros: a word of every passage at a time."""
    places = starts[:, None] + np.arange(passage)
    words = np.append(ids, DIMS)[np.where(places < np.append(starts[1:], len(ids))[:, None], places, len(ids))].T
    z = weighted[words[0]]
    more = np.empty_like(z)
    for row in words[1:]:
        z += np.take(weighted, row, 0, out=more, mode="clip")
    return z


def _spread(out: np.ndarray, ids: np.ndarray, starts: np.ndarray, z: np.ndarray) -> None:
    """Adds each passage's row of z to the rows of all its words, repeats included: the r-th place of every word at a time,
    frequent words first, and the rest of the 64 most frequent ones word by word."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    words, part = ids[order], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))[order]
    first = np.flatnonzero(np.diff(words, prepend=-1))
    count = np.diff(np.append(first, len(words)))
    by = np.argsort(-count, kind="stable")
    first, count = first[by], count[by]
    total = z[part[first]]
    more = np.empty_like(total)
    r = 1
    while (n := int(np.searchsorted(-count, -r))) > 64:  # words with more than r places
        total[:n] += np.take(z, part[first[:n] + r], 0, out=more[:n], mode="clip")
        r += 1
    for i in range(n):
        total[i] += z[part[first[i] + r : first[i] + count[i]]].sum(0)
    out[words[first]] += total


def _range_of(docs: DataFrame, idf: np.ndarray, columns: int, passage: int, seed: int) -> np.ndarray:
    """(A^T A) times a random basis, over the row-normalised TF-IDF passages A of all texts. Each task makes the basis from
    the seed; slices of rows are summed in groups, and DIMS x columns numbers come to the driver."""
    slices = 64
    width = DIMS // slices
    inverse = idf.astype(np.float32)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighted = np.zeros((DIMS + 1, columns), np.float32)
        np.multiply(np.random.default_rng(seed).standard_normal((DIMS, columns), np.float32), inverse[:, None], out=weighted[:-1])
        out = np.zeros((DIMS, columns), np.float32)
        for batch in batches:
            for ids, starts, norm in _passages(batch["t"], passage, inverse):
                _spread(out, ids, starts, _sums(ids, starts, weighted, passage) * norm[:, None])
        out *= inverse[:, None]
        here = TaskContext.get().partitionId()
        for i in range(slices):
            rows = out[i * width : (i + 1) * width]
            seen = np.flatnonzero(rows.any(1)).astype(np.int32)
            if len(seen):
                yield pd.DataFrame({"slice": [i], "task": [here], "seen": [seen.tobytes()], "rows": [rows[seen].tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((width, columns))
        for r in group.sort_values("task").itertuples():  # in this order, so that reruns agree
            total[np.frombuffer(r.seen, np.int32)] += np.frombuffer(r.rows, np.float32).reshape(-1, columns)
        return pd.DataFrame({"slice": [group["slice"].iat[0]], "rows": [total.astype(np.float32).tobytes()]})

    out = np.zeros((DIMS, columns), np.float32)
    summed = docs.mapInPandas(multiply, "slice int, task int, seen binary, rows binary").groupBy("slice").applyInPandas(add, "slice int, rows binary")
    for r in summed.toLocalIterator():  # a partition at a time
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["rows"], np.float32).reshape(width, -1)
    return out


def _projected(docs: DataFrame, idf: np.ndarray, basis: np.ndarray, passage: int) -> np.ndarray:
    """(A basis)^T (A basis): columns x columns, summed over the passages of all texts."""
    half, inverse, columns = _halved(idf[:, None].astype(np.float32) * basis), idf.astype(np.float32), basis.shape[1]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighted, out = np.vstack([half, np.zeros((1, columns), half.dtype)]).astype(np.float32), np.zeros((columns, columns))
        for batch in batches:
            for ids, starts, norm in _passages(batch["t"], passage, inverse):
                z = _sums(ids, starts, weighted, passage) * np.sqrt(norm)[:, None]
                out += z.T @ z
        yield pd.DataFrame({"m": [out.tobytes()]})

    return sum((np.frombuffer(r.m).reshape(columns, columns) for r in docs.mapInPandas(multiply, "m binary").collect()), np.zeros((columns, columns)))


def _halved(x: np.ndarray) -> np.ndarray:
    """Half-precision values on a common scale, as a model is sent to every task; cosines and bases don't mind the scale."""
    return (x * (1000 / (np.abs(x).max() + 1e-12))).astype(np.float16)


def latent_space(docs: DataFrame, text_col: str, df: np.ndarray, n: int, passage: int = 48, seed: int = 3) -> np.ndarray:
    """DIMS x RANK, half precision: a word bucket's place in the scaled latent space of all texts, its inverse document
    frequency included. A task's sums are as large as the space, so ``TASKS`` at most make them, whatever the input."""
    idf = np.log((n + 1) / (df + 1)) + 0.1
    texts = docs.select(F.col(text_col).alias("t")).coalesce(TASKS)
    basis = np.linalg.qr(_range_of(texts, idf, RANK + EXTRA, passage, seed))[0]
    values, vectors = np.linalg.eigh(_projected(texts, idf, basis, passage))
    top = np.argsort(values)[::-1][:RANK]
    scale = np.sqrt(np.maximum(values[top], values.max() * 1e-6 + 1e-12))
    basis = basis @ (vectors[:, top] / scale).astype(np.float32)
    basis *= idf[:, None].astype(np.float32)
    return _halved(basis)


def common_subsequence(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of an item (places of each word as bits) and the words, bit-parallel."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Items:
    """The items of one block: their words, masks, unit vectors, window widths in blocks, and rare words by bucket."""

    def __init__(self, rows: list[tuple[int | None, str | None]], space: np.ndarray, df: np.ndarray, min_words: int, least: float) -> None:
        kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if w]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.masks = [_masks(w) for w in self.words]
        self.answers = [w[-max(3, len(w) // 4) :] for w in self.words]
        self.answer_masks = [_masks(w) for w in self.answers]
        self.exact = [len(w) < min_words for w in self.words]  # too short for a subsequence to prove anything
        self.width = np.array([max(2, round(len(w) / STEP)) for w in self.words], np.int64)  # in blocks
        self.slack = np.array([max(STEP, len(w) // 4) for w in self.words], np.int64)  # words on either side of a window that still belong to the region
        self.span = np.maximum(self.width * STEP, [len(w) for w in self.words]) + 2 * self.slack if self.words else self.width
        self.need = np.array([len(w) if x else math.ceil(least * len(w) - 1e-9) for w, x in zip(self.words, self.exact)], np.int64)
        vectors = [space[_ids(w)].astype(np.float32).sum(0) for w in self.words]
        self.vectors = [v / (np.linalg.norm(v) + 1e-9) for v in vectors]
        self.rare = np.minimum(RARE, self.need)
        rare: list[tuple[int, int]] = []
        for k, w in enumerate(self.words):  # all other words together are fewer than need by the rare ones that must match
            by_df = sorted(_ids(w).tolist(), key=lambda i: (df[i], i))
            rare += [(i, k) for i in set(by_df[: len(w) - int(self.need[k]) + int(self.rare[k])])]
        rare.sort()
        self.rare_items = np.array([k for _, k in rare], np.int64)
        self.rare_from = np.searchsorted([i for i, _ in rare], np.arange(DIMS + 2))
        self._member: np.ndarray | None = None

    def member(self) -> np.ndarray:
        """Whether an item has a word bucket, items x DIMS; made in the worker."""
        if self._member is None:
            self._member = np.zeros((len(self.words), DIMS + 1), bool)
            for k, w in enumerate(self.words):
                self._member[k, _ids(w)] = True
        return self._member


def _judge(items: Items, k: int, region: list[bytes], verbatim: float, reworded: float, answer: float) -> tuple[float, float] | None:
    if items.exact[k]:
        n = len(items.words[k])
        return (1.0, 1.0) if any(region[p : p + n] == items.words[k] for p in range(len(region) - n + 1)) else None
    lcs = common_subsequence(items.masks[k], len(items.words[k]), region) / len(items.words[k])
    if lcs < reworded:
        return None
    said = common_subsequence(items.answer_masks[k], len(items.answers[k]), region) / len(items.answers[k])
    return (lcs, said) if lcs >= verbatim or said >= answer else None


def _candidates(items: Items, ids: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, item) of every region, of a text's words around a block, that has enough rare words of the item."""
    count = np.diff(items.rare_from)[ids]
    at = np.flatnonzero(count)
    count = count[at]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item = items.rare_items[np.repeat(items.rare_from[ids[at]], count) + within]
    place = np.repeat(at, count)
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    first = np.arange(len(item))
    last = first + items.rare[item] - 1
    first, last = first[last < len(item)], last[last < len(item)]
    k, p, q = item[first], place[first], place[last]
    good = (item[last] == k) & (owner[p // STEP] == owner[q // STEP]) & (q - p < items.span[k])
    k, p, q = k[good], p[good], q[good]
    text, slack = owner[p // STEP], items.slack[k]
    low = np.maximum(-(-(q + 1 - (items.span[k] - slack)) // STEP), ends[0][text] // STEP)
    high = np.minimum((p + slack) // STEP, (ends[1][text] - 1) // STEP)
    n = np.maximum(high - low + 1, 0)
    block = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = np.unique(np.repeat(k, n) * len(owner) + block)
    return key % len(owner), key // len(owner)


def _plausible(b: np.ndarray, c: np.ndarray, items: Items, ids: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """The candidates whose region has enough words of the item for the least common subsequence: no other can pass."""
    member = items.member().ravel()
    order = np.argsort(items.span[c], kind="stable")  # regions of like length together: a piece holds a bounded number of words
    b, c = b[order], c[order]
    a = 0
    while a < len(b):
        piece = max(1, 4_000_000 // int(items.span[c[min(len(b), a + 8192) - 1]]))
        x, y = b[a : a + min(piece, 8192)], c[a : a + min(piece, 8192)]
        a += len(x)
        at = (x * STEP - items.slack[y])[:, None] + np.arange(items.span[y].max())
        low = ends[0][owner[x]]
        high = np.minimum(ends[1][owner[x]], x * STEP - items.slack[y] + items.span[y])
        inside = (at >= low[:, None]) & (at < high[:, None])
        count = (np.take(member, (y * (DIMS + 1))[:, None] + np.take(ids, at, mode="clip")) & inside).sum(1)
        good = count >= items.need[y]
        yield from zip(x[good].tolist(), y[good].tolist())


def _cosines(b: np.ndarray, c: np.ndarray, space: np.ndarray, items: Items, ids: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Latent cosine of each candidate's item with the window at its block: an item's length, not beyond the text's end."""
    out = np.zeros(len(b))
    for n, (x, k) in enumerate(zip(b.tolist(), c.tolist())):
        w = space[ids[x * STEP : min((x + int(items.width[k])) * STEP, ends[1][owner[x]])]].sum(0)
        out[n] = w @ items.vectors[k] / (np.linalg.norm(w) + 1e-6)
    return out


def _search(texts: list[str | None], space: np.ndarray, items: Items, verbatim: float, reworded: float, answer: float, cosine: float) -> list[list[tuple]]:
    """For each text the items found: (item id, cosine, LCS share, answer share)."""
    out: list[dict[int, tuple]] = [{} for _ in texts]

    def look(held: list[tuple[int, int, int]]) -> None:
        """Parts of a run: (text, first word, word after the last)."""
        doc, low, high = np.array(held, np.int64).T
        n = high - low
        blocks = -(-n // STEP)  # every part fills whole blocks, with a bucket of zeros at its end
        begin = STEP * (np.cumsum(blocks) - blocks)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat = np.full(STEP * blocks.sum(), DIMS, np.int32)
        flat[np.repeat(begin, n) + within] = ids[np.repeat(low, n) + within]
        owner = np.repeat(np.arange(len(held)), blocks)
        base = STEP * np.arange(len(owner)) - np.repeat(begin, blocks)
        size_of = np.stack([begin, begin + n])  # where each part starts and ends
        found = sorted(_plausible(*_candidates(items, flat, owner, size_of), items, flat, owner, size_of))
        at_block, ks = np.array(found, np.int64).reshape(-1, 2).T
        near = _cosines(at_block, ks, space, items, flat, owner, size_of)
        first = near >= cosine
        for at in [*np.flatnonzero(first).tolist(), *np.flatnonzero(~first).tolist()]:  # the cosine's candidates, then the rest
            b, k = int(at_block[at]), int(ks[at])
            h = int(owner[b])
            known = out[doc[h]].get(k)
            if known and (known[2] >= 0.95 or not first[at]):
                continue
            a = int(base[b] - items.slack[k])
            z = int(min(low[h] + a + items.span[k], high[h]))
            region = raw[starts[low[h] + max(0, a)] : starts[z] if z < len(starts) else len(raw)].split()
            got = _judge(items, k, region, verbatim, reworded, answer)
            if got and (not known or got[0] > known[2]):
                out[doc[h]][k] = (items.ids[k], float(near[at]), *got)

    overlap = int(items.span.max()) + 4 * STEP
    d = 0
    for raw, starts, ids, at in _runs(texts):
        held: list[tuple[int, int, int]] = []
        size = 0
        for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
            for a in range(low, max(low + 1, high - overlap) if high > low else low, SEGMENT):
                held.append((d, a, min(high, a + SEGMENT + overlap)))
                size += held[-1][2] - a
                if size >= SEGMENT:
                    look(held)
                    held, size = [], 0
            d += 1
        if held:
            look(held)
    return [list(x.values()) for x in out]


_HIT = "array<struct<item_id:long,cosine:double,lcs:double,answer:double>>"


def _searcher(space: np.ndarray, items: Items, *limits: float):
    @F.pandas_udf(_HIT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        full = np.vstack([space.astype(np.float32), np.zeros((1, space.shape[1]), np.float32)])
        for texts in batches:
            hits = _search(list(texts), full, items, *limits) if items.ids else [[]] * len(texts)
            yield pd.Series([[dict(zip(("item_id", "cosine", "lcs", "answer"), h)) for h in x] for x in hits], dtype=object)

    return search


class Leaks:
    """A benchmark's blocks of items against documents: the counts and the latent space are made once, of ``docs``."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", verbatim: float = 0.75, reworded: float = 0.55, answer: float = 0.8, cosine: float = 0.3, min_words: int = 8, item_block: int = 1_024) -> None:
        self.text_col, self.limits, self.min_words = text_col, (verbatim, reworded, answer, cosine), min_words
        n = benchmark.count()
        self.blocks = -(-n // item_block)
        key = F.pmod(F.xxhash64(item_col, item_text_col), F.lit(max(1, self.blocks)))
        self.items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"), key.alias("b"))
        if self.blocks:
            self.df, total = document_frequencies(docs, text_col)
            self.space = latent_space(docs, text_col, self.df, total)

    def column(self, block: int) -> Column:
        """What a text has of a block's items: their ids, with cosine, LCS share and answer share. About ``item_block`` items are held."""
        rows = [(r.i, r.t) for r in self.items.where(F.col("b") == block).select("i", "t").collect()]
        return _searcher(self.space, Items(rows, self.space, self.df, self.min_words, self.limits[1]), *self.limits)(F.col(self.text_col))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer``: a row for each item found in a document."""
    found = Leaks(docs, benchmark, text_col, **params)
    out = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array().cast(_HIT)).alias("h")).select("doc_id", "h.*").where(F.lit(False))
    for block in range(found.blocks):
        hits = docs.select(F.col(id_col).alias("doc_id"), F.explode(found.column(block)).alias("h")).select("doc_id", "h.*")
        out = hits if found.blocks == 1 else out.union(cut(hits))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The documents in which no item is found."""
    found = Leaks(docs, benchmark, text_col, **params)
    for block in range(found.blocks):
        docs = docs.where(F.size(found.column(block)) == 0)
        docs = docs if block + 1 == found.blocks else cut(docs)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
