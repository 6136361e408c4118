"""Removal of every byte covered by a 200-byte string that also starts somewhere else, by suffix arrays of small blocks.

1. *Anchors.* The least 16-byte hash of every 200-byte window (rightmost on ties) is the window's anchor. It depends on the
   window's bytes alone, so equal windows have equal anchors, and an anchor serves a run of neighbouring windows: its
   *context*. About one byte in 92 is an anchor, so the corpus shuffles as anchors, not as suffixes.
2. Anchors that occur once are done. If all contexts of an anchor are equal, all their windows repeat.
3. *Suffix arrays.* Other contexts are fetched once each and cut into 25-byte blocks, counted from the anchor. The blocks of
   whole anchor groups form one integer string, whose suffix array is built by linear grouping construction: groups of
   suffixes with one Lyndon prefix are processed in descending order through previous-smaller pointers, then every group's
   order is emitted, without renaming and recursion. A repeated window covers seven whole blocks, so only suffixes that
   share seven with a neighbour in the array can start one; nine shared blocks prove a stretch of windows, and at the
   edges the windows' own bytes are compared.
4. An anchor with more than ``most_contexts`` distinct contexts (a passage that a large share of the corpus quotes amid
   different text) would make an unbounded group; its windows are counted by digest with map-side sums instead.

Edge cases: null and empty texts have no bytes (digest of the empty string); texts under 200 bytes lose nothing; texts of
any length are read in overlapping segments; equal rows are occurrences of their own and so repeat each other; rows
with a null id are documents like any other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read

LENGTH, GRAM, BLOCK = 200, 16, 25
SPAN = LENGTH - GRAM + 1  # grams in a window
SHARED = (LENGTH - BLOCK + 1) // BLOCK  # whole blocks that any window covers
SEGMENT = 1 << 20


# ------------------------------------------------------------------ suffix array
def grouping_suffix_array(s: np.ndarray) -> list[int]:
    """Suffix array of an integer string that ends in a unique least symbol, by linear grouping construction."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    first = np.r_[True, np.diff(s[sa]) != 0]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    link = np.empty(n, np.int64)
    link[sa] = begin
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    size = np.bincount(begin, minlength=n).tolist()
    sa, link, place = sa.tolist(), link.tolist(), place.tolist()
    prev = [-1] * n
    end = n
    while end > 0:  # groups from the highest down
        start = link[sa[end - 1]]
        smaller: dict[int, int] = {}
        for i in sa[start:end] if end - start == 1 else sorted(sa[start:end]):
            p = i - 1
            while p >= 0 and link[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                smaller[p] = smaller.get(p, 0) + 1
        end = start
        if len(smaller) > 1 and max(smaller.values()) > 1:
            by_count = defaultdict(list)
            for p, c in smaller.items():
                by_count[c].append(p)
            classes = [by_count[c] for c in sorted(by_count, reverse=True)]
        else:
            classes = [list(smaller)]
        for members in classes:  # those that the group extends most often come last in their own group
            moved: dict[int, int] = {}
            for p in members:
                g = link[p]
                if size[g] == 1:
                    continue
                k = moved.get(g, 0) + 1
                moved[g] = k
                at, tail = place[p], g + size[g] - k
                q = sa[tail]
                sa[at], sa[tail] = q, p
                place[q], place[p] = at, tail
            for g, k in moved.items():
                if k < size[g]:
                    new = g + size[g] - k
                    for t in range(new, new + k):
                        link[sa[t]] = new
                    size[g] -= k
                    size[new] = k
    out = [0] * n
    head = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = link[j]
            out[head[g]] = j
            head[g] += 1
            placed[j] = 1
            j = prev[j]
    return out


# ------------------------------------------------------------------ anchors
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(raw: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, context digest, first window, windows, bytes from the first window to the anchor) of a text of at least LENGTH bytes."""
    for seg in range(0, len(raw) - LENGTH + 1, SEGMENT):
        part = raw[seg : seg + SEGMENT + LENGTH - 1]
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(part, np.uint8), 8)).view(np.uint64).ravel()
        h = _mix(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + _mix(eight[8:]))
        mask = np.uint64((1 << 21) - 1)
        low = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPAN - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
        x = (mask - (low & mask)).astype(np.int64)
        starts = np.r_[0, np.flatnonzero(np.diff(x)) + 1]
        counts = np.diff(np.r_[starts, len(x)])
        keys = h[x[starts]].view(np.int64)
        for p, n, a, k in zip(starts.tolist(), counts.tolist(), x[starts].tolist(), keys.tolist()):
            yield k, xxhash.xxh3_64_intdigest(part[p : p + n + LENGTH - 1], a - p) - (1 << 63), seg + p, n, a - p


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["rid", "anchor", "ctx", "place"]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 4), columns=columns)

    for batch in batches:
        rows = []
        for rid, text in zip(batch["rid"], batch["text"]):
            rows += [(rid, k, c, p << 16 | n << 8 | left) for k, c, p, n, left in anchors(text.encode("utf-8", "surrogatepass"))]
            if len(rows) > 200_000:
                yield frame(rows)
                rows = []
        yield frame(rows)


# ------------------------------------------------------------------ contexts
def repeated_windows(group: list[int], left: list[int], count: list[int], text: list[bytes]) -> list[np.ndarray]:
    """For each distinct context (anchor, bytes before the anchor, occurrences, bytes): which of its windows repeat, among the given contexts."""
    found = [np.full(len(t) - LENGTH + 1, c > 1) for t, c in zip(text, count)]
    symbols: list[int] = []
    owner: list[int] = []
    first: list[int] = []
    for i, (g, l, t) in enumerate(zip(group, left, text)):
        lowest, highest = -(l // BLOCK), (len(t) - l) // BLOCK
        seeds = g & 0xFFFFFFFFFFFF
        symbols += [xxhash.xxh3_64_intdigest(t[l + BLOCK * b : l + BLOCK * b + BLOCK], seeds + (b << 48) & 0xFFFFFFFFFFFFFFFF) | 1 for b in range(lowest, highest)]
        symbols.append(0)
        owner += [i] * (highest - lowest + 1)
        first += [lowest, highest - lowest + 1]
    block_at = np.concatenate([np.arange(a, a + n) for a, n in zip(first[::2], first[1::2])]) if first else np.zeros(0, np.int64)
    s = np.unique(np.array(symbols, np.uint64), return_inverse=True)[1] + 1  # separators are 1
    s = np.r_[s, 0]
    sa = np.array(grouping_suffix_array(s))
    padded = np.r_[s, np.zeros(SHARED + 2, np.int64)]
    alike = np.ones(len(sa) - 1, bool)
    depth = np.zeros(len(sa) - 1, np.int64)
    for t in range(SHARED + 2):
        x = padded[sa[:-1] + t]
        alike &= (x == padded[sa[1:] + t]) & (x > 1)
        depth += alike
    common = np.zeros(len(s), np.int64)  # blocks shared with the better neighbour in the array
    np.maximum.at(common, sa[:-1], depth)
    np.maximum.at(common, sa[1:], depth)
    runs: dict[bytes, list[int]] = defaultdict(list)
    for at in np.flatnonzero(common >= SHARED).tolist():
        runs[s[at : at + SHARED].tobytes()].append(at)
    for members in runs.values():  # windows whose first whole block starts here: they may only repeat each other
        stretches, unsure = [], False
        for at in members:
            i, b = owner[at], int(block_at[at])
            lo, hi = max(0, left[i] + BLOCK * (b - 1) + 1), min(len(found[i]), left[i] + BLOCK * b + 1)
            if lo < hi and at and owner[at - 1] == i and common[at - 1] >= SHARED + 2:
                found[i][lo:hi] = True
            if lo < hi:
                stretches.append((i, lo, hi))
                unsure |= not found[i][lo:hi].all()
        if unsure:  # an edge: the windows' own bytes decide
            seen: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
            for i, lo, hi in stretches:
                for p in range(lo, hi):
                    seen[xxhash.xxh3_128_digest(text[i][p : p + LENGTH])].append((i, p))
            for places in seen.values():
                if len(places) > 1:
                    for i, p in places:
                        found[i][p] = True
    return found


def _hits(found: np.ndarray) -> list[int]:
    """Runs of true windows as start << 16 | end."""
    edge = np.flatnonzero(np.diff(np.r_[0, found.astype(np.int8), 0]))
    return [int(a) << 16 | int(b) for a, b in zip(edge[::2], edge[1::2])]


def _search(most_rows: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def run(df: pd.DataFrame) -> pd.DataFrame:
            found = repeated_windows(df["anchor"].tolist(), df["left"].tolist(), df["n"].tolist(), df["bytes"].tolist())
            return pd.DataFrame({"anchor": df["anchor"], "ctx": df["ctx"], "hits": [_hits(f) for f in found]})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows >= most_rows:
                df = pd.concat(held, ignore_index=True)
                whole = df["anchor"] != df["anchor"].iat[-1]  # the last group may go on
                held, rows = [df[~whole]], int((~whole).sum())
                if whole.any():
                    yield run(df[whole].reset_index(drop=True))
        if rows:
            yield run(pd.concat(held, ignore_index=True))

    return search


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, size = [], 0
        for text, wanted in zip(batch["text"], batch["wanted"]):
            raw = text.encode("utf-8", "surrogatepass")
            for a, c, n, place in np.array(wanted, np.int64).reshape(-1, 4).tolist():
                p, windows, left = place >> 16, place >> 8 & 255, place & 255
                rows.append((a, c, n, left, raw[p : p + windows + LENGTH - 1]))
                size += windows + LENGTH
                if size > 16_000_000:
                    yield pd.DataFrame(rows, columns=["anchor", "ctx", "n", "left", "bytes"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["anchor", "ctx", "n", "left", "bytes"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a, c, n, raw in zip(batch["anchor"], batch["ctx"], batch["n"], batch["bytes"]):
            k = len(raw) - LENGTH + 1
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[p : p + LENGTH]) for p in range(k)), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"anchor": a, "ctx": c, "n": n, "p": np.arange(k), "d1": d[:, 0], "d2": d[:, 1]})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = 20_000, block_rows: int = 20_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rid"))
    long_enough = rows.where(F.octet_length("text") >= LENGTH).select("rid", "text")

    found = long_enough.mapInPandas(_anchor_rows, "rid long, anchor long, ctx long, place long")
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1")
    shared = cut(shared)  # read anew, so that the join can split a popular anchor
    joined = cut(found.join(shared.select("anchor", (F.col("lo") == F.col("hi")).alias("equal")), "anchor"))
    windows = F.shiftright("place", 8).bitwiseAND(F.lit(255))
    pack = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    first = F.shiftright("place", 16)
    equal = joined.where("equal").select("rid", pack(first, first + windows + (LENGTH - 1)).alias("range"))

    mixed = joined.where("NOT equal")
    contexts = mixed.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("at"))
    large = cut(contexts.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > most_contexts).select("anchor"))
    wanted = contexts.groupBy(F.col("at.rid").alias("rid")).agg(F.flatten(F.collect_list(F.array("anchor", "ctx", "n", "at.place"))).alias("wanted"))
    fetched = wanted.join(long_enough, "rid").select("text", "wanted")
    fetched = fetched.mapInPandas(_fetch, "anchor long, ctx long, n long, left int, bytes binary")
    if large.isEmpty():
        small, many = fetched, None
    else:
        fetched = cut(fetched)
        small, many = fetched.join(large, "anchor", "left_anti"), fetched.join(large, "anchor", "left_semi")
    hits = small.repartition("anchor").sortWithinPartitions("anchor", "ctx").mapInPandas(_search(block_rows), "anchor long, ctx long, hits array<int>")
    hits = hits.select("anchor", "ctx", F.explode("hits").alias("hit"))
    hits = hits.select("anchor", "ctx", F.shiftright("hit", 16).alias("a"), F.col("hit").bitwiseAND(F.lit(65535)).alias("b"))
    if many is not None:
        grams = cut(many.dropDuplicates(["anchor", "ctx"]).mapInPandas(_digests, "anchor long, ctx long, n long, p int, d1 long, d2 long"))
        twice = grams.groupBy("d1", "d2").agg(F.sum("n").alias("total")).where("total > 1").select("d1", "d2")
        hits = hits.union(grams.join(twice, ["d1", "d2"]).select("anchor", "ctx", F.col("p").alias("a"), (F.col("p") + 1).alias("b")))
    hits = cut(hits.distinct())
    partial = mixed.join(hits, ["anchor", "ctx"]).select("rid", pack(first + F.col("a"), first + F.col("b") + (LENGTH - 1)).alias("range"))
    ranges = equal.union(partial).groupBy("rid").agg(F.collect_set("range").alias("ranges"))  # equal rows share a key: a set is bounded by the text

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    def strip(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, packed in zip(texts, spans):
            raw = text.encode("utf-8", "surrogatepass")
            kept, last, removed, n = [], 0, 0, 0
            if packed is not None and len(packed):
                every = np.sort(np.asarray(packed, np.int64))
                for a, b in zip((every >> 32).tolist(), (every & 0xFFFFFFFF).tolist()):
                    if n == 0 or a > last:
                        kept.append(raw[last:a])
                        n += 1
                        removed += b - a
                        last = b
                    elif b > last:
                        removed += b - last
                        last = b
            kept.append(raw[last:])
            left = b"".join(kept)
            out.append((len(raw), removed, n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    done = rows.join(ranges, "rid", "left")
    return done.select("doc_id", strip("text", "ranges").alias("r")).select("doc_id", "r.*")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
