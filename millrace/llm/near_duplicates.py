"""Near duplicates by b-bit MinHash: bands of minima give candidates, packed low bits of the minima estimate their
similarity (corrected for chance agreement), and full shingle sets confirm every link.

Equal sets are one class from the start, named by a 64-bit digest of the set. In a band's bucket each class is first
compared with the bucket's smallest class only, its hub; what that links is joined in a few rounds, and classes of one
bucket that are still apart are compared in tiles of bounded bytes: by bit counts over the packed signatures, then by their
sets. A tile passes on the links that join something within it, so neither the many pairs of a bucket which resemble each
other but miss the threshold nor those of a large group of near copies leave the task. Pairs with a hub are confirmed on
full sets in groups around it: its set is sent once to each group, and large groups are split. A last run of rounds gives the components of all links: those that share a band. A pair at
the threshold shares one of the 32 bands of 4 minima but for odds of 5e-8.

Rows are what is compared: a row's key is a hash of id and text, so two texts of one id are two documents, each with its own
component, and the smallest id of a component names it.

Edge cases: null, empty and wordless texts have no shingles and are linked with nothing; fewer words than the width give
one shingle; repeated rows are in one component and are all ``kept`` if theirs is the smallest id (``one_of_each`` leaves one
row); rows with a null id are linked like others, but never name a component that has an id, and are kept only where no
row of the component has one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read

BANDS, ROWS, LOW_BITS = 32, 4, 2
HASHES = BANDS * ROWS
WORDS = HASHES * LOW_BITS // 64  # 64-bit words of a packed signature
TILE, TILE_BYTES = 4096, 8 << 20  # classes, and bytes of their sets
GROUP = 500  # pairs of one class that are confirmed together
_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)
_FOLD = _rng.integers(1, 1 << 62, 16, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_PART = 512
_room = np.empty((_PART, HASHES), np.uint32)


class _Hashes(dict):
    """Word -> 64-bit hash, remembered; emptied beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    key = np.full(n, width, np.uint64)
    for i in range(width):
        key = _mix(key ^ (h[i : i + n] * _FOLD[i % 16]))
    return np.unique(key)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions (multiply-add of 32 bits) over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), _PART):
        part = x[a : a + _PART, None]
        room = _room[: len(part)]
        np.multiply(part, _MUL, out=room)
        np.add(room, _ADD, out=room)
        np.minimum(out, room.min(0), out=out)
    return out.astype(np.uint64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima (mixed once more) in 64-bit words."""
    low = (_mix(m) & np.uint64((1 << LOW_BITS) - 1)).reshape(WORDS, -1)
    return (low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(LOW_BITS))).sum(1, dtype=np.uint64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (last axis: words): P(low bits agree) = J + (1 - J) / 2^b."""
    x = a ^ b
    odd = np.uint64(0x5555555555555555)
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(-1, dtype=np.int64)
    chance = 1 / (1 << LOW_BITS)
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


def _band_keys(m: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key ^ (m.reshape(BANDS, ROWS)[:, r] * _FOLD[r]))
    return key.view(np.int64)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, row_key, n_shingles, cls, bands, sig`` of each row; ``cls`` names its shingle set and is null for none."""

    @F.pandas_udf("n_shingles long, cls long, bands array<long>, sig binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                s = shingles(text, width)
                if len(s):
                    m = minima(s)
                    rows.append((len(s), xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), _band_keys(m), packed(m).tobytes()))
                else:
                    rows.append((0, None, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "cls", "bands", "sig"]).astype({"cls": "Int64"})

    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), sign(F.col(text_col)).alias("s")).select("id", "row_key", "s.*")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold. Pairs are grouped by ``a``, in parts of about GROUP: its
    set is sent once to each part, every partner's set once to its pair, so no set is copied along with a popular key."""
    sized = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")))  # read anew, so that the join can split a popular class
    heads = sized.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    others = pairs.join(sized, "a").select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    dealt = heads.union(others).join(sets, "cls").select("a", "part", "b", "set").repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.zeros(0, np.uint64)  # the set of the group that is read, which may go on in the next batch
        for batch in batches:
            found: list[tuple[int, int]] = []
            a, b, sets_ = batch["a"].to_numpy(), batch["b"].to_numpy(), [np.frombuffer(x, np.uint64) for x in batch["set"]]
            first = np.flatnonzero(a == b)
            for lo, hi in zip([0, *first.tolist()], [*first.tolist(), len(batch)]):
                if lo in first:
                    head, lo = sets_[lo], lo + 1
                if lo < hi:
                    size = np.array([len(x) for x in sets_[lo:hi]])
                    flat = np.concatenate(sets_[lo:hi])
                    at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
                    both = np.add.reduceat((head[at] == flat).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
                    good = 100 * both >= percent * (size + len(head) - both)
                    found += [(int(a[lo]), int(x)) for x in b[lo:hi][good]]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(compare, "a long, b long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, comp`` for every id in the links (a, b): the smallest id reachable, by alternating large and small stars. With
    ``rounds``, what so many rounds join: ids with one ``comp`` are linked, but not all that are linked have one."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, done = None, 0
    while rounds is None or done < rounds:
        # large star: the larger neighbours of every node point to its smallest neighbour
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        edges = cut(small)
        done += 1
        if rounds is None:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, slack: float = 0.22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row_key, n_shingles, component, component_id, kept`` of every row. ``slack`` is how far below the threshold an
    estimate may lie and still be confirmed on the full sets (five standard errors)."""
    floor = percent / 100 - slack
    rows = cut(signatures(docs, width, id_col, text_col))
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("least"), F.min("row_key").alias("at"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = cut(classes)
    sigs = classes.select("cls", "size", "sig")
    banded = classes.select("cls", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("hub")).where("n > 1")
    shared = cut(shared)  # read anew, so that the join can split a popular bucket
    members = cut(banded.join(shared, "key").select("key", "hub", "cls"))  # classes that share a band with another

    @F.pandas_udf("binary")
    def as_set(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in texts])

    # the texts move once; copies of a row meet map-side, and of a class only one row is wanted
    texts = docs.select(row_key(id_col, text_col).alias("at"), F.col(text_col).alias("t")).groupBy("at").agg(F.first("t").alias("t"))
    wanted = classes.select("cls", "at").join(members.select("cls").distinct(), "cls", "left_semi")
    sets = cut(texts.join(wanted.hint("merge"), "at").select("cls", as_set("t").alias("set")))  # as many as the corpus has: never broadcast

    stars = members.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    stars = stars.join(sigs.toDF("a", "na", "sa"), "a").join(sigs.toDF("b", "nb", "sb"), "b").where(_alike("na", "nb", percent) & _close(floor)("sa", "sb")).select("a", "b")
    links = cut(confirmed(cut(stars), sets, percent))
    comp = components(links, rounds=2)

    # classes of a bucket that are still apart
    placed = members.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).join(sigs, "cls")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("lo < hi")
    mixed = mixed.select("key", F.ceil(F.greatest(F.col("n") / TILE, 8 * F.col("bytes") / TILE_BYTES)).cast("int").alias("tiles"))
    links = links.union(_across(placed.select("key", "cls", "comp", "size", "sig").join(mixed, "key"), sets, floor, percent))
    comp = components(links)

    named = classes.select("cls", "least").join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    place = named.join(least, "comp").select("cls", F.col("comp").alias("component"), "component_id")
    out = rows.select("id", "row_key", "n_shingles", "cls").join(place, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select("id", "row_key", "n_shingles", "component", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of every component: of the smallest id (nulls last), then of the smallest row key;
    among rows equal in both, the one whose columns hash lowest."""
    rows = cut(near_duplicates(docs, width, percent, id_col=id_col, text_col=text_col).where("component IS NOT NULL").groupBy("component", "row_key").agg(F.count("*").alias("n"), F.min("id").alias("id")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("best"), F.sum("n").alias("total")).where("total > 1")
    best = cut(best)  # read anew, so that the join can split a large component
    marked = rows.join(best, "component").select(F.col("row_key").alias("__key"), (F.col("row_key") == F.col("best.row_key")).alias("__best"), "n").where("NOT __best OR n > 1").drop("n")
    marked = cut(marked)
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    if marked.where("__best").isEmpty():
        return keyed.join(marked, "__key", "left_anti").select(docs.columns)
    joined = keyed.join(marked, "__key", "left")
    whole = F.struct(*docs.columns)
    single = joined.where("__best").groupBy("__key").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return joined.where("__best IS NULL").select(docs.columns).union(single)


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can meet the threshold at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _close(floor: float):
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(c), np.uint64).reshape(-1, WORDS) for c in (a, b))
        return pd.Series(agreement(x, y) >= floor)

    return close


def _across(placed: DataFrame, sets: DataFrame, floor: float, percent: int) -> DataFrame:
    """Links (a < b) of one bucket (``key, cls, comp, size, sig, tiles``) that join its components. A bucket is dealt into
    tiles, and each pair of tiles is one group."""
    dealt = placed.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j"))))
    dealt = dealt.join(sets, "cls").withColumn("p", pairs).select("key", "p.i", "p.j", "tile", "cls", "comp", "size", "sig", "set")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(_compare(floor, percent), "a long, b long").distinct()


def _compare(floor: float, percent: int, block_rows: int = 8_000, block_bytes: int = 32 << 20, most_pairs: int = 400_000):
    def run(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """All groups of a block: the pairs of small groups are laid out together."""
        comp, tile, cls, size = (df[c].to_numpy() for c in ("comp", "tile", "cls", "size"))
        sig = np.frombuffer(b"".join(df["sig"]), np.uint64).reshape(-1, WORDS)
        sets = df["set"].tolist()
        cross = (df["i"] != df["j"]).to_numpy()
        keys = df[["key", "i", "j"]].to_numpy()
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(df)]
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        held = 0

        up: dict[int, int] = {}  # components that the block has joined

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        def flush() -> pd.DataFrame:
            x, y = np.concatenate(left), np.concatenate(right)
            good = (comp[x] != comp[y]) & (~cross[x] | (tile[x] != tile[y]))
            good &= 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
            x, y = x[good], y[good]
            good = agreement(sig[x], sig[y]) >= floor
            x, y = x[good], y[good]
            found = []
            for p, q in zip(x.tolist(), y.tolist()):
                u, v = top(comp[p]), top(comp[q])
                if u != v:
                    both = np.concatenate([np.frombuffer(sets[p], np.uint64), np.frombuffer(sets[q], np.uint64)])
                    total = len(both)
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= percent * (total - same):
                        up[max(u, v)] = min(u, v)
                        found.append((min(cls[p], cls[q]), max(cls[p], cls[q])))
            left.clear()
            right.clear()
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if comp[s:e].min() == comp[s:e].max():
                continue
            if e - s <= 128:
                x, y = _triangle(e - s)
                left.append(x + s)
                right.append(y + s)
                held += len(x)
                if held > most_pairs:
                    yield flush()
                    held = 0
                continue
            for k in range(s, e - 1):
                left.append(np.full(e - k - 1, k))
                right.append(np.arange(k + 1, e))
                held += e - k - 1
                if held > most_pairs:
                    yield flush()
                    held = 0
        if left:
            yield flush()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        rows = size = 0
        for batch in batches:
            if not len(batch):
                continue
            kept.append(batch)
            rows += len(batch)
            size += int(batch["set"].map(len).sum())
            if rows >= block_rows or size >= block_bytes:
                df = pd.concat(kept, ignore_index=True)
                last = (df[["key", "i", "j"]] == df[["key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()  # this group may go on
                kept, rows, size = [df[last]], int(last.sum()), int(df["set"][last].map(len).sum())
                if not last.all():
                    yield from run(df[~last].reset_index(drop=True))
        if rows:
            yield from run(pd.concat(kept, ignore_index=True))

    return search


_triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _triangles:
        _triangles[n] = np.triu_indices(n, 1)
    return _triangles[n]


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(read(spark, sf_dir, "documents"), width=4)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLES: dict[str, str] = {}
