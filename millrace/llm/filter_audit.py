"""Which of several quality filters remove what, in every order in which they can be applied.

The words of the texts are held as a sparse document-term matrix. Each task encodes a few megabytes of texts with a
dictionary of its own, its words in the order of their hashes, and writes them as one CSR shard. The global dictionary is
dealt into buckets of hashes, as many as an estimate of all distinct words asks for: a shard sends each bucket its words as
one packed row and gets their numbers back in the same order, so its columns become global terms. A row's sum is its
document's number of words, its number of nonzero entries the number of distinct words: these decide filters A and B.
C (upper-case letters) and D (symbols) are marked while a text is read, E (an equal text with a smaller id) comes from a
digest of 128 bits. A document then is five bits, and all orders are worked out from the counts of each source's bit sets.

Edge cases: null texts count as empty ones and equal them; an empty text has no words, so it fails A and passes B, C and D;
texts of any length are read whole, as one row of a shard; repeated rows have one id, which isn't smaller than itself, so
E spares them; rows with a null id never fail E by their own id and are nobody's smaller id; a null source is the part ''
(as an empty one); a document with several labels is good (toxic) if one of them says so; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read

FILTERS = "ABCDE"
SHARD_BYTES = 4 << 20  # of text in a shard, about
BUCKET_WORDS = 1 << 16  # distinct words in a bucket of the dictionary, about
SKETCH = 1024
_SIGN = np.uint64(1 << 63)
_UPPER, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SYMBOL[list(b"#$%&*|")] = True


def _encode(shard: int, ids: list, parts: list, raws: list[bytes]) -> tuple:
    """One CSR shard: a row per text, columns by the shard's own dictionary, and the texts' marks and digests."""
    known: dict[bytes, int] = {}
    rows = [Counter(raw.split()) for raw in raws]
    columns = np.fromiter((known.setdefault(w, len(known)) for row in rows for w in row), np.int64)
    counts = np.fromiter(chain.from_iterable(row.values() for row in rows), np.int64)
    indptr = np.r_[0, np.cumsum([len(row) for row in rows])].astype(np.int64)
    hashes = _hashes(list(known))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    words = list(known)
    marks = np.zeros(len(raws), np.uint8)
    for i, raw in enumerate(raws):
        b = np.frombuffer(raw, np.uint8)
        points = len(b) - int(((b & 0xC0) == 0x80).sum())
        marks[i] = 4 * (100 * int(_UPPER[b].sum()) > 2 * points) + 8 * bool(_SYMBOL[b].any())
    digests = [hashlib.blake2b(raw, digest_size=16).digest() for raw in raws]
    width = np.min_scalar_type(max(len(known), 1))
    size = np.min_scalar_type(int(counts.max(initial=1)))
    least = (np.unique(hashes)[:SKETCH] ^ _SIGN).view(np.int64)  # in the order of signed numbers
    return shard, ids, parts, digests, marks.tobytes(), indptr.tobytes(), width.str, place[columns].astype(width).tobytes(), size.str, counts.astype(size).tobytes(), b" ".join([words[i] for i in order.tolist()]), least


_SHARD = "shard long, ids array<string>, parts array<string>, digests array<binary>, marks binary, indptr binary, width string, indices binary, size string, counts binary"


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def local_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """CSR shards of whole texts, each with a dictionary of its own (``words``, joined by spaces in the order of its
    columns, which is that of their hashes) and its ``sketch``, the least hashes."""
    schema = _SHARD + ", words binary, sketch array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list = []
        raws: list[bytes] = []
        held = 0
        for batch in batches:
            for key, part, text in zip(batch["id"], batch["part"], batch["text"]):
                ids.append(key)
                parts.append(part)
                raws.append(text.encode("utf-8", "surrogatepass"))
                held += len(raws[-1]) + 64
                if held >= SHARD_BYTES:
                    yield pd.DataFrame([_encode(shard, ids, parts, raws)], columns=names)
                    shard, ids, parts, raws, held = shard + 1, [], [], [], 0
        if raws:
            yield pd.DataFrame([_encode(shard, ids, parts, raws)], columns=names)

    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInPandas(run, schema)


def distinct_words(shards: DataFrame) -> int:
    """About how many distinct words all shards have, from the SKETCH least hashes (some 3 % off)."""
    least = shards.select(F.explode("sketch").alias("h")).distinct().orderBy("h").limit(SKETCH).agg(F.count("*").alias("n"), F.max("h").alias("h")).first()
    if least["n"] < SKETCH:
        return least["n"]
    return int((SKETCH - 1) * 2.0**64 / (least["h"] + 2.0**63))


def term_numbers(shards: DataFrame, buckets: int) -> DataFrame:
    """``shard, bucket, numbers, first, fresh``: the numbers of a shard's words inside each bucket of hashes, in the shard's
    order; ``fresh`` are the words that got their numbers here, counted on from ``first``. A bucket holds its own distinct
    words only. The term of number n in bucket b is n * buckets + b."""
    bound = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, packed in zip(batch["shard"], batch["words"]):
                words = packed.split(b" ") if packed else []
                ends = [0, *np.searchsorted(_hashes(words), bound).tolist(), len(words)]
                rows = [(shard, b, b" ".join(words[s:e])) for b, (s, e) in enumerate(zip(ends, ends[1:])) if s < e]
                yield pd.DataFrame(rows, columns=["shard", "bucket", "words"])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, {}
        for batch in batches:
            rows = []
            for shard, bucket, packed in batch.itertuples(index=False, name=None):
                if bucket != at:
                    at, known = bucket, {}
                first = len(known)
                words = packed.split(b" ")
                numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
                fresh = b" ".join([w for w, n in zip(words, (numbers >= first).tolist()) if n])
                rows.append((shard, bucket, numbers.astype(np.min_scalar_type(len(known))), first, fresh))
            out = pd.DataFrame(rows, columns=["shard", "bucket", "numbers", "first", "fresh"])
            out["width"] = [n.dtype.str for n in out["numbers"]]
            out["numbers"] = [n.tobytes() for n in out["numbers"]]
            yield out

    dealt = shards.select("shard", "words").mapInPandas(deal, "shard long, bucket int, words binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInPandas(number, "shard long, bucket int, numbers binary, first long, fresh binary, width string")


def dictionary(numbers: DataFrame, buckets: int) -> DataFrame:
    """``word, term`` of all terms."""
    fresh = numbers.where(F.length("fresh") > 0).select("bucket", "first", F.posexplode(F.split(F.decode("fresh", "UTF-8"), " ")).alias("n", "word"))
    return fresh.select("word", ((F.col("first") + F.col("n")) * buckets + F.col("bucket")).alias("term"))


def term_matrix(shards: DataFrame, numbers: DataFrame, buckets: int, statistics: bool = False) -> DataFrame:
    """The CSR shards with global columns, in order within a row; or, without leaving the task, ``row_statistics`` of them."""
    listed = numbers.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "width", "numbers"))).alias("numbers"))
    columns = _SHARD.split(", ")
    names = [c.split()[0] for c in columns]

    def globally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[[i]].copy()
                local = np.frombuffer(row["indices"].iat[0], row["width"].iat[0])
                indptr = np.frombuffer(row["indptr"].iat[0], np.int64)
                counts = np.frombuffer(row["counts"].iat[0], row["size"].iat[0])
                found = row["numbers"].iat[0]
                terms = [np.frombuffer(x["numbers"], x["width"]).astype(np.int64) * buckets + x["bucket"] for x in (found if found is not None else [])]
                terms = np.concatenate([np.zeros(0, np.int64), *terms])[local]
                of = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
                order = np.lexsort((terms, of))
                width = np.min_scalar_type(int(terms.max(initial=0)))
                row["width"], row["indices"], row["counts"] = width.str, [terms[order].astype(width).tobytes()], [counts[order].tobytes()]
                yield row.drop(columns="numbers")

    joined = shards.select(names).join(listed, "shard", "left").select(*names, "numbers")  # a shard without words has no numbers
    if statistics:
        return joined.mapInPandas(lambda batches: _statistics(globally(batches)), _STATISTICS)
    return joined.mapInPandas(globally, _SHARD)


_STATISTICS = "id string, part string, digest binary, n_words long, n_distinct long, marks int"


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            indptr = np.frombuffer(row.indptr, np.int64)
            counts = np.frombuffer(row.counts, row.size).astype(np.int64)
            total = np.r_[0, np.cumsum(counts)][indptr]
            nonzero = np.r_[0, np.cumsum(counts > 0)][indptr]
            out = pd.DataFrame({"id": pd.Series(list(row.ids), dtype=object), "part": list(row.parts), "digest": list(row.digests)})
            out["n_words"], out["n_distinct"], out["marks"] = np.diff(total), np.diff(nonzero), np.frombuffer(row.marks, np.uint8).astype(np.int32)
            yield out


def row_statistics(matrix: DataFrame) -> DataFrame:
    """``id`` (as text)``, part, digest, n_words, n_distinct, marks`` of every document: sums and nonzero counts of the matrix's rows."""
    return matrix.mapInPandas(_statistics, _STATISTICS)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, n_words, n_distinct, failed`` of every document; bit i of ``failed`` is set if it fails FILTERS[i]."""
    shards = cut(local_shards(docs, id_col, text_col, part_col))
    buckets = -(-distinct_words(shards) // BUCKET_WORDS) or 1
    matrix = term_matrix(shards, term_numbers(shards, buckets).select("shard", "bucket", "width", "numbers"), buckets, statistics=True)
    rows = cut(matrix.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first)  # read anew, so that the join can split a popular text
    joined = rows.join(first, "digest", "left")
    bit = lambda test, value: F.when(test, value).otherwise(0)
    failed = bit(F.col("n_words") < 200, 1) + bit(100 * F.col("n_distinct") < 50 * F.col("n_words"), 2) + F.col("marks") + bit(F.col("id") > F.col("first"), 16)
    return joined.select("id", "part", "n_words", "n_distinct", failed.alias("failed"))


def _orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, f (the bit of the step's filter), before (the bits of the filters before it): 600 rows."""
    bits = {c: 1 << i for i, c in enumerate(FILTERS)}
    rows = [("".join(p), s + 1, bits[p[s]], sum(bits[c] for c in p[:s])) for p in permutations(FILTERS) for s in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, f int, before int")


def audit(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report of every part, order and step. Documents are counted by part, bits and labels first; what a step removes
    depends only on its filter and the set of those before it, so 80 sums a part serve all 600 rows."""
    n_filters = len(FILTERS)
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = failed.join(marked, "id", "left").groupBy("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))
    sets = [(1 << i, b) for i in range(n_filters) for b in range(1 << n_filters) if not b >> i & 1]
    spread = counts.withColumn("s", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("before")) for f, b in sets]))).select("*", "s.f", "s.before")
    fails = F.col("failed").bitwiseAND(F.col("f")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0
    orders = 1
    for k in range(2, n_filters + 1):
        orders *= k

    def total(test: Column, value: Column | None = None) -> Column:
        return F.sum(F.when(test, F.col("n") if value is None else value).otherwise(F.lit(0).cast("long")))

    sums = spread.groupBy("part", "f", "before").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("f")).alias("unique_fails"),
        total(fails & ~earlier & (F.col("good") == 1)).alias("good_lost"),
        total(fails & ~earlier & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(fails, F.col("n") * (F.lit(orders) / F.bit_count("failed")).cast("long")).alias("shapley"),
    )
    return sums.join(F.broadcast(_orders(failed.sparkSession)), ["f", "before"]).drop("f", "before")  # a table of fixed size


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = audit(failures(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))
    return report.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
b AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(e.doc_id > first, false)} AS x
  FROM e LEFT JOIN l ON e.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, (CASE WHEN x.A THEN 'A' ELSE '' END || CASE WHEN x.B THEN 'B' ELSE '' END || CASE WHEN x.C THEN 'C' ELSE '' END || CASE WHEN x.D THEN 'D' ELSE '' END || CASE WHEN x.E THEN 'E' ELSE '' END) AS fails FROM b),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM p),
q AS (
  SELECT c.*, filter_order, step, contains(fails, filter_order[step]) AS now, fails = filter_order[step] AS only_this,
         list_has_any(string_split(fails, ''), string_split(left(filter_order, step - 1), '')) AND fails <> '' AND step > 1 AS earlier FROM c, s)
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (NOT now AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT earlier), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (now AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails,
       coalesce(sum(n) FILTER (now AND NOT earlier AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (now AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(length(fails), 1)) FILTER (now), 0)::BIGINT AS shapley
FROM q GROUP BY part, filter_order, step
"""

QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {"op11_filter_audit": OP11_SQL}
