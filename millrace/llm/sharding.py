"""Shards by proportional stratified interleaving: rows are ranked in a seeded order inside each source, sorted by their
fractional rank, and cut into equal runs, so that every shard holds the sources in the corpus' own shares.

No window ever holds a whole source: ranks come from row numbers inside small hash buckets plus the summed counts of the
buckets before them, first per source, then over all rows. Law: ``rows`` (shard counts differ by one at most).

Edge cases: a null or empty text has size ``row_bytes`` and crc32 0 for an empty text (null: 0); a null source is a source
of its own, sorted last; equal rows (of one id, source and text) are numbered, and each has a place of its own in the order,
so that a million of them meet in no one bucket; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, read


def _offsets(counts: DataFrame, part: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket of a part (of all rows, if ``part`` is empty), from its count ``n``: buckets are summed in two
    steps, within ranges of 1,024 buckets and over the ranges."""
    counts = counts.withColumn("block", F.floor(F.col(bucket) / 1024))
    inside = counts.withColumn("inside", F.sum("n").over(Window.partitionBy(*part, "block").orderBy(bucket)) - F.col("n"))
    blocks = counts.groupBy(*part, "block").agg(F.sum("n").alias("bn"))
    blocks = blocks.withColumn("outside", F.sum("bn").over(Window.partitionBy(*part).orderBy("block")) - F.col("bn"))
    return inside.join(blocks.drop("bn"), [*part, "block"]).select(*part, bucket, (F.col("inside") + F.col("outside")).alias("before"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows counted map-side and laid out again with their numbers (``tie``), a thousand to a row that is dealt out."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("c"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / 1000))))
    last = F.least(F.col("c") - 1, 1000 * F.col("block") + 999)
    return blocks.withColumn("tie", F.explode(F.sequence(1000 * F.col("block"), last))).drop("c", "block")


def interleaved_shards(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_bytes: int = 8, rows_per_bucket: int = 2000, tie_col: str | None = None) -> DataFrame:
    """``doc_id, source, size, text_crc32, tie, shard, slot`` for every row; buckets hold about ``rows_per_bucket`` rows each.
    ``tie_col``: a column that tells equal rows apart and comes back as ``tie``; without one they are numbered."""
    text = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_bytes).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        *([F.col(tie_col).alias("tie")] if tie_col else []),
    )
    rows = rows if tie_col else _numbered(rows)
    rows = rows.withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("tie")).bitwiseAND(F.lit((1 << 52) - 1)))
    rows = cut(rows)
    total = rows.count()
    buckets = max(1, -(-total // rows_per_bucket))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))  # null last
    width = -(-(1 << 52) // buckets)
    rows = rows.withColumn("skey", key).withColumn("bucket", F.floor(F.col("u") / F.lit(width)).cast("long"))
    per_bucket = rows.groupBy("skey", "bucket").agg(F.count("*").alias("n"))
    per_source = per_bucket.groupBy("skey").agg(F.sum("n").alias("in_source"))
    starts = _offsets(per_bucket, ["skey"], "bucket").join(per_source, "skey").select("skey", "bucket", "before", "in_source")
    inner = Window.partitionBy("skey", "bucket").orderBy("u", "doc_id", "text_crc32", "size", "tie")
    ranked = rows.withColumn("rn", F.row_number().over(inner)).join(starts, ["skey", "bucket"])
    ranked = ranked.withColumn("frac", (F.col("before") + F.col("rn") - F.lit(0.5)) / F.col("in_source"))
    ranked = cut(ranked.select("doc_id", "source", "skey", "size", "text_crc32", "tie", "u", "frac"))
    ranked = ranked.withColumn("pos_bucket", F.floor(F.col("frac") * buckets).cast("long"))
    offsets = _offsets(ranked.groupBy("pos_bucket").agg(F.count("*").alias("n")), [], "pos_bucket")
    order = Window.partitionBy("pos_bucket").orderBy("frac", "skey", "u", "doc_id", "text_crc32", "size", "tie")
    placed = ranked.withColumn("rn", F.row_number().over(order)).join(offsets, "pos_bucket").withColumn("pos", F.col("before") + F.col("rn") - 1)
    small, rest = divmod(total, shards)
    large = rest * (small + 1)  # the first shards hold one row more
    shard = F.when(F.col("pos") < large, F.floor(F.col("pos") / (small + 1))).otherwise(rest + F.floor((F.col("pos") - large) / max(small, 1)))
    slot = F.when(F.col("pos") < large, F.col("pos") % (small + 1)).otherwise((F.col("pos") - large) % max(small, 1))
    return placed.select("doc_id", "source", "size", "text_crc32", "tie", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleaved_shards(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
