"""Keyed incremental work: high-water marks, change detection, upserts, syncs, rolling view counts, dirty sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def above_watermark(rows: DataFrame, target: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Rows whose id is above the greatest one of their key in the target, all rows of keys it doesn't have."""
    marks = target.groupBy(*keys).agg(F.max(id_).alias("__mark"))
    return rows.join(marks, keys, "left").where(F.col("__mark").isNull() | (F.col(id_) > F.col("__mark"))).drop("__mark")


def fingerprints(children: DataFrame, parent: str, content: str) -> DataFrame:
    """A digest per parent over the sorted digests of all its children; digests of 32 bytes are gathered, not contents."""
    one = children.select(parent, F.sha2(F.coalesce(content, F.lit("")), 256).alias("__h"))
    return one.groupBy(parent).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("__h"))), 256).alias("fingerprint"))


def changed(current: DataFrame, known: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """Keys that are new or whose fingerprint differs from the known one."""
    return current.join(known.select(key, fingerprint), [key, fingerprint], "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], update: list[str], keep_when: str | None = None) -> DataFrame:
    """The target with the new rows' ``update`` columns where keys match (unless ``keep_when``, over target columns, holds)
    and new keys added. Both sides have the columns keys + update; of several new rows of a key the least counts, so no
    target row is multiplied."""
    t = target.select(*keys, F.struct(*update).alias("__t"), (F.expr(keep_when) if keep_when else F.lit(False)).alias("__keep"))
    n = new.groupBy(*keys).agg(F.min(F.struct(*update)).alias("__n"))
    row = F.when(F.col("__n").isNull() | F.coalesce("__keep", F.lit(False)), F.col("__t")).otherwise(F.col("__n"))
    return t.join(n, keys, "full").select(*keys, row.alias("__r")).select(*keys, "__r.*")


def missing_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target lacks, one per key (the least row): append them to the target."""
    columns = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__r")).select(*keys, "__r.*")
    return one.join(target.select(*keys).distinct(), keys, "left_anti")


def sync_report(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row: scanned, missing (keys) and duplicates inside the batch."""
    keyed = source.groupBy(*keys).agg(F.count("*").alias("n")).join(target.select(*keys).distinct().withColumn("__t", F.lit(True)), keys, "left")
    return keyed.agg(F.sum("n").alias("scanned"), F.count_if(F.col("__t").isNull()).alias("missing"), F.sum(F.when(F.col("__t").isNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"))


def counted_views(views: DataFrame, keys: list[str], at: str, minutes: int = 30) -> DataFrame:
    """``keys, counted, seen``: a view counts once per key per ``minutes`` since the last counted one. The times of one key
    (a viewer of a post) are gathered in order; the hot side, the post, is only part of the key."""
    gap = minutes * 60
    times = F.array_sort(F.collect_list(F.unix_micros(F.col(at).cast("timestamp"))))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, t: F.when(s["last"].isNull() | (t - s["last"] >= gap * 1_000_000), F.struct(t.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return views.groupBy(*keys).agg(F.aggregate(times, start, step)["n"].alias("counted"), F.count("*").alias("seen"))


def dirty_keys(marks: DataFrame, done: DataFrame, key: str, generation: str) -> DataFrame:
    """One mark per key, the greatest generation, unless a rebuild of that generation or a later one is done."""
    latest = marks.groupBy(key).agg(F.max(generation).alias(generation))
    built = done.groupBy(key).agg(F.max(generation).alias("__done"))
    return latest.join(built, key, "left").where(F.col("__done").isNull() | (F.col(generation) > F.col("__done"))).drop("__done")


def stale_results(results: DataFrame, dependencies: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Results whose stored dependency fingerprint differs from the current one (md5 over the sorted named values)."""
    now = dependencies.select(key, F.md5(F.to_json(F.struct(*sorted(parts))).cast("binary")).alias("current"))
    return results.join(now, key).where(~F.col("fingerprint").eqNullSafe(F.col("current"))).select(key)


def like_counts(events: DataFrame, post: str, user: str, action: str, order: list[str]) -> DataFrame:
    """Likes per post from each user's last action; never below zero."""
    last = events.groupBy(post, user).agg(F.max(F.struct(*order, action)).alias("m"))
    return last.groupBy(post).agg(F.count_if(F.col(f"m.{action}") == "like").alias("likes"))
