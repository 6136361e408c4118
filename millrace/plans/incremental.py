"""Queries for incremental work (T1-T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..sources import versions as V
from ..streaming import rebuilds as B
from .registry import query, table
from .sources import files_folder


@query("T1", """WITH t AS (SELECT event_type, max(event_id) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_type <> 'error' GROUP BY 1) SELECT event_id, e.event_type FROM events e LEFT JOIN t ON e.event_type = t.event_type WHERE m IS NULL OR event_id > m""")
def t1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return I.above_watermark(events, events.where("ts < timestamp'2024-01-20' AND event_type <> 'error'"), ["event_type"], "event_id").select("event_id", "event_type")


@query("T2", """SELECT conv_id, sha256(string_agg(sha256(coalesce(text, '')), '|' ORDER BY sha256(coalesce(text, '')))) AS fingerprint FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn >= 4) GROUP BY 1""")
def t2(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return I.changed(I.fingerprints(turns, "conv_id", "text"), I.fingerprints(turns.where("turn < 4"), "conv_id", "text"), "conv_id")


@query("T3", """WITH RECURSIVE v AS (SELECT user_id % 20 AS post, user_id AS viewer, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type IN ('view', 'click')),
r(post, viewer, n, last, c) AS (SELECT post, viewer, n, t, 1 FROM v WHERE n = 1 UNION ALL SELECT v.post, v.viewer, v.n, CASE WHEN t - last >= 43200000000 THEN t ELSE last END, c + CASE WHEN t - last >= 43200000000 THEN 1 ELSE 0 END FROM r JOIN v ON v.viewer = r.viewer AND v.n = r.n + 1)
SELECT post, viewer, max(c)::BIGINT AS counted, max(n) AS seen FROM r GROUP BY 1, 2""")
def t3(spark, sf_dir):
    views = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").select((F.col("user_id") % 20).alias("post"), F.col("user_id").alias("viewer"), "ts")
    return I.counted_views(views, ["post", "viewer"], "ts", minutes=720)


@query("T4", """WITH m AS (SELECT user_id AS key, max(event_id) AS generation FROM events GROUP BY 1), d AS (SELECT user_id AS key, max(event_id) AS done FROM events WHERE ts < TIMESTAMP '2024-01-30' AND user_id % 3 = 0 GROUP BY 1) SELECT m.key, generation FROM m LEFT JOIN d ON m.key = d.key WHERE done IS NULL OR generation > done""")
def t4(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("generation"), "ts")
    return I.dirty_keys(marks, marks.where("ts < timestamp'2024-01-30' AND key % 3 = 0"), "key", "generation")


def _pieces(spark, sf_dir):
    """The events in three pieces by id, each with the events of the one before once more, as a late export has them."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    ends = [low + (high - low) * i // 3 for i in range(3)] + [high]
    return [events.where((F.col("event_id") > (ends[max(0, i - 1)] if i else low - 1)) & (F.col("event_id") <= ends[i + 1])) for i in range(3)]


def _streamed(spark, pieces, start):
    """A stream over a folder that is started anew, on its checkpoint, for each piece that comes in; the table it fills."""
    folder = files_folder(spark)
    for piece in pieces:
        piece.write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(piece.schema).parquet(f"{folder}/in")
        start(rows, f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return V.read(spark, f"{folder}/table")


@query("T1b", "SELECT event_id, event_type FROM events")
def t1b(spark, sf_dir):
    return _streamed(spark, _pieces(spark, sf_dir), lambda rows, path: B.append_new(rows, path, ["event_type"], "event_id")).select("event_id", "event_type")


@query("T4b", "SELECT user_id AS key, max(event_id) AS generation, count(*) AS n FROM events GROUP BY 1")
def t4b(spark, sf_dir):
    """Every change of a user marks it; what is built is the number of its events."""
    sizes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    marks = [p.select(F.col("user_id").alias("key"), F.col("event_id").alias("generation")) for p in _pieces(spark, sf_dir)]
    built = _streamed(spark, marks, lambda rows, path: B.rebuild_dirty(rows, path, lambda todo: todo.join(sizes, "key")))
    return B.latest(built).select("key", "generation", "n")


@query("T5", "SELECT p_partkey FROM part WHERE p_partkey % 7 = 0")
def t5(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    stored = part.withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    results = stored.select("p_partkey", F.md5(F.to_json(F.struct("p_brand", "p_size")).cast("binary")).alias("fingerprint"))
    return I.stale_results(results, part, "p_partkey", ["p_size", "p_brand"])


@query("T6", """WITH a AS (SELECT user_id % 40 AS post, user_id, arg_max(CASE WHEN event_type IN ('view', 'purchase') THEN 'like' ELSE 'unlike' END, ts::TIMESTAMP) AS act FROM events GROUP BY 1, 2) SELECT post, count(*) FILTER (act = 'like') AS likes FROM a GROUP BY 1""")
def t6(spark, sf_dir):
    action = F.when(F.col("event_type").isin("view", "purchase"), "like").otherwise("unlike")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("post"), "user_id", "ts", "event_id", action.alias("action"))
    return I.like_counts(rows, "post", "user_id", "action", ["ts", "event_id"])
