"""Versioned tables and the streams that fill them: readers at any time, replayed batches, failures and restarts."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import incremental
from millrace.sources import versions as V
from millrace.streaming import rebuilds as B


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_reader_never_sees_a_missing_or_mixed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda n: spark.range(200).select("id", F.lit(n).alias("version")).repartition(4)
    V.publish(make(0), path)
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append(tuple(V.read(spark, path).agg(F.count("*"), F.min("version"), F.max("version")).first()))

    reader = threading.Thread(target=watch)
    reader.start()
    for n in range(1, 6):
        V.publish(make(n), path, keep=50)
    stop.set()
    reader.join()
    assert seen and all(n == 200 and low == high for n, low, high in seen)
    old = V.current(spark, path)
    V.publish(make(9), path)
    assert V.read(spark, path, old).first()["version"] == 5  # kept for readers that have resolved it
    V.publish(make(10), path)
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 2 and len(os.listdir(f"{path}/_log")) - sum(f.endswith(".crc") for f in os.listdir(f"{path}/_log")) == 2


def test_a_change_rests_on_the_version_it_read(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        V.read(spark, path)
    V.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), path, ["k"], ["v"])
    seen = V.current(spark, path)
    V.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), path, ["k"], ["v"])
    assert rows(V.read(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(V.Conflict):
        V.publish(spark.createDataFrame([(9, "z")], "k long, v string"), path, after=seen)
    assert rows(V.read(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]


def test_counts_come_from_the_write(spark, tmp_path):
    path = str(tmp_path / "t")
    target = spark.createDataFrame([(1, "x", 5), (2, "x", 6)], "a long, b string, n int")
    source = spark.createDataFrame([(1, "x", 7), (3, "x", 9), (3, "x", 8), (4, "y", None)], "a long, b string, n int")
    V.publish(target, path)
    report = incremental.sync_report(source, target, ["a", "b"]).first().asDict()
    counts = V.insert_missing(source, path, ["a", "b"])
    assert counts == {**report, "inserted": 2}
    assert sorted(map(str, V.read(spark, path).collect())) == sorted(map(str, target.union(spark.createDataFrame([(3, "x", 8), (4, "y", None)], target.schema)).collect()))
    assert V.insert_missing(source, path, ["a", "b"]) == {"scanned": 4, "missing": 0, "duplicates": 0, "inserted": 0}
    assert V.insert_missing(source.limit(0), str(tmp_path / "new"), ["a", "b"])["scanned"] == 0


class Stream:
    """A folder of marks and a stream of rebuilds over it, which can be made to fail and to forget its last commit."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.fail, self.built = spark, folder, False, []

    def mark(self, *pairs):
        self.spark.createDataFrame(pairs, "key long, generation long").coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def rebuild(self, todo):
        if self.fail:
            raise RuntimeError("lost")
        self.built.append(sorted(map(tuple, todo.collect())))
        return todo.withColumn("value", F.col("key") * 10)

    def run(self):
        marks = self.spark.readStream.schema("key long, generation long").parquet(f"{self.folder}/in")
        query = B.rebuild_dirty(marks, f"{self.folder}/table", self.rebuild).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def forget(self):
        """As if the process had ended between the table's commit and the stream's own."""
        commits = f"{self.folder}/checkpoint/commits"
        last = max(int(f) for f in os.listdir(commits) if f.isdigit())
        for name in (str(last), f".{last}.crc"):
            if os.path.exists(f"{commits}/{name}"):
                os.remove(f"{commits}/{name}")


def test_restarts_build_nothing_twice_and_lose_no_mark(spark, tmp_path):
    s = Stream(spark, str(tmp_path))
    s.mark((1, 1), (1, 2), (2, 1))
    s.run()
    assert s.built == [[(1, 2), (2, 1)]]  # many marks of a key are one rebuild
    s.mark((1, 2), (2, 5), (3, 1))
    s.fail = True
    with pytest.raises(Exception):
        s.run()
    assert rows(V.read(spark, f"{tmp_path}/table")) == [(1, 2, 10), (2, 1, 20)]
    s.fail = False
    s.run()
    assert s.built[1:] == [[(2, 5), (3, 1)]]  # (1, 2) is built already
    s.forget()
    s.run()
    assert len(s.built) == 2  # the batch is played again under its number and adds nothing
    s.mark((3, 2))
    s.run()
    assert s.built[2:] == [[(3, 2)]]
    assert rows(V.read(spark, f"{tmp_path}/table")) == [(1, 2, 10), (2, 1, 20), (2, 5, 20), (3, 1, 30), (3, 2, 30)]
    assert rows(B.latest(V.read(spark, f"{tmp_path}/table"))) == [(1, 2, 10), (2, 5, 20), (3, 2, 30)]


def test_a_mark_raised_during_the_rebuild_survives(spark, tmp_path):
    s = Stream(spark, str(tmp_path))
    plain = s.rebuild

    def raising(todo):
        if len(s.built) == 0:
            s.mark((1, 2))  # comes in while generation 1 is built
        return plain(todo)

    s.rebuild = raising
    s.mark((1, 1))
    s.run()
    s.run()
    assert s.built == [[(1, 1)], [(1, 2)]]


def test_new_rows_above_the_mark(spark, tmp_path):
    schema = "platform string, id long"
    for part in ([("a", 1), ("a", 2), ("b", 7)], [("a", 2), ("a", 3), ("b", 5), ("c", 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = B.append_new(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", ["platform"], "id")
        stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert rows(V.read(spark, f"{tmp_path}/table")) == [("a", 1), ("a", 2), ("a", 3), ("b", 7), ("c", 1)]
