"""Streams into versioned tables: rebuilds of dirty keys, and new rows above what a table has.

A stream's checkpoint is its high-water mark: files that a finished batch has read aren't read again. A batch that failed, or
that ended before the checkpoint knew, is played again under its old number; the table's log names the last batch it took
in, with the rows and in the same step, so the second time adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.incremental import above_watermark, dirty_keys
from ..sources import versions


def rebuild_dirty(marks: DataFrame, path: str, rebuild: Callable[[DataFrame], DataFrame], name: str = "rebuild", key: str = "key", generation: str = "generation") -> DataStreamWriter:
    """A writer that, for each micro-batch of marks (key, generation), rebuilds each dirty key once: ``rebuild`` takes one
    row (key, generation) per key and returns rows that keep both columns, which are appended to the table. A key is
    clean if the table has rows of its generation or a later one, so many marks make one rebuild, and a mark that is raised
    while its key is being rebuilt has a higher generation and makes another one in a later batch. ``rebuild`` has to
    return a row for every key that it is given."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = versions.current(spark, path)
        if versions.taken_in(known, f"{name}:{number}"):
            return
        done = versions.read(spark, path, known).select(key, generation) if known.number else df.select(key, generation).limit(0)
        versions.append(rebuild(dirty_keys(df, done, key, generation)), path, known, f"{name}:{number}")

    return marks.writeStream.foreachBatch(batch)


def latest(rows: DataFrame, key: str = "key", generation: str = "generation") -> DataFrame:
    """The rows of each key's last generation."""
    last = rows.groupBy(key).agg(F.max(generation).alias(generation))
    return rows.join(last, [key, generation], "left_semi")


def append_new(rows: DataFrame, path: str, keys: list[str], id_: str, name: str = "append") -> DataStreamWriter:
    """A writer that appends each micro-batch's rows above the table's greatest id of their key (all of a key that it lacks)."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = versions.current(spark, path)
        if versions.taken_in(known, f"{name}:{number}"):
            return
        fresh = above_watermark(df, versions.read(spark, path, known), keys, id_) if known.number else df
        versions.append(fresh, path, known, f"{name}:{number}")

    return rows.writeStream.foreachBatch(batch)
