"""Tables in versions: data folders that never change, and a log whose last entry names those that make up the table.

An entry ``_log/<n>`` is written beside the log and takes its name by one rename, which fails where another writer took that
number first. A reader resolves the last entry and reads its folders; it sees one whole version, old or new, whenever it
comes. Entries name the micro-batches that a table has taken in, so a batch that is played again adds nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import upsert


class Conflict(OSError):
    """Another writer published a version since the one this change rests on."""


@dataclass(frozen=True)
class Version:
    number: int  # 0: nothing is published yet
    folders: tuple[str, ...] = ()
    batches: tuple[str, ...] = ()  # the last batch of every stream, "<stream>:<id>"
    schema: str | None = None


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    log = at(f"{path}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n) for n in names if n.isdigit())


def _entry(spark: SparkSession, path: str, number: int) -> Version:
    fs, at = _fs(spark, path)
    stream = fs.open(at(f"{path}/_log/{number}"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    return Version(number, tuple(found["folders"]), tuple(found["batches"]), found["schema"])


def current(spark: SparkSession, path: str) -> Version:
    numbers = _numbers(spark, path)
    return _entry(spark, path, numbers[-1]) if numbers else Version(0)


def read(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The table as of a version, the last one by default."""
    version = version or current(spark, path)
    if version.schema is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    schema = spark.createDataFrame([], version.schema).schema
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in version.folders])


def _commit(spark: SparkSession, path: str, version: Version) -> Version:
    fs, at = _fs(spark, path)
    target, draft = at(f"{path}/_log/{version.number}"), at(f"{path}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"folders": version.folders, "batches": version.batches, "schema": version.schema}).encode()))
    out.close()
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(draft, target):  # a rename doesn't replace a file on HDFS; the first look serves local disks
        fs.delete(draft, False)
        raise Conflict(f"version {version.number} of {path} is there already")
    return version


def _write(df: DataFrame, path: str) -> tuple[str, str]:
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def publish(df: DataFrame, path: str, after: Version | None = None, keep: int = 2) -> Version:
    """The whole table replaced by df. With ``after``, only if that is still the last version (else ``Conflict``). The last
    ``keep`` versions stay for readers that have resolved them; folders that only older ones name are deleted."""
    spark = df.sparkSession
    base = after or current(spark, path)
    folder, schema = _write(df, path)
    made = _commit(spark, path, Version(base.number + 1, (folder,), base.batches, schema))
    tidy(spark, path, keep)
    return made


def append(df: DataFrame, path: str, after: Version | None = None, batch: str | None = None) -> Version:
    """df's rows added as a folder of their own; nothing is rewritten. ``batch`` ("<stream>:<id>") is kept in the entry."""
    spark = df.sparkSession
    base = after or current(spark, path)
    folder, schema = _write(df, path)
    stream = batch.split(":")[0] if batch else None
    batches = tuple(b for b in base.batches if b.split(":")[0] != stream) + ((batch,) if batch else ())
    return _commit(spark, path, Version(base.number + 1, (*base.folders, folder), batches, base.schema or schema))


def taken_in(version: Version, batch: str) -> bool:
    """Whether a version holds this batch of a stream, or a later one."""
    stream, number = batch.split(":")
    return any(b.split(":")[0] == stream and int(b.split(":")[1]) >= int(number) for b in version.batches)


def tidy(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the entries before the last ``keep`` and the folders that only they name."""
    numbers = _numbers(spark, path)
    if len(numbers) <= keep:
        return
    fs, at = _fs(spark, path)
    wanted = {f for n in numbers[-keep:] for f in _entry(spark, path, n).folders}
    for n in numbers[:-keep]:
        gone = [f for f in _entry(spark, path, n).folders if f not in wanted]
        fs.delete(at(f"{path}/_log/{n}"), False)  # first, so that no entry names a folder that is gone
        for f in gone:
            fs.delete(at(f"{path}/{f}"), True)


def upsert_table(new: DataFrame, path: str, keys: list[str], update: list[str], keep_when: str | None = None) -> Version:
    """The upsert of the last version, published if no one else has published meanwhile."""
    spark = new.sparkSession
    base = current(spark, path)
    target = read(spark, path, base) if base.number else new.select(*keys, *update).limit(0)
    return publish(upsert(target, new, keys, update, keep_when), path, after=base)


def insert_missing(source: DataFrame, path: str, keys: list[str], batch: str | None = None) -> dict[str, int]:
    """Appends the source rows whose key the table lacks, one per key (the least row), and returns what the write itself has
    seen: rows scanned, keys missing, rows inserted, and rows of missing keys beyond the first."""
    spark = source.sparkSession
    base = current(spark, path)
    columns = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__r"), F.count("*").alias("__n"))
    target = read(spark, path, base).select(*keys).distinct() if base.number else source.select(*keys).limit(0)
    seen, put = Observation(), Observation()
    absent = F.col("__t").isNull()
    marked = one.join(target.withColumn("__t", F.lit(True)), keys, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    marked = marked.observe(seen, total("__n").alias("scanned"), F.count_if(absent).alias("missing"), total(F.when(absent, F.col("__n") - 1)).alias("duplicates"))
    rows = marked.where(absent).select(*keys, "__r.*").select(*source.columns).observe(put, F.count("*").alias("inserted"))
    append(rows, path, base, batch)
    return {**seen.get, **put.get}
