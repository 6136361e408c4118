"""Reading of CSV, JSON and platform tables; writing as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_of_group


def read_posts(spark: SparkSession, glob: str, columns: dict[str, str], id_: str) -> tuple[DataFrame, DataFrame]:
    """(posts, errors) of CSV files with a header, byte-order marks allowed: rows without a numeric id are errors; the first
    row of an id wins, over files by name and then lines; the source file is kept. Lines are compared by the place of their block
    in the file and their number in the task that reads it, so a file needs no single task unless it has texts of many lines."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(glob, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True)
    place = [F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line")]
    rows = rows.select("*", *place).withColumn(id_, F.regexp_replace(F.trim(id_), "^﻿", ""))
    good = F.coalesce(F.col(id_).rlike("^[0-9]{1,18}$"), F.lit(False))
    typed = rows.where(good).select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()], "source_file", "__block", "__line")
    return first_of_group(typed, [id_], [F.asc("source_file"), F.asc("__block"), F.asc("__line")]).drop("__block", "__line"), rows.where(~good).drop("__block", "__line")


_ITEMS = "items array<struct<item_id:string,brand:string,title:string,price:string,sold_text:string>>"


def read_items(spark: SparkSession, glob: str, batch: str, whole_files: bool = True) -> DataFrame:
    """Marketplace items of JSON files ``{items: [...]}``, one document per file or (not ``whole_files``) per line: broken files and items without id or title are skipped; each item
    has a fingerprint of its parts."""
    rows = spark.read.json(glob, multiLine=whole_files, schema=_ITEMS, mode="PERMISSIVE").select(F.explode("items").alias("i")).select("i.*")
    rows = rows.where("item_id IS NOT NULL AND trim(coalesce(title, '')) <> ''")
    parts = [F.coalesce(F.trim(c), F.lit("")) for c in ("item_id", "brand", "title", "price", "sold_text")]
    return rows.withColumn("batch", F.lit(batch)).withColumn("fingerprint", F.sha2(F.concat_ws("\n", *parts), 256))


def read_platforms(specs: list[tuple[DataFrame, str, dict[str, str]]], above: int = -1) -> DataFrame:
    """Rows of several platform tables under common names: (table, platform, common name -> own column). Ids above the
    mark and non-blank texts only; both filters reach the scans."""
    frames = []
    for df, platform, columns in specs:
        rows = df.select(F.lit(platform).alias("platform"), *[F.col(own).alias(name) for name, own in columns.items()])
        frames.append(rows.where((F.col("id") > above) & (F.trim("text") != "")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    df.withColumns(nested).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
