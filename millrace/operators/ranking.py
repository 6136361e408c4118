"""Ranking, representatives, quotas, periods, rolling baselines."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def first_of_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that ends in a unique key. A map-side least struct would need every column
    to be orderable; a window spills and keeps any type."""
    return rank_in_group(df, group, order, "__r").where("__r = 1").drop("__r")


def top_of_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rank_in_group(df, group, order, "__r").where(F.col("__r") <= k).drop("__r")


def representatives(df: DataFrame, group: list[str], value: str, id_: str) -> DataFrame:
    """Highest value, then lowest id of each group, with the group's size; map-side, so hot groups cost nothing."""
    best = F.max(F.struct(F.col(value), (-F.col(id_)).alias("k")))
    return df.groupBy(*group).agg(best.alias("b"), F.count("*").alias("size")).select(*group, (-F.col("b.k")).alias(id_), F.col(f"b.{value}").alias(value), "size")


@F.pandas_udf(LongType())
def md5_modulo(keys: pd.Series, n: pd.Series) -> pd.Series:
    """The 128-bit md5 of a key modulo n."""
    return pd.Series([int(hashlib.md5((k or "").encode()).hexdigest(), 16) % int(m) if m else None for k, m in zip(keys, n)], dtype="Int64")


def canonical(df: DataFrame, group: list[str], order: list[Column], id_: str) -> DataFrame:
    """The group's canonical id (first in the order) and the sorted ids of all its rows."""
    first = first_of_group(df, group, order).select(*group, F.col(id_).alias("canonical"))
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(id_)).alias("ids")).join(first, group)


def roles(df: DataFrame, entity: str, kind: str, score: str, key: str) -> DataFrame:
    """Best profile: main; two best labels: assist; two greatest risks: risk; everything else: extra."""
    n = F.row_number().over(Window.partitionBy(entity, kind).orderBy(F.desc(score), key))
    role = F.when((F.col(kind) == "profile") & (n == 1), "main").when((F.col(kind) == "label") & (n <= 2), "assist").when((F.col(kind) == "risk") & (n <= 2), "risk").otherwise("extra")
    return df.withColumn("role", role)


def quota_top(fits: DataFrame, profile: str, order: list[Column], n: int) -> DataFrame:
    """n places dealt evenly to the profiles (the first ones get the rest), each filled from its own ranking. No profile gets
    over n, a constant, so every task ranks and passes on n rows of a profile at most before the exact quota is joined."""
    profiles = fits.select(profile).distinct().withColumn("__i", F.row_number().over(Window.orderBy(profile))).withColumn("__p", F.count("*").over(Window.partitionBy()))
    quota = profiles.select(profile, (F.floor(F.lit(n) / F.col("__p")) + (F.col("__i") <= F.lit(n) % F.col("__p")).cast("int")).alias("__q"))
    return rank_in_group(fits, [profile], order).where(F.col("rank") <= n).join(quota, profile).where(F.col("rank") <= F.col("__q")).drop("__q")


def fair_top(df: DataFrame, group: list[str], provider: str, order: list[Column], k: int) -> DataFrame:
    """The best row of each provider first, then the rest by rank, k rows per group."""
    own = F.row_number().over(Window.partitionBy(*group, provider).orderBy(*order))
    turned = df.withColumn("__own", own)
    return top_of_group(turned, group, [(F.col("__own") > 1).asc(), *order], k).drop("__own")


def periods(changes: DataFrame, key: list[str], value: str, at: str, tie: str) -> DataFrame:
    """Periods of an unchanged value: a row opens one only where the value differs from the row before."""
    w = Window.partitionBy(*key).orderBy(at, tie)
    opened = changes.withColumn("__before", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where(~F.col(value).eqNullSafe(F.col("__before")) | (F.col("__n") == 1))
    ended = F.lead(at).over(w)
    return opened.select(*key, value, F.col(at).alias("started_at"), ended.alias("ended_at"), ended.isNull().alias("is_current"))


def metric_deltas(old: DataFrame, new: DataFrame, keys: list[str], value: str, unit: str) -> DataFrame:
    """New minus old of the metrics both sides have in one unit, and whether they changed."""
    o = old.select(*keys, F.col(unit).alias("__u"), F.col(value).alias("old"))
    n = new.select(*keys, F.col(unit).alias("__v"), F.col(value).alias("new"))
    return n.join(o, keys).where(F.col("__u").eqNullSafe(F.col("__v"))).select(*keys, "old", "new", (F.col("new") - F.col("old")).alias("delta"), (~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def daily_values(readings: DataFrame, key: list[str], at: str, value: str, source: str, id_: str) -> tuple[DataFrame, DataFrame]:
    """(one value per key and day, conflicts): the latest reading of a day with one source; days with several sources."""
    days = readings.groupBy(*key, F.to_date(at).alias("day")).agg(F.countDistinct(source).alias("sources"), F.max(F.struct(at, id_, value)).alias("m"))
    return days.where("sources = 1").select(*key, "day", F.col(f"m.{value}").alias(value)), days.where("sources > 1").select(*key, "day", "sources")


def rolling_baseline(daily: DataFrame, key: list[str], day: str, value: str, days: int = 14, least: int = 5) -> DataFrame:
    """Median, least and greatest value and number of days over the days before each day; nulls under ``least`` days."""
    at = F.unix_date(F.col(day))
    w = Window.partitionBy(*key).orderBy(at).rangeBetween(-days, -1)
    enough = F.count(value).over(w) >= least
    out = daily.withColumn("n_days", F.count(value).over(w))
    for name, agg in (("median", F.percentile(value, 0.5)), ("least", F.min(value)), ("greatest", F.max(value))):
        out = out.withColumn(name, F.when(enough, agg.over(w)))
    return out.withColumn("change", F.when(F.col("median") > 0, (F.col(value) - F.col("median")) / F.col("median")))


def merge_candidates(df: DataFrame, key: list[str], quality: str, name: str, id_: str) -> DataFrame:
    """Per key the best candidate by quality, then the longer name; the union of ids and names; the count."""
    best = F.max(F.struct(F.col(quality), F.length(name).alias("l"), F.col(name), F.col(id_)))
    out = df.groupBy(*key).agg(best.alias("b"), F.array_sort(F.collect_set(id_)).alias("ids"), F.array_sort(F.collect_set(name)).alias("names"), F.count("*").alias("merged"))
    return out.select(*key, F.col(f"b.{id_}").alias(id_), F.col(f"b.{name}").alias(name), "ids", "names", "merged")
