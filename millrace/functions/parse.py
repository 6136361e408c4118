"""Parsing of messy marketplace, date, label and JSON texts, as column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sold_count(c: Column) -> Column:
    """'3.5万+' -> 35000, '200+ sold' -> 200; null without a number."""
    number = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1)
    value = F.when(number != "", number.cast("decimal(18,4)"))
    return F.round(F.when(c.rlike(r"[0-9]\s*[万wW]"), value * 10000).otherwise(value)).cast("long")


def first_number(c: Column) -> Column:
    number = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(number != "", number.cast("double"))


def price_bucket(c: Column) -> Column:
    return F.when(c < 50, "<50").when(c < 80, "50-80").when(c >= 80, "80+")


#: 500 g units per unit of weight; metric beats pounds where a text has both.
UNITS = {"kg": 2.0, "g": 0.002, "lb": 0.907184}
_WEIGHT = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(kg|g|lb)s?\b(?:\s*[x*]\s*([0-9]+))?"


def net_weight(*fields: Column, mode: str = "first") -> Column:
    """Net weight in 500 g units of the first field that has one: amount x unit x count; the first or the sum of the
    mentions, metric ones alone if there are any."""
    found = []
    for c in fields:
        parts = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_WEIGHT), F.lit(i)) for i in (1, 2, 3)]
        units = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])
        rows = F.transform(
            F.arrays_zip(parts[0].alias("a"), parts[1].alias("u"), parts[2].alias("n")),
            lambda r: F.struct((F.lower(r["u"]) != "lb").alias("metric"), (r["a"].cast("double") * F.element_at(units, F.lower(r["u"])) * F.coalesce(F.try_to_number(r["n"], F.lit("9999")).cast("double"), F.lit(1.0))).alias("w")),
        )
        metric = F.filter(rows, lambda r: r["metric"])
        rows = F.when(F.size(metric) > 0, metric).otherwise(rows)
        total = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["w"]) if mode == "sum" else F.element_at(rows, 1)["w"]
        found.append(F.when(F.size(rows) > 0, total))
    return F.coalesce(*found)


def loose_date(c: Column, reference: Column) -> Column:
    """A date from Y-M-D, Y/M/D, M-D (the latest such day not after the reference), 'N days ago', 'N hours ago',
    'yesterday', 'today'; null for anything else."""
    t = F.trim(c)
    part = lambda p, i: F.try_to_number(F.nullif(F.regexp_extract(t, p, i), F.lit("")), F.lit("9999")).cast("int")
    ymd, md, ago = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", r"^([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,4}) (day|hour)s? ago$"
    day = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    ref = F.to_date(reference)
    this = day(F.year(ref).cast("string"), part(md, 1).cast("string"), part(md, 2).cast("string"))
    last = day((F.year(ref) - 1).cast("string"), part(md, 1).cast("string"), part(md, 2).cast("string"))
    return (
        F.when(t.rlike(ymd), day(part(ymd, 1).cast("string"), part(ymd, 2).cast("string"), part(ymd, 3).cast("string")))
        .when(t.rlike(md), F.when(this <= ref, this).otherwise(last))
        .when(t.rlike(r"^[0-9]{1,4} days? ago$"), F.date_sub(ref, part(ago, 1)))
        .when(t.rlike(r"^[0-9]{1,4} hours? ago$"), F.to_date(reference.cast("timestamp") - F.make_dt_interval(hours=part(ago, 1))))
        .when(F.lower(t) == "yesterday", F.date_sub(ref, 1))
        .when(F.lower(t) == "today", ref)
    )


def review_date(c: Column) -> Column:
    """D/M/Y or ISO -> YYYY-MM-DD."""
    return F.date_format(F.coalesce(F.try_to_timestamp(c, F.lit("d/M/yyyy")), F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))), "yyyy-MM-dd")


def unix_time(c: Column) -> Column:
    """Unix seconds or milliseconds -> timestamp."""
    return F.timestamp_seconds(F.when(c > 10**11, c / 1000).otherwise(c))


def split_multi(c: Column) -> Column:
    """Distinct trimmed parts of a text cut at | , ; and their full-width forms, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[|,;，；、]"), lambda x: F.trim(x)), lambda x: x != ""))


def list_cell(c: Column) -> Column:
    """A JSON list of texts, else the parts of a delimited text; an empty list for null."""
    return F.coalesce(F.from_json(c, "array<string>"), split_multi(c), F.array().cast("array<string>"))


def map_cell(c: Column) -> Column:
    """A JSON object of numbers; null where it isn't one."""
    return F.from_json(c, "map<string,double>", {"mode": "PERMISSIVE"})


def rank_weight(rank: Column) -> Column:
    return F.when(rank <= 3, 1.0).when(rank <= 6, 0.7).when(rank <= 10, 0.4).otherwise(0.2)


def percent_weight(percent: Column) -> Column:
    return F.when(percent.isNull(), 1.0).when(percent >= 30, 1.5).when(percent >= 10, 1.2).otherwise(1.0)


def ingredient_rows(c: Column) -> Column:
    """An ordered list text -> array of (name, rank, percent)."""
    items = F.filter(F.transform(F.split(c, r"[,，、;；]"), lambda x: F.trim(x)), lambda x: x != "")
    percent = lambda x: F.nullif(F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).cast("double")
    name = lambda x: F.trim(F.regexp_replace(x, r"[(（\[]?\s*[0-9]+(?:\.[0-9]+)?\s*%\s*[)）\]]?", ""))
    return F.transform(items, lambda x, i: F.struct(name(x).alias("name"), (i + 1).cast("long").alias("rank"), percent(x).alias("percent")))


def cut_outside_brackets(text: str) -> list[str]:
    """The pieces between separators that stand outside brackets; a bracket left open ends with the text."""
    pieces, depth, last = [], 0, 0
    for i, ch in enumerate(text + ","):
        if ch in "([（【":
            depth += 1
        elif ch in ")]）】":
            depth = max(0, depth - 1)
        elif ch in ",，、;；。\n" and (depth == 0 or i == len(text)):
            pieces.append(text[last:i])
            last = i + 1
    return pieces


def around_brackets(piece: str) -> tuple[str, str]:
    """(text outside brackets, text inside the first bracket), inner brackets kept inside."""
    outside, inside, depth, closed = [], [], 0, False
    for ch in piece:
        ends = ch in ")]）】" and depth > 0
        depth -= ends
        closed |= ends and depth == 0
        if depth > 0 and not closed:
            inside.append(ch)
        depth += ch in "([（【"
        if depth == 0 and not ends:
            outside.append(ch)
    return "".join(outside), "".join(inside)


def split_nested(text: str | None, noise: tuple[str, ...], synonyms: dict[str, str], longest: int = 80, headers: tuple[str, ...] = (), exact: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> list[str]:
    """Names of a label text: cut at separators outside brackets, bracket notes and percents stripped, then the first of
    ``prefixes`` that the name begins with (what a reading of a picture adds), noise words and over-long names dropped, synonyms
    mapped. A name with one of ``headers`` in it, or that is one of ``exact``, is a group's: the names in its bracket stand in
    its place. Without a bracket a header with a percent goes; any other such name is kept as one."""
    out = []
    pieces = cut_outside_brackets(text or "")[::-1]
    while pieces:
        outside, inside = around_brackets(pieces.pop())
        word = re.sub(r"\s*[0-9]+(\.[0-9]+)?\s*[%％]", "", outside).strip(" .:：)]）】").lower()
        header = any(h in word for h in headers)
        if inside and (header or word in exact):
            pieces += cut_outside_brackets(inside)[::-1]
            continue
        if header and re.search(r"[0-9]\s*[%％]", outside):
            continue
        prefix = next((p for p in prefixes if word.startswith(p)), "")
        word = word[len(prefix) :].lstrip(" :：") if prefix else word
        word = synonyms.get(word, word)
        if word and word not in noise and len(word) <= longest:
            out.append(word)
    return out


def nested_names(noise: tuple[str, ...] = (), synonyms: dict[str, str] | None = None, headers: tuple[str, ...] = (), exact: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()):
    """Pandas UDF text -> array of names, bracket-aware."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_nested(t, noise, synonyms or {}, headers=headers, exact=exact, prefixes=prefixes))

    return split


def only_segmentation(name: str, aliases: frozenset[str]) -> list[str]:
    """The parts of a glued name if it splits into aliases in exactly one way, else an empty list."""
    ways = [0] * (len(name) + 1)
    back: list[int] = [-1] * (len(name) + 1)
    ways[0] = 1
    longest = max(map(len, aliases), default=0)
    for j in range(1, len(name) + 1):
        for i in range(max(0, j - longest), j):
            if ways[i] and name[i:j] in aliases:
                ways[j] = min(2, ways[j] + ways[i])
                back[j] = i
    if ways[-1] != 1 or not name:
        return []
    out, j = [], len(name)
    while j:
        out.append(name[back[j] : j])
        j = back[j]
    return out[::-1]


def segment_names(aliases: list[str]):
    """Pandas UDF glued name -> its only segmentation. ``aliases`` is a dictionary of checked size."""
    known = frozenset(aliases)

    @F.pandas_udf("array<string>")
    def split(names: pd.Series) -> pd.Series:
        return names.map(lambda n: only_segmentation(n or "", known))

    return split
