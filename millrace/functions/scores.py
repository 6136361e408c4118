"""Score normalising, bands, composites and fits, as column functions. Weights and rules are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def normalize_score(c: Column, field_max: float | None = None) -> Column:
    """A score on 0..100: by the field's own maximum if it has one, else values up to 1 are shares."""
    scaled = c / field_max * 100 if field_max else F.when((c >= 0) & (c <= 1), c * 100).otherwise(c)
    return F.round(clamp(scaled, 0.0, 100.0), 2)


#: Lower bounds and names of the score bands, the top one closed at 100.
BANDS = ((80, "80-100"), (60, "60-80"), (40, "40-60"), (20, "20-40"), (0, "0-20"))


def score_band(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, name in reversed(BANDS):
        out = F.when((c >= low) & (c <= 100), name).otherwise(out)
    return out


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """A column scaled by the whole table's least and greatest value (one aggregated row is joined); a constant column is clamped to 0..1."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(clamp(F.col(column), 0.0, 1.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean over the values that are there; null without any."""
    total = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][0] * parts[0][1]).otherwise(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    return F.when(weight > 0, total / weight)


def excess_penalty(supply: Column, uptake: Column) -> Column:
    """What supply has over uptake, weighted by the supply in percent, to two places; null without either."""
    return F.when(supply.isNotNull() & uptake.isNotNull(), F.round(F.greatest(F.lit(0.0), supply - uptake) * supply / 100, 2))


def derived_features(df: DataFrame, first: dict[str, list[str]], mixes: dict[str, list[tuple[str, float]]], excess: dict[str, tuple[str, str]]) -> DataFrame:
    """Features from others: ``first`` the first non-null of several columns, ``mixes`` weighted means over the non-null ones,
    ``excess`` penalties of (supply, uptake). A column that the table lacks counts as null. Mixes may use the features of
    ``first``, penalties those of both."""
    for group, made in ((first, lambda v: F.coalesce(*v)), (mixes, None), (excess, lambda v: excess_penalty(*v))):
        have = set(df.columns)
        col = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")  # noqa: B023, E731
        if made is None:
            df = df.withColumns({n: weighted_mean([(col(c), w) for c, w in parts]) for n, parts in group.items()})
        else:
            df = df.withColumns({n: made([col(c) for c in parts]) for n, parts in group.items()})
    return df


def fit_score(features: dict[str, tuple[Column, float]], rules: list[tuple[Column, float]], limits: list[tuple[Column, float]]) -> Column:
    """Utility per feature (100 - value under a negative weight) weighted by |w|, minus rule penalties (condition, points)
    and penalties min(15, gap / 3) for values above a limit; 0..100."""
    base = weighted_mean([(c if w > 0 else 100 - c, abs(w)) for c, w in features.values()])
    for when, points in rules:
        base = base - F.when(when, points).otherwise(0.0)
    for c, limit in limits:
        base = base - F.when(c > limit, F.least(F.lit(15.0), (c - limit) / 3)).otherwise(0.0)
    return clamp(base, 0.0, 100.0)


def hit_rate(text: Column, keywords: list[str], base: float, step: float = 0.12, top: float = 0.85) -> Column:
    """base + step per keyword found, at most ``top``; 0 where none is found, null for a null text."""
    hits = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k)))
    return F.when(text.isNull(), F.lit(None).cast("double")).when(hits == 0, 0.0).otherwise(F.least(F.lit(base) + hits * step, F.lit(top)))


def level_rate(name: Column, rates: list[tuple[str, float]]) -> Column:
    """The rate of the first listed level that a level's name contains; 0 without one or for null."""
    out = F.lit(0.0)
    for part, rate in reversed(rates):
        out = F.when(F.contains(name, F.lit(part)), rate).otherwise(out)
    return out


def derived_rate(probability: Column, index: Column, by_level: Column, by_hits: Column) -> Column:
    """The greatest of a probability, an index, a level's rate and a keyword rate, each inside 0..1; nulls count 0."""
    return F.greatest(*[F.coalesce(clamp(c, 0.0, 1.0), F.lit(0.0)) for c in (probability, index, by_level, by_hits)])


def on_scale(c: Column, top: float) -> Column:
    """A value inside 0..top; null outside."""
    return F.when(c.between(0, top), c)


def burden_level(c: Column, top: float) -> Column:
    """missing, low, medium_low, elevated or high by the share of a scale; scales of 1 have wider low bands."""
    share = c / top
    low, medium = (0.35, 0.65) if top == 1 else (0.25, 0.5)
    return F.when(c.isNull(), "missing").when(share <= low, "low").when(share <= medium, "medium_low").when(share <= 0.75, "elevated").otherwise("high")


def support_level(c: Column, top: float) -> Column:
    """missing, low, medium_low, medium_high or high by quarters of a scale."""
    share = c / top
    return F.when(c.isNull(), "missing").when(share <= 0.25, "low").when(share <= 0.5, "medium_low").when(share <= 0.75, "medium_high").otherwise("high")


def level(c: Column, strong: float = 75.0, weak: float = 60.0) -> Column:
    return F.when(c >= strong, "strong").when(c >= weak, "weak")


def tags(rules: list[tuple[Column, str]]) -> Column:
    """The names whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def drop_conflicts(found: Column, conflicts: list[tuple[str, str, str | None]]) -> Column:
    """For each (kept, dropped, renamed): where both tags are found, the second goes or gets the new name."""
    for kept, dropped, renamed in conflicts:
        both = F.array_contains(found, kept) & F.array_contains(found, dropped)
        changed = F.transform(found, lambda t: F.when(t == dropped, F.lit(renamed)).otherwise(t)) if renamed else F.array_remove(found, dropped)
        found = F.when(both, changed).otherwise(found)
    return found


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval of hits out of n; 0 for n = 0."""
    p = hits / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(bound, F.lit(0.0))).otherwise(0.0)


def value_places(df: DataFrame, value: str, part: list[str], slots: int = 256) -> DataFrame:
    """(part as ``__e_`` + name, ``__v``, ``__n``, ``__before``, ``__all``): each distinct non-null value of a partition with its
    rows, the rows of smaller values and all rows. Values are counted first and cut into slots of about as many distinct values
    each, by approximate quantiles; slots are summed, then the values inside each slot: no task sorts a whole partition."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(p).alias(f"__e_{p}") for p in part], F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    keys = [f"__e_{p}" for p in part]
    shares = [i / slots for i in range(1, slots)]
    ends = counts.groupBy(*keys).agg(F.percentile_approx("__v", shares).alias("__ends"), F.sum("__n").alias("__all"))

    def joined(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
        right = right.withColumnsRenamed({k: f"__r{k}" for k in [*keys, *also]})
        on = F.lit(True)
        for k in [*keys, *also]:
            on = on & F.col(k).eqNullSafe(F.col(f"__r{k}"))
        return (left.join(right, on) if keys or also else left.crossJoin(F.broadcast(right))).drop(*[f"__r{k}" for k in [*keys, *also]])

    counts = joined(counts, ends).withColumn("__slot", F.size(F.filter("__ends", lambda e: e < F.col("__v")))).drop("__ends")
    sums = counts.groupBy(*keys, "__slot").agg(F.sum("__n").alias("__s"))
    sums = sums.withColumn("__base", F.sum("__s").over(Window.partitionBy(*keys).orderBy("__slot")) - F.col("__s")).drop("__s")
    counts = joined(counts, sums, "__slot")
    inside = F.sum("__n").over(Window.partitionBy(*keys, "__slot").orderBy("__v")) - F.col("__n")
    return counts.withColumn("__before", F.col("__base") + inside).drop("__slot", "__base")


def exact_quantiles(df: DataFrame, value: str, part: list[str], shares: dict[str, float]) -> DataFrame:
    """Per partition the linearly interpolated quantiles ``{name: share}`` of the non-null values."""
    v = value_places(df, value, part)

    def end(share: float, rounded) -> Column:
        place = rounded((F.col("__all") - 1) * share)
        return F.max(F.when((F.col("__before") <= place) & (place < F.col("__before") + F.col("__n")), F.col("__v")))

    def quantile(share: float) -> Column:
        place = F.max((F.col("__all") - 1) * share)
        low, high = end(share, F.floor), end(share, F.ceil)
        return F.when(low == high, low.cast("double")).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return v.groupBy(*[F.col(f"__e_{p}").alias(p) for p in part]).agg(*[quantile(s).alias(n) for n, s in shares.items()])


def average_tie_percentile(df: DataFrame, value: str, part: list[str], out: str, inverted: bool = False) -> DataFrame:
    """Share of non-null rows at or below a value, ties averaged, times 100."""
    share = (F.col("__before") + (F.col("__n") + 1) / 2) / F.col("__all") * 100
    ranks = value_places(df, value, part).select(*[f"__e_{p}" for p in part], "__v", (100 - share if inverted else share).alias(out))
    on = F.col(value) == F.col("__v")
    for p in part:
        on = on & F.col(p).eqNullSafe(F.col(f"__e_{p}"))
    return df.join(ranks, on, "left").drop("__v", *[f"__e_{p}" for p in part])
