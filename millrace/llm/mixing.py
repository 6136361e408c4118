"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target in words gives each of its documents ``copies`` certain whole copies (target div size); the rest of the
target is a sample: documents are ranked by random odds divided by inclusion odds and taken in that order while they fit
(a fixed size in words, unequal probabilities), then one closing document whose size comes nearest to what is left.
The plan is a row per source: its cut in the ranking and the closing pick, so no document's text is ever shuffled.
The random number of a row is the md5 of seed, id, size and text: reruns agree on any cluster. Rows equal in all of these
are a unit of ``n`` rows in the ranking; where the cut falls inside a unit, as many of its rows are taken as fit.
Inclusion odds are a document's weight in its source; ``length_odds`` gives half the weight to documents under 50 words.

Edge cases: null or empty texts have size 0 and are taken 0 words; a null source is a source of its own, last in order;
a null id hashes as ``-``; a source without words has target 0; an empty table gives no rows; extra columns are ignored
(``mix`` keeps those of its input). Targets are a window over the sources, a row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, read

WEIGHTS = (3.0, 1.0, 2.0)
#: Rows in a bucket of the ranking, about: only the bucket that holds a source's cut is ever sorted row by row.
BUCKET_ROWS = 2_000
BLOCK = 256  # buckets whose sums are added up in one window


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_odds(size: Column) -> Column:
    """Inclusion odds of a document relative to its source's: half for documents under 50 words."""
    return F.when(size < 50, F.lit(0.5)).otherwise(F.lit(1.0))


def _ranked(docs: DataFrame, seed: int, odds: Callable[[Column], Column], id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Adds __source, __size and __key: the random odds over the inclusion odds."""
    size = words(F.col(text_col))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), size.cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = docs.select(*keep, F.col(source_col).alias("__source"), size.alias("__size"), u.alias("__u"))
    return rows.withColumn("__key", F.col("__u") / (1 - F.col("__u")) / odds(F.col("__size"))).drop("__u")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``__source, source_size, target``: targets by cyclic weights, none above ``most`` times its source, the excess reshared."""
    one = Window.orderBy(F.col("__source").isNull(), F.col("__source"))
    rank = (F.row_number().over(one) - 1) % len(weights)
    t = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
    t = t.withColumn("total", F.lit(share) * F.sum("source_size").over(Window.partitionBy())).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("__source").isNull(), F.col("__source"))
    up, down = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down))
    first = F.min(F.when(F.col("w") * F.col("level") < F.col("cap"), F.struct("rank", "level"))).over(Window.partitionBy())
    t = t.withColumn("rank", F.row_number().over(order)).withColumn("level", first["level"])
    return t.select("__source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source from ranked rows: size, target, certain copies, cut in the ranking, closing pick."""
    same = lambda a, b: a["__source"].eqNullSafe(b["__source"])
    t = cut(targets(rows.groupBy("__source").agg(F.sum("__size").cast("double").alias("source_size")), weights, share, most))
    t = t.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    t = t.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    units = cut(rows.groupBy("__source", "__key").agg(F.sum("__size").alias("unit"), F.count("*").alias("n")))
    buckets = max(BLOCK, units.count() // BUCKET_ROWS)
    units = units.withColumn("bucket", F.floor(F.col("__key") / (1 + F.col("__key")) * buckets).cast("int"))
    per = units.groupBy("__source", "bucket").agg(F.sum("unit").alias("sum")).withColumn("block", F.floor(F.col("bucket") / BLOCK))
    blocks = per.groupBy(F.col("__source").alias("bs"), F.col("block").alias("bb")).agg(F.sum("sum").alias("bsum"))
    blocks = blocks.withColumn("outside", F.sum("bsum").over(Window.partitionBy("bs").orderBy("bb")) - F.col("bsum"))
    per = per.withColumn("inside", F.sum("sum").over(Window.partitionBy("__source", "block").orderBy("bucket")) - F.col("sum"))
    per = per.join(blocks, F.col("__source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb"))).withColumn("before", F.col("inside") + F.col("outside"))
    at = per.join(t.withColumnRenamed("__source", "s"), F.col("__source").eqNullSafe(F.col("s"))).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
    at = cut(at.select(F.col("__source").alias("s"), F.col("bucket").alias("b"), "before", "rest"))
    found = units.join(at, F.col("__source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    found = found.withColumn("cum", F.col("before") + F.sum("unit").over(Window.partitionBy("__source").orderBy("__key")))
    # the first unit that doesn't fit whole, and what of it does
    edge = found.where("cum > rest").groupBy("__source").agg(F.min(F.struct("__key", "unit", "n", "cum", "rest")).alias("x"))
    room = F.col("x.rest") - (F.col("x.cum") - F.col("x.unit"))
    fit = F.floor(room / (F.col("x.unit") / F.col("x.n"))).cast("long")
    edge = cut(edge.select(F.col("__source").alias("e"), F.col("x.__key").alias("first_out"), F.col("x.n").alias("out_n"), fit.alias("part"), (room - fit * (F.col("x.unit") / F.col("x.n"))).alias("gap")))
    miss = F.abs(F.col("gap") - F.col("unit") / F.col("n"))
    left = units.join(edge, F.col("__source").eqNullSafe(F.col("e"))).where((F.col("__key") >= F.col("first_out")) & (miss < F.col("gap")))
    pick = left.groupBy(F.col("__source").alias("p")).agg(F.min(F.struct(miss.alias("miss"), F.col("__key").alias("key"), "n")).alias("pick"))
    t = t.withColumnRenamed("__source", "__plan_source")
    t = t.join(edge, F.col("__plan_source").eqNullSafe(F.col("e")), "left").join(pick, F.col("__plan_source").eqNullSafe(F.col("p")), "left")
    # the units that are taken in part: key -> rows taken of it, rows it has
    same_unit = F.col("first_out") == F.col("pick.key")
    t = t.withColumn("parts", F.map_from_entries(F.array_compact(F.array(
        F.when(F.col("first_out").isNotNull(), F.struct(F.col("first_out").alias("key"), F.struct((F.col("part") + F.coalesce(same_unit.cast("long"), F.lit(0))).alias("rows"), F.col("out_n").alias("n")).alias("part"))),
        F.when(F.col("pick.key").isNotNull() & ~same_unit, F.struct(F.col("pick.key").alias("key"), F.struct(F.lit(1).cast("long").alias("rows"), F.col("pick.n").alias("n")).alias("part"))),
    ))))
    # without a cut inside it, a source is taken whole only if its rest reaches its size, which whole copies rule out
    return cut(t.select("__plan_source", "source_size", "target", "copies", "first_out", "parts", (F.col("rest") > 0).alias("sampled")))


def _taken(rows: DataFrame, p: DataFrame) -> DataFrame:
    """Adds ``__n``, the copies of each row. Equal rows of a unit that is taken in part are counted by their columns, numbered
    as stretches and laid out again, so that a unit of any size passes through no single task."""
    columns = rows.columns
    rows = rows.join(p, F.col("__source").eqNullSafe(F.col("__plan_source")))
    part = F.col("parts")[F.col("__key")]  # null for units taken whole or not at all
    chosen = (F.col("sampled") & (F.coalesce(F.col("__key") < F.col("first_out"), F.lit(True)) | F.coalesce(part["rows"] > 0, F.lit(False)))).cast("int")
    count = lambda extra: F.when(F.col("__size") == 0, 0).otherwise(F.col("copies") + extra).cast("int")
    several = F.coalesce(part["n"] > 1, F.lit(False)) & F.col("sampled")
    if p.where("exists(map_values(parts), x -> x.n > 1)").isEmpty():
        return rows.select(*columns, "source_size", "target", count(chosen).alias("__n"))
    plain = rows.where(~several).select(*columns, "source_size", "target", count(chosen).alias("__n"))
    rest = rows.where(several).groupBy(*columns, "source_size", "target", "copies", part["rows"].alias("part")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("__source", "__key").orderBy(F.xxhash64(*columns))
    rest = rest.withColumn("some", F.greatest(F.lit(0), F.least(F.col("c"), F.col("part") - (F.sum("c").over(order) - F.col("c")))))
    kinds = F.explode(F.array(F.struct(F.col("some").alias("rows"), F.lit(1).alias("more")), F.struct((F.col("c") - F.col("some")).alias("rows"), F.lit(0).alias("more"))))
    rest = rest.withColumn("k", kinds).where("k.rows > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k.rows") - 1) / 1000))))
    rest = rest.repartition(F.xxhash64("__key", "block", "k.more")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000), F.col("k.rows") - 1000 * F.col("block")))))
    return plain.union(rest.select(*columns, "source_size", "target", count(F.col("k.more")).alias("__n")))


def mix(docs: DataFrame, seed: int = 11, odds: Callable[[Column], Column] = length_odds, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every row of ``docs`` as many times as it is taken, with its own columns."""
    p = plan(cut(_ranked(docs, seed, odds, id_col, text_col, source_col, [])), weights, share, most)
    rows = _ranked(docs, seed, odds, id_col, text_col, source_col, [F.struct(*docs.columns).alias("__row")])
    taken = _taken(rows, p).where("__n > 0")
    return taken.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(_ranked(read(spark, sf_dir, "documents"), 11, length_odds, "doc_id", "text", "source", ["doc_id"]))
    rows = _taken(slim, plan(slim))
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("__n") * F.col("__size")).cast("long").alias("taken"))


OP4_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
h AS (
  SELECT *, (('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '-') || '|' || size || '|' || digest), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
k0 AS (SELECT *, u / (1 - u) / CASE WHEN size < 50 THEN 0.5 ELSE 1.0 END AS key FROM h),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, key) AS occ FROM k0),
s AS (SELECT source, sum(size)::DOUBLE AS ss, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM k GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(i % 3 + 1)::INT]::DOUBLE AS w, 1.5 * sum(ss) OVER () AS total, 2.0 * ss AS cap FROM s),
v AS (SELECT *, row_number() OVER (ORDER BY cap / w, i) AS ord, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
x AS (SELECT *, arg_min(lv, ord) FILTER (w * lv < cap) OVER () AS level FROM v),
t AS (SELECT source, ss, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM x),
c AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS copies FROM t),
r AS (SELECT *, target - copies * ss AS rest FROM c),
cu AS (SELECT k.source, key, occ, size, rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, occ) AS cum FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, min((key, occ)) FILTER (cum > rest) AS first_out, max(rest) - coalesce(max(cum) FILTER (cum <= rest), 0) AS gap FROM cu GROUP BY source),
p AS (SELECT source, key, occ FROM (SELECT cu.source, key, occ, row_number() OVER (PARTITION BY cu.source ORDER BY abs(gap - size), key, occ) AS n
      FROM cu JOIN e ON cu.source IS NOT DISTINCT FROM e.source WHERE (key, occ) >= first_out AND abs(gap - size) < gap) WHERE n = 1)
SELECT k.doc_id, k.size, r.ss::BIGINT AS source_size, r.target,
  (k.size * (r.copies + CASE WHEN r.rest > 0 AND (coalesce((k.key, k.occ) < e.first_out, true) OR coalesce(k.key = p.key AND k.occ = p.occ, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source JOIN e ON k.source IS NOT DISTINCT FROM e.source
LEFT JOIN p ON k.source IS NOT DISTINCT FROM p.source
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": OP4_SQL}
