"""Aggregations: outcome statistics, coverage, periods, quantile tags, pivots, votes, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import exact_quantiles, value_places, wilson_lower
from .ranking import rank_in_group


def text_groups(rows: DataFrame, text: str, key: str, lists: dict[str, str], date: str) -> DataFrame:
    """Groups of equal trimmed texts (keyed by md5, not by the text): least key, sorted distinct values joined by ``|``,
    earliest date, count."""
    hashed = rows.withColumn("__h", F.md5(F.trim(text).cast("binary")))
    joined = [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(out) for c, out in lists.items()]
    return hashed.groupBy(F.col("__h").alias("text_key")).agg(F.min(key).alias("first_id"), F.min(date).alias("first_date"), F.count("*").alias("n"), *joined)


def outcome_stats(clues: DataFrame, group: list[str], clue: str, outcome: str) -> DataFrame:
    """Per group the distinct clues by outcome, their rate of improvement and its Wilson lower bound. A clue that comes
    twice in a group (by two aliases, say) counts once, with its least outcome."""
    once = clues.groupBy(*group, clue).agg(F.min(outcome).alias(outcome))
    n = once.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col(outcome) == "improved").alias("improved"), F.count_if(F.col(outcome) == "worsened").alias("worsened"))
    n = n.withColumn("uncertain", F.col("n") - F.col("improved") - F.col("worsened"))
    return n.withColumn("rate", F.col("improved") / F.col("n")).withColumn("wilson", wilson_lower(F.col("improved"), F.col("n")))


def representative_score(n: Column, wilson: Column) -> Column:
    return F.log1p(n) * (0.5 + 0.5 * wilson)


def bridged_totals(stats: DataFrame, bridge: DataFrame, group: str, via: str, target: str, product: str, clues: str) -> DataFrame:
    """Per (group, target): distinct vias and products, and clues summed once per via, however many products lead there."""
    pairs = bridge.select(via, target).distinct()
    sums = stats.join(pairs, via).groupBy(group, target).agg(F.countDistinct(via).alias("vias"), F.sum(clues).alias("clues"))
    products = stats.select(group, via).distinct().join(bridge, via).groupBy(group, target).agg(F.countDistinct(product).alias("products"))
    return sums.join(products, [group, target]).withColumn("score", 10 * F.col("vias") + F.col("products") + F.log1p(F.col("clues")))


def segment_counts(rows: DataFrame, group: str, segments: dict[str, str], key: str) -> DataFrame:
    """Distinct keys per group for ``all`` and for every value of each segment column. Duplicates go first, so the hot
    ``all`` segment is summed from counts."""
    parts = F.array(F.struct(F.lit("all").alias("type"), F.lit("all").alias("value")), *[F.struct(F.lit(n).alias("type"), F.col(c).cast("string").alias("value")) for n, c in segments.items()])
    spread = rows.select(group, key, F.explode(parts).alias("s")).select(group, key, "s.type", "s.value").where("value IS NOT NULL").distinct()
    return spread.groupBy(group, "type", "value").agg(F.count("*").alias("n"))


def year_over_year(rows: DataFrame, group: list[str], key: str, date: str) -> DataFrame:
    """Distinct keys in the last 12 months up to the data's own last date, in the 12 before, and the change in percent."""
    last = rows.agg(F.max(F.to_date(date)).alias("__last"))
    r = rows.crossJoin(F.broadcast(last)).withColumn("__d", F.to_date(date))
    now = F.col("__d") > F.add_months("__last", -12)
    before = (F.col("__d") > F.add_months("__last", -24)) & ~now
    out = r.groupBy(*group).agg(F.countDistinct(F.when(now, F.col(key))).alias("current"), F.countDistinct(F.when(before, F.col(key))).alias("previous"))
    return out.withColumn("change", F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) / F.col("previous") * 100))


def coverage(mentions: DataFrame, products: DataFrame, group: str, via: str, product: str) -> DataFrame:
    """Distinct products reachable from a group's vias, and their share of all products. Products of the same vias are one
    class with a count, so a group meets classes, never the products themselves."""
    total = products.agg(F.countDistinct(product).alias("__total"))
    known = products.where(F.col(via).isNotNull() & F.col(product).isNotNull())
    each = known.groupBy(product).agg(F.array_sort(F.collect_set(via)).alias("__vias"))
    classes = each.groupBy("__vias").agg(F.min(product).alias("__class"), F.count("*").alias("__n")).select(F.explode("__vias").alias(via), "__class", "__n")
    reach = mentions.select(group, via).distinct().join(classes, via).select(group, "__class", "__n").distinct().groupBy(group).agg(F.sum("__n").alias("products"))
    return reach.crossJoin(F.broadcast(total)).withColumn("share", F.col("products") / F.col("__total")).drop("__total")


def market_summary(items: DataFrame, group: str, name: str, price: str, sales: str, taste: str) -> DataFrame:
    """Per group: items, average, exact median, least and greatest price, the taste with the most sales, first ten names."""
    tastes = items.groupBy(group, taste).agg(F.sum(sales).alias("__s")).groupBy(group).agg(F.max(F.struct("__s", F.col(taste).alias("t"))).alias("__t"))
    first = rank_in_group(items.where(F.col(name).isNotNull()).select(group, name).distinct(), [group], [F.asc(name)], "__n").where("__n <= 10")
    names = first.groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("names"))
    out = items.groupBy(group).agg(F.count("*").alias("items"), F.avg(price).alias("average"), F.min(price).alias("least"), F.max(price).alias("greatest"))
    for more in (exact_quantiles(items, price, [group], {"median": 0.5}), names, tastes.select(group, F.col("__t.t").alias("top_taste"))):
        out = out.join(more.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    return out


def pool_position(df: DataFrame, value: str) -> DataFrame:
    """Rows with a value, with the share of values at or below it (``position``), the average and the exact median."""
    places = value_places(df, value, []).select("__v", ((F.col("__before") + F.col("__n")) / F.col("__all")).alias("position"))
    pool = df.agg(F.avg(value).alias("average")).crossJoin(exact_quantiles(df, value, [], {"median": 0.5}))
    return df.join(places, F.col(value) == F.col("__v")).drop("__v").crossJoin(F.broadcast(pool))


def quantile_tags(df: DataFrame, columns: list[str], high: float = 0.75, low: float = 0.25) -> DataFrame:
    """``advantages`` and ``weaknesses``: columns at or above / below the table's linear-interpolation quantiles (one
    aggregated row is joined)."""
    marked = df
    for c in columns:
        marked = marked.crossJoin(F.broadcast(exact_quantiles(df, c, [], {f"__h_{c}": high, f"__l_{c}": low})))
    up = F.array_compact(F.array(*[F.when(F.col(c) >= F.col(f"__h_{c}"), F.lit(c)) for c in columns]))
    down = F.array_compact(F.array(*[F.when(F.col(c) <= F.col(f"__l_{c}"), F.lit(c)) for c in columns]))
    return marked.withColumn("advantages", up).withColumn("weaknesses", down).drop(*[f"__{x}_{c}" for x in "hl" for c in columns])


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The value at place min(int(n x share), n - 1) of the sorted non-null values."""
    place = F.least(F.floor(F.col("__all") * share), F.col("__all") - 1)
    return value_places(df, value, []).where(F.col("__before") + F.col("__n") > place).agg(F.min("__v").alias("threshold"))


def problem_clusters(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per rate field: average over positive values, greatest value, affected rows, coverage."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rate")) for f in fields])).alias("x")).select("x.*")
    positive = F.when(F.col("rate") > 0, F.col("rate"))
    return long.groupBy("field").agg(F.avg(positive).alias("average"), F.max("rate").alias("greatest"), F.count(positive).alias("affected"), (F.count(positive) / F.count("*")).alias("coverage"))


def _priority(share: Column) -> Column:
    return F.when(share >= 0.75, "P1").when(share >= 0.45, "P2").otherwise("P3")


def failure_points(clusters: DataFrame, rules: DataFrame, tags: DataFrame | None = None, tag_rules: DataFrame | None = None) -> DataFrame:
    """``point, score, priority``: 0.7 x average + 0.3 x coverage of each problem, times the weight of its rules (field, point,
    weight), times 10; and for each row of ``tags`` (tag, similarity; without a similarity 0.5) the similarity times the weight
    of its tag's rules (tag, point, weight); summed per point. P1 / P2 / P3 by the share of the greatest score. Tags are summed
    before they meet rules, so a tag that most products have is one row."""
    scores = clusters.join(rules, "field").select("point", ((0.7 * F.coalesce("average", F.lit(0.0)) + 0.3 * F.coalesce("coverage", F.lit(0.0))) * F.col("weight") * 10).alias("score"))
    if tags is not None and tag_rules is not None:
        weights = tags.groupBy("tag").agg(F.sum(F.coalesce("similarity", F.lit(0.5))).alias("similarity"))
        scores = scores.union(weights.join(tag_rules, "tag").select("point", F.col("similarity") * F.col("weight")))
    scored = scores.groupBy("point").agg(F.sum("score").alias("score"))
    return scored.withColumn("priority", _priority(F.col("score") / F.max("score").over(Window.partitionBy())))  # one row per point of the rules


def quality_indicators(points: DataFrame, indicators: DataFrame) -> DataFrame:
    """``indicator, score, share, priority, points``: what to measure against the failure points. Each point's score counts 1.5
    times as P1, once as P2 and 0.6 times as P3 for each of its ``indicators`` (point, indicator); the share is that of the
    greatest score, the points are listed from the highest score on. Both tables are as small as the rules."""
    factor = F.when(F.col("priority") == "P1", 1.5).when(F.col("priority") == "P2", 1.0).otherwise(0.6)
    found = points.join(indicators.select("point", "indicator").distinct(), "point")
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "point"))), lambda x: x["point"])
    out = found.groupBy("indicator").agg(F.sum(F.col("score") * factor).alias("total"), listed.alias("points"))
    out = out.withColumn("share", F.col("total") / F.max("total").over(Window.partitionBy()))
    return out.select("indicator", F.col("total").alias("score"), "share", _priority(F.col("share")).alias("priority"), "points")


def majority(ballots: DataFrame, item: str, choice: str) -> DataFrame:
    """The choice with more than half of an item's votes, else ``split``, and the tally as ``choice:count`` texts."""
    counts = ballots.groupBy(item, choice).agg(F.count("*").alias("n"))
    votes = counts.groupBy(item).agg(F.sum("n").alias("votes"), F.max(F.struct("n", F.col(choice).alias("c"))).alias("top"), F.array_sort(F.collect_list(F.concat_ws(":", choice, F.col("n").cast("string")))).alias("tally"))
    return votes.select(item, "votes", F.when(F.col("top.n") * 2 > F.col("votes"), F.col("top.c")).otherwise("split").alias("winner"), "tally")


def evidence_status(votes: DataFrame, item: str, post: str, stance: str, risk: str, professional: str) -> DataFrame:
    """Distinct agreeing and opposing posts -> locked if professional, community (two agree, none opposes), disputed (one
    opposes, risk not high), else single."""
    n = votes.groupBy(item).agg(F.countDistinct(F.when(F.col(stance) == "agree", F.col(post))).alias("agree"), F.countDistinct(F.when(F.col(stance) == "oppose", F.col(post))).alias("oppose"), F.max(risk).alias("__r"), F.max(professional).alias("__p"))
    status = F.when(F.col("__p"), "professional").when((F.col("agree") >= 2) & (F.col("oppose") == 0), "community").when((F.col("oppose") >= 1) & (F.col("__r") != "high"), "disputed").otherwise("single")
    return n.withColumn("status", status).drop("__r", "__p")


def fuse_fields(rows: DataFrame, key: list[str], fields: list[str], source: str) -> DataFrame:
    """Per key: each field's distinct values with their sources, fields that differ, and a content hash."""
    long = rows.select(*key, source, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(*key, source, "x.*").where("value IS NOT NULL")
    variants = long.groupBy(*key, "field", "value").agg(F.array_sort(F.collect_set(source)).alias("sources"))
    per = variants.groupBy(*key, "field").agg(F.array_sort(F.collect_list(F.struct("value", "sources"))).alias("variants"))
    out = per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("field", "variants"))).alias("fields"))
    differing = F.transform(F.filter("fields", lambda f: F.size(f["variants"]) > 1), lambda f: f["field"])
    return out.withColumn("differing", differing).withColumn("content_hash", F.sha2(F.to_json("fields"), 256))


def conflicting(rows: DataFrame, key: list[str], content: Column) -> DataFrame:
    """Keys that carry more than one content."""
    return rows.groupBy(*key).agg(F.countDistinct(content).alias("contents")).where("contents > 1")


def duplicates(rows: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Keys with more than one row, with the sorted ids."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_)).alias("ids")).where("n > 1")


def alias_audit(names: DataFrame, aliases: DataFrame, key: str, target: str) -> DataFrame:
    """Each name: unique, ambiguous or unmatched, by the number of distinct targets of its key."""
    n = aliases.groupBy(key).agg(F.countDistinct(target).alias("__n"), F.min(target).alias("__t"))
    status = F.when(F.col("__n") == 1, "unique").when(F.col("__n") > 1, "ambiguous").otherwise("unmatched")
    return names.join(n, key, "left").withColumn("status", status).withColumn("target", F.when(F.col("__n") == 1, F.col("__t"))).drop("__n", "__t")


def alias_lookup(standards: DataFrame, aliases: DataFrame, id_: str, name: str, key) -> DataFrame:
    """``key, target, matched_by`` of every target a name may stand for: standards (id_, name) under their own name, and
    under their aliases (id_, name). Aliases of a standard that is gone stand for nothing. ``key`` normalises a column."""
    live = aliases.join(standards.select(id_).distinct(), id_, "left_semi")
    both = standards.select(key(F.col(name)).alias("key"), F.col(id_).alias("target"), F.lit(0).alias("__alias")).union(live.select(key(F.col(name)), F.col(id_), F.lit(1)))
    once = both.where("key IS NOT NULL").groupBy("key", "target").agg(F.max("__alias").alias("__alias"))
    return once.select("key", "target", F.when(F.col("__alias") == 1, "alias").otherwise("standard_name").alias("matched_by"))


def alias_collisions(standards: DataFrame, aliases: DataFrame, id_: str, name: str, key) -> DataFrame:
    """``key, target, n`` (its aliases) of every alias key that stands for several living targets."""
    live = aliases.join(standards.select(id_).distinct(), id_, "left_semi")
    counts = live.groupBy(key(F.col(name)).alias("key"), F.col(id_).alias("target")).agg(F.count("*").alias("n"))
    several = counts.groupBy("key").agg(F.count("*").alias("__t")).where("__t > 1").select("key")
    return counts.join(several, "key", "left_semi")


def orphan_aliases(standards: DataFrame, aliases: DataFrame, id_: str, name: str, key) -> DataFrame:
    """The aliases with ``action`` and ``target``: kept while their standard lives; an orphan is repaired if exactly one
    standard bears its name, else deactivated, not guessed."""
    ids = standards.select(id_).distinct().withColumn("__there", F.lit(True))
    named = standards.groupBy(key(F.col(name)).alias("__key")).agg(F.count("*").alias("__n"), F.min(id_).alias("__one"))
    joined = aliases.join(ids, id_, "left").withColumn("__key", key(F.col(name))).join(named, "__key", "left")
    there = F.coalesce("__there", F.lit(False))
    action = F.when(there, "kept").when(F.col("__n") == 1, "repaired").otherwise("deactivated")
    target = F.when(there, F.col(id_)).when(F.col("__n") == 1, F.col("__one"))
    return joined.withColumns({"action": action, "target": target}).drop("__there", "__key", "__n", "__one")


def candidate_groups(candidates: DataFrame, key: str, id_: str, status: str, suggested: str, reviewed: str, priority: dict[str, int]) -> DataFrame:
    """``key, survivor, members, duplicates, held_back`` of the candidates of one key: the survivor has the highest status, then
    a suggestion, a review and the greatest id. The others are duplicates, unless approved candidates of the key name
    several targets: such a group is held back whole. Map-side, so a hot key costs one row a task; it keeps the distinct
    approved targets only up to two, as least and greatest."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col(status)], F.lit(0))
    best = F.max(F.struct(rank.alias("p"), F.col(suggested).isNotNull().alias("s"), F.col(reviewed).isNotNull().alias("r"), F.col(id_).alias("id")))
    approved = F.when(F.col(status) == "approved", F.col(suggested))
    held = F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False))
    groups = candidates.groupBy(key).agg(best.alias("__b"), F.count("*").alias("members"), F.min(approved).alias("__lo"), F.max(approved).alias("__hi"))
    return groups.select(key, F.col("__b.id").alias("survivor"), "members", F.when(held, 0).otherwise(F.col("members") - 1).alias("duplicates"), held.alias("held_back"))


def latest_samples(rows: DataFrame, topic: str, conversation: str, turn: str, text: str) -> DataFrame:
    """The latest message (greatest turn, then text) of each conversation per topic."""
    last = rows.groupBy(topic, conversation).agg(F.max(F.struct(F.col(turn), F.col(text))).alias("__l"))
    return last.select(topic, conversation, F.col(f"__l.{turn}").alias(turn), F.col(f"__l.{text}").alias(text))


def direction_states(metrics: DataFrame, keys: list[str], metric: str, changed: Column, directions: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """One row per key and direction (name -> core metrics, required metrics): abnormal if a core metric changed, normal if all
    required ones are there, else insufficient; with the changed core metrics and the missing required ones."""
    day = metrics.groupBy(*keys).agg(F.collect_set(metric).alias("__present"), F.collect_set(F.when(changed, F.col(metric))).alias("__changed"))
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    rows = F.array(*[
        F.struct(F.lit(name).alias("direction"), F.array_intersect(texts(core), "__changed").alias("evidence"), F.array_except(texts(required), "__present").alias("missing"))
        for name, (core, required) in directions.items()])
    state = F.when(F.size("evidence") > 0, "abnormal").when(F.size("missing") == 0, "normal").otherwise("insufficient")
    return day.select(*keys, F.explode(rows).alias("d")).select(*keys, "d.*").withColumn("state", state)


def label_insights(rows: DataFrame, main: str, labels: str, resolved: str, unresolved: str, onset: str, k: int = 4) -> DataFrame:
    """The k most frequent second labels of each main label (ties by name): count, share of the main label's rows, share
    resolved among those with an outcome, unresolved count and most frequent onset (the greatest name on ties)."""
    part = rows.select(main, resolved, unresolved, onset, F.explode(labels).alias("label")).groupBy(main, "label", onset).agg(
        F.count("*").alias("n"), F.count_if(resolved).alias("__y"), F.count_if(unresolved).alias("unresolved"))
    most = F.max(F.when(F.col(onset).isNotNull(), F.struct("n", F.col(onset).alias("o"))))
    counts = part.groupBy(main, "label").agg(most.alias("__o"), F.sum("n").alias("n"), F.sum("__y").alias("__y"), F.sum("unresolved").alias("unresolved"))
    place = F.row_number().over(Window.partitionBy(main).orderBy(F.desc("n"), "label"))
    top = counts.withColumn("place", place).where(F.col("place") <= k).join(rows.groupBy(main).agg(F.count("*").alias("__all")), main)
    known = F.col("__y") + F.col("unresolved")
    return top.select(main, "label", "place", "n", (F.col("n") / F.col("__all")).alias("share"), F.when(known > 0, F.col("__y") / known).alias("resolved_rate"), "unresolved", F.col("__o.o").alias("top_onset"))


def last_two_years(rows: DataFrame, key: str, year: str, before: int) -> DataFrame:
    """Change in percent between a key's last two years before the given one; keys with fewer years are left out."""
    counts = rows.where(F.col(year) < before).groupBy(key, year).agg(F.count("*").alias("n"))
    last = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), "n"))).alias("__s")).where(F.size("__s") > 1)
    a, b = F.element_at("__s", -2), F.element_at("__s", -1)
    return last.select(key, a["y"].alias("previous"), b["y"].alias("current"), F.round((b["n"] - a["n"]) * 100 / a["n"], 1).alias("change"))


def assembled_sources(rows: DataFrame, key: list[str], id_: str, ready: Column, stages: str, field: Column, content: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, links, left out) of source rows. A row that isn't ready, lacks a key or has no stage is ``pending``; one whose
    field is null is ``unassigned``; both are in the last frame (id, status). Each other row counts in every stage of its array
    ``stages`` once (``unspecified`` is ``all_stages``). Entries are the exact texts of a key, stage and field, white space at
    their ends aside: text_id, the content of the least id, and the number of sources; links name every source of an entry
    in a row of its own, so a text that a third of the sources share is no list."""
    known = F.coalesce(ready, F.lit(False))
    for k in key:
        known = known & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    known = known & (F.coalesce(F.size(stages), F.lit(0)) > 0)
    marked = rows.withColumn("__field", field).withColumn("__status", F.when(~known, "pending").when(F.col("__field").isNull(), "unassigned"))
    out = marked.where("__status IS NOT NULL").select(id_, F.col("__status").alias("status"))
    stage = F.explode(F.array_distinct(F.transform(stages, lambda s: F.when(s == "unspecified", "all_stages").otherwise(s))))
    text = F.coalesce(F.col(content), F.lit(""))
    used = marked.where("__status IS NULL").select(*key, stage.alias("stage"), F.col("__field").alias("field"), F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256).alias("text_id"), text.alias("content"), id_)
    entries = used.groupBy(*key, "stage", "field", "text_id").agg(F.min_by("content", id_).alias("content"), F.countDistinct(id_).alias("sources"))
    return entries, used.select(*key, "stage", "field", "text_id", id_).distinct(), out
