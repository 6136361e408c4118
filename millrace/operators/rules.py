"""Predicates, routing and rule labelling. Rules, dictionaries and patterns are parameters."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import tags
from ..functions.text import matches


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


class Dictionary:
    """Names whose mentions are looked for. Each Python worker builds one Aho-Corasick automaton of them, with the first batch
    that needs it, and later tasks of the worker use it again; a text is read once whatever the number of names. A worker
    holds all names, so the dictionary is a bounded parameter: a million names of 12 characters took about 0.4 GB."""

    def __init__(self, names: Iterable[str]):
        self.names = list(dict.fromkeys(n for n in names if n))
        self.key = hashlib.sha256("\0".join(self.names).encode("utf-8", "surrogatepass")).hexdigest()

    def mentions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(place of the name in the dictionary, start, end) of all mentions in the text, overlapping ones too, by their end."""
        automaton = _AUTOMATA.get(self.key)
        if automaton is None:
            if len(_AUTOMATA) > 3:  # a worker that serves many queries keeps the newest few
                _AUTOMATA.pop(next(iter(_AUTOMATA)))
            automaton = ahocorasick.Automaton()
            for i, name in enumerate(self.names):
                automaton.add_word(name, (i, len(name)))
            automaton.make_automaton()
            _AUTOMATA[self.key] = automaton
        if self.names:
            for last, (i, n) in automaton.iter(text):
                yield i, last + 1 - n, last + 1


def longest_alias(aliases: list[tuple[str, str]]):
    """Function text column -> standard name of the longest alias that the text contains in any case (the first listed wins a
    tie); null without one. Aliases are never joined with texts."""
    standards: dict[str, str] = {}
    for alias, standard in aliases:
        standards.setdefault(alias.lower(), standard)
    known = Dictionary(standards)
    names = [standards[n] for n in known.names]

    @F.pandas_udf("string")
    def tag(texts: pd.Series) -> pd.Series:
        best = [max(((e - a, -i) for i, a, e in known.mentions(t)), default=None) if t else None for t in texts]
        return pd.Series([None if b is None else names[-b[1]] for b in best], dtype=object)

    return lambda text: tag(F.lower(text))


def first_category(text: Column, categories: list[tuple[str, str]]) -> Column:
    """The first (name, pattern) category whose pattern the text matches; null without one. Serves names that no alias fits."""
    return F.coalesce(*[F.when(matches(text, pattern), name) for name, pattern in categories])


def contained_aliases(text: Column, aliases: list[str]) -> Column:
    """Aliases of a small dictionary that the text contains, in dictionary order, without a UDF."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, aliases)), lambda a: F.contains(low, a))


def route(body: Column, keyword: Column, context: Column, domains: dict[str, str], reserved: str) -> Column:
    """Labels whose pattern the first text that matches any of them (body, then search keyword, then context) matches; a
    reserved domain in the body blocks all; more than one label adds ``ambiguous``."""
    every = "|".join(domains.values())
    labels = lambda c: tags([(matches(c, p), name) for name, p in domains.items()])
    found = F.when(matches(body, reserved), F.array().cast("array<string>")).when(matches(body, every), labels(body)).when(matches(keyword, every), labels(keyword)).when(matches(context, every), labels(context)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 1, F.array_append(found, F.lit("ambiguous"))).otherwise(found)


def signal_score(text: Column, signals: list[tuple[str, str, int]]) -> tuple[Column, Column]:
    """(names of the signals found, sum of their weights) for (name, pattern, weight) rules."""
    score = F.lit(0)
    for _, pattern, weight in signals:
        score = score + F.when(matches(text, pattern), weight).otherwise(0)
    return tags([(matches(text, p), n) for n, p, _ in signals]), score.cast("long")


def choice_verdict(names: Column, score: Column, intents: dict[str, str], context: list[str], choice: list[str], condition: Column, weak: Column, least: int = 5) -> tuple[Column, Column]:
    """(keep, intents) of a text from its signal names and score. Intents are those of its signals. A text that names a condition
    is kept (intent Need without another). Otherwise it needs a signal of ``context`` and one of ``choice`` or the intent
    Experience or Switch, mustn't be a mere ``weak`` phrase, and is kept from ``least`` points on (intent Decision without another)."""
    has = lambda wanted: F.arrays_overlap(names, F.array(*map(F.lit, wanted)))
    found = F.array_distinct(tags([(F.array_contains(names, n), i) for n, i in intents.items()]))
    moved = [n for n, i in intents.items() if i in ("Experience", "Switch")]
    chosen = has(context) & has([*choice, *moved]) & ~weak
    default = F.when(condition, F.array(F.lit("Need"))).when(chosen, F.array(F.lit("Decision"))).otherwise(F.array().cast("array<string>"))
    return condition | (chosen & (score >= least)), F.when(F.size(found) > 0, found).otherwise(default)


def condition_confidence(own: Column, context: Column, pattern: str, ambiguous: str) -> Column:
    """high: in the own text; medium: there by an ambiguous term only, or both contexts; low: in the context alone."""
    return F.when(matches(own, pattern), "high").when(matches(own, ambiguous) & matches(context, pattern), "medium").when(matches(context, pattern), "low")


def two_level_labels(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Distinct ``primary>secondary`` labels of all (primary, secondary, pattern) rules that hit, in rule order."""
    return F.array_distinct(tags([(matches(text, p), f"{a}>{b}") for a, b, p in rules]))


def first_of(labels: Column, priority: list[str], default: str) -> Column:
    """The first label of a priority list that an array has."""
    out = F.lit(default)
    for name in reversed(priority):
        out = F.when(F.array_contains(labels, name), name).otherwise(out)
    return out


def switch_path(brands: list[str], patterns: tuple[str, ...]):
    """Pandas UDF text -> (source, target): the last match of a sentence pattern with two different brands in its groups
    ``a`` and ``b``; else the first two different brands by place; nulls otherwise."""
    names = "|".join(sorted(map(re.escape, brands), key=len, reverse=True))
    mention = re.compile(names, re.I)
    sentences = [re.compile(p.replace("BRAND", f"(?:{names})"), re.I) for p in patterns]

    @F.pandas_udf("source string, target string")
    def path(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = None
            for s in sentences:
                for m in s.finditer(text or ""):
                    if m["a"].lower() != m["b"].lower() and (found is None or m.start() >= found[0]):
                        found = (m.start(), m["a"].lower(), m["b"].lower())
            if found is None:
                order = list(dict.fromkeys(m[0].lower() for m in mention.finditer(text or "")))
                found = (0, *order[:2]) if len(order) > 1 else (0, None, None)
            out.append(found[1:])
        return pd.DataFrame(out, columns=["source", "target"])

    return path


def mention_spans(symptoms: list[str], outcomes: dict[str, str], negations: list[str], window: int = 30, before: int = 6, onsets: dict[str, str] | None = None):
    """Pandas UDF text -> array of (symptom, start, end, negated, outcome; onset if ``onsets`` are given): longest symptoms first
    without overlap; negated by a word within ``before`` characters ahead; the outcome and the onset (such as before or after
    use, each a pattern) nearest within ``window`` characters, the least name on ties."""
    known = Dictionary(sorted(symptoms, key=lambda s: (-len(s), s)))  # so the place in it is the rank

    def places(low: str, patterns: dict[str, str]) -> tuple[list[tuple[int, int, str]], int]:
        found = sorted((m.start(), m.end(), name) for name, p in patterns.items() for m in re.finditer(p, low))
        return found, max((y - x for x, y, _ in found), default=0)

    def nearest(places: tuple[list[tuple[int, int, str]], int], a: int, b: int) -> str | None:
        found, longest = places
        some = found[bisect_left(found, (a - window - longest,)) : bisect_right(found, (b + window + 1,))]
        near = [(min(abs(x - b), abs(a - y)), name) for x, y, name in some if x <= b + window and y >= a - window and (x >= b or y <= a)]
        return min(near)[1] if near else None

    @F.pandas_udf(f"array<struct<symptom:string,start:int,end:int,negated:boolean,outcome:string{',onset:string' if onsets else ''}>>")
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            low, taken, rows = (text or "").lower(), [], []
            covered = bytearray(len(low))
            for i, a, b in sorted(known.mentions(low)):
                if covered.find(1, a, b) < 0:
                    covered[a:b] = b"\1" * (b - a)
                    taken.append((a, b, known.names[i]))
            outcome_at, onset_at = (places(low, outcomes), places(low, onsets or {})) if taken else (None, None)
            for a, b, w in sorted(taken):
                negated = any(n in low[max(0, a - before) : a] for n in negations)
                rows.append({"symptom": w, "start": a, "end": b, "negated": negated, "outcome": nearest(outcome_at, a, b)} | ({"onset": nearest(onset_at, a, b)} if onsets else {}))
            out.append(rows)
        return pd.Series(out, dtype=object)

    return spans


@dataclass(frozen=True)
class PairRules:
    """What makes two mentions a comparison; all but ``names`` are regular expressions over the lower-cased text."""

    names: dict[str, str]  # mention, lower-cased -> name it stands for
    connector: str  # has to lie between two neighbours
    strong: str  # has to lie there beside a comma
    choice: str  # has to be in the pair's context, which ``before`` and ``after`` characters surround
    leading: str = "(?!)"  # or this in what precedes it
    excluded: str = "(?!)"  # must not be in the context
    compounds: frozenset[tuple[str, str]] = frozenset()  # two mentions that are one name
    phrases: tuple[tuple[str, float], ...] = ()  # (expression with the groups a, b, connector and, if it has one, tail; confidence)
    commas: str = ",\uff0c"
    gap: int = 12
    before: int = 24
    after: int = 36
    most: int = 2  # different names in the context


def comparison_pairs(rules: PairRules):
    """Pandas UDF text -> array of (a, b, confidence). Neighbouring mentions of two names compare (0.9) if a connector joins
    them within ``gap`` characters and the context shows a choice, speaks of these two only and has nothing that is
    excluded. A phrase compares with its own confidence if a known name is in each of its two parts; a phrase joined by a
    comma needs a choice in its tail."""
    mention = re.compile("|".join(sorted(map(re.escape, rules.names), key=len, reverse=True)))
    connector, strong, choice, leading, excluded = map(re.compile, (rules.connector, rules.strong, rules.choice, rules.leading, rules.excluded))
    phrases = [(re.compile(p), c) for p, c in rules.phrases]

    def compares(text: str, found: list[re.Match], x: re.Match, y: re.Match) -> bool:
        between = text[x.end() : y.start()]
        joined = strong if any(c in between for c in rules.commas) else connector
        if len(between) > rules.gap or not joined.search(between) or (x[0], y[0]) in rules.compounds:
            return False
        low, high = max(0, x.start() - rules.before), min(len(text), y.end() + rules.after)
        context = text[low:high]
        if excluded.search(context) or not (choice.search(context) or leading.search(text[low : x.start()])):
            return False
        return len({rules.names[m[0]] for m in found if low <= m.start() and m.end() <= high}) <= rules.most

    def spoken(text: str) -> list[tuple[str, str, float]]:
        out = []
        for phrase, confidence in phrases:
            for m in phrase.finditer(text):
                parts = m.groupdict()
                a, b = (mention.search(parts[g]) for g in "ab")
                names = {rules.names[x[0]] for x in mention.finditer(m[0])}
                unsure = parts["connector"] in rules.commas and not choice.search(parts.get("tail") or "")
                if a and b and rules.names[a[0]] != rules.names[b[0]] and len(names) <= rules.most and not unsure and not excluded.search(m[0]) and (a[0], b[0]) not in rules.compounds:
                    out.append((rules.names[a[0]], rules.names[b[0]], confidence))
        return out

    @F.pandas_udf("array<struct<a:string,b:string,confidence:double>>")
    def pairs(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            low = (text or "").lower()
            found = list(mention.finditer(low))
            rows = [(rules.names[x[0]], rules.names[y[0]], 0.9) for x, y in zip(found, found[1:]) if rules.names[x[0]] != rules.names[y[0]] and compares(low, found, x, y)]
            out.append([dict(zip(("a", "b", "confidence"), r)) for r in rows + spoken(low)])
        return pd.Series(out, dtype=object)

    return pairs


def best_pairs(rows: DataFrame, key: str, a: str = "a", b: str = "b", confidence: str = "confidence") -> DataFrame:
    """One row per key and unordered pair: the greatest confidence."""
    pair = F.array_sort(F.array(a, b))
    return rows.groupBy(key, pair[0].alias("first"), pair[1].alias("second")).agg(F.max(confidence).alias("confidence"))


def keyword_recall(text: Column, keywords: dict[str, dict[str, list[str]]], few: int = 64) -> Column:
    """Array of (category, symptom, matched keywords) for every symptom with a keyword in the lower-cased text, all in the order
    of ``keywords``. Up to ``few`` keywords are tested by built-in functions; more by one automaton, with the same result."""
    if sum(len(words) for symptoms in keywords.values() for words in symptoms.values()) > few:
        return _recall_by_automaton(keywords)(F.lower(text))
    rows = []
    for category, symptoms in keywords.items():
        for symptom, words in symptoms.items():
            hits = contained_aliases(text, words)
            rows.append(F.when(F.size(hits) > 0, F.struct(F.lit(category).alias("category"), F.lit(symptom).alias("symptom"), hits.alias("matched"))))
    return F.array_compact(F.array(*rows))


def _recall_by_automaton(keywords: dict[str, dict[str, list[str]]]):
    groups = [(category, symptom) for category, symptoms in keywords.items() for symptom in symptoms]
    uses: dict[str, list[tuple[int, int]]] = {}  # keyword -> (group, place in it)
    for g, (category, symptom) in enumerate(groups):
        for i, word in enumerate(keywords[category][symptom]):
            uses.setdefault(word, []).append((g, i))
    known = Dictionary(uses)
    everywhere = uses.get("", [])  # any text contains the empty keyword

    @F.pandas_udf("array<struct<category:string,symptom:string,matched:array<string>>>")
    def recall(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rows: dict[int, list[str]] = {}
            if text is not None:
                for g, i in sorted({u for m in {i for i, _, _ in known.mentions(text)} for u in uses[known.names[m]]} | set(everywhere)):
                    rows.setdefault(g, []).append(keywords[groups[g][0]][groups[g][1]][i])
            out.append([{"category": groups[g][0], "symptom": groups[g][1], "matched": matched} for g, matched in rows.items()])
        return pd.Series(out, dtype=object)

    return recall


def search(df: DataFrame, contains: dict[str, str] | None = None, among: dict[str, list] | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
    """Rows that pass every filter given: texts contained (any case), values among a list, ranges (an end may be None)."""
    for c, part in (contains or {}).items():
        df = df.where(F.contains(F.lower(c), F.lit(part.lower())))
    for c, values in (among or {}).items():
        df = df.where(F.col(c).isin(values))
    for c, (low, high) in (between or {}).items():
        df = df.where((F.col(c) >= low) if low is not None else F.lit(True)).where((F.col(c) <= high) if high is not None else F.lit(True))
    return df


def arg_max_label(candidates: dict[str, Column]) -> Column:
    """The name of the greatest value (the first name on ties); null if all are null."""
    rows = [F.when(c.isNotNull(), F.struct(c.cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n"))) for i, (n, c) in enumerate(candidates.items())]
    return F.array_max(F.array_compact(F.array(*rows)))["n"]


def structure_labels(dimensions: list[tuple[str, Column]]) -> Column:
    """``dimension:class`` labels of the dimensions whose class isn't null, in order."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{name}:"), label) for name, label in dimensions]))


def capability_scores(tag_rows: DataFrame, rules: DataFrame, entity: str) -> DataFrame:
    """Capability per entity from tag rows (entity, tag_key, score) and rule rows (rule, tag_key, role, weight) with roles
    required_any, required_all, optional, negative: all required_all tags and one required_any tag (if the rule has any)
    must be there; the score adds weight x tag score, negatives subtract; level by 7 / 4 / 0."""
    needs = rules.groupBy("rule").agg(F.count_if(F.col("role") == "required_all").alias("all_n"), F.count_if(F.col("role") == "required_any").alias("any_n"))
    best = tag_rows.groupBy(entity, "tag_key").agg(F.max("tag_score").alias("tag_score"))
    sign = F.when(F.col("role") == "negative", -1.0).otherwise(1.0)
    hit = best.join(rules, "tag_key").groupBy(entity, "rule").agg(
        F.count_if(F.col("role") == "required_all").alias("has_all"), F.count_if(F.col("role") == "required_any").alias("has_any"), F.sum(sign * F.col("weight") * F.col("tag_score")).alias("score"))
    ok = hit.join(needs, "rule").where((F.col("has_all") == F.col("all_n")) & ((F.col("any_n") == 0) | (F.col("has_any") > 0)) & (F.col("score") > 0))
    return ok.select(entity, "rule", "score", F.when(F.col("score") >= 7, "strong").when(F.col("score") >= 4, "medium").otherwise("weak").alias("level"))


def grouped_attributes(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Array of (kind, attributes found) for every kind of the (kind, attribute, pattern) rules with an attribute in the text."""
    kinds = list(dict.fromkeys(k for k, _, _ in rules))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(tags([(matches(text, p), a) for g, a, p in rules if g == k])).alias("attributes")) for k in kinds])
    return F.filter(rows, lambda r: F.size(r["attributes"]) > 0)


def polarity(text: Column, good: str, bad: str) -> Column:
    g, b = matches(text, good), matches(text, bad)
    return F.when(g & b, "mixed").when(g, "positive").when(b, "negative").otherwise("neutral")
