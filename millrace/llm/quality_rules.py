"""Quality rules as a bitmask ledger: every rule is evaluated once per document, failures are kept as bits next to the
measurements, and policies (sets of bits, with a version) are applied to the stored bits alone.

Edge cases: a null or empty text has no words, so it fails ``few_words`` only; texts of any length are measured whole;
repeated rows are measured one by one; an empty table gives an empty ledger; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read

#: Rules in bit order: name and SQL condition over the measurements that marks a failure.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_words > 0 AND 2 * n_symbols > n_words"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
)
#: Policy versions: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "word_length", "duplicate_lines"),
}
_MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the same list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64) + np.uint64(1)
    mixed = ids * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key += mixed[i : i + n] * _MULTIPLIERS[i % 5] + np.uint64(i)
        key ^= key >> np.uint64(29)
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), word_chars, sum(map(text.count, "#*$%&|<>")), len(lines), len(lines) - len(set(lines)), repeated_window_words(words)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measurements and ``failed_bits``, bit i set where RULES[i] fails."""

    @F.pandas_udf(_MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[c.split()[0] for c in _MEASURES.split(", ")], dtype="int64")

    rows = docs.select(F.col(id_col), measured(F.col(text_col)).alias("m")).select(id_col, "m.*")
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << i}L ELSE 0L END" for i, (_, test) in enumerate(RULES))
    return rows.withColumn("failed_bits", F.expr(bits))


def policy_bits(policy: str) -> int:
    """The mask of a policy version."""
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no failed bit lies in the policy's mask. No text is read again."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy_bits(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only this rule rejects (kept if it were dropped)."""
    mask = policy_bits(policy)
    counts = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(RULES) if mask >> i & 1])).alias("r")
    return (
        counts.select("bits", "n", rules)
        .groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(F.sum(F.expr("CASE WHEN bits & r.bit <> 0 THEN n ELSE 0 END")).alias("n_failed"), F.sum(F.expr("CASE WHEN bits = r.bit THEN n ELSE 0 END")).alias("n_only_this_rule"))
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read(spark, sf_dir, "documents")), "v1")
    base = F.col("failed_bits").bitwiseAND(F.lit(policy_bits("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
g AS (
  SELECT rid, s, count(*) OVER (PARTITION BY rid, gram) AS c
  FROM (SELECT rid, unnest(range(1, len(w) - 3)) AS s, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM d WHERE len(w) >= 5)),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(s, s + 5)) AS p FROM g WHERE c > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
         + 4 * (n_words > 0 AND 2 * n_symbols > n_words)::BIGINT
         + 8 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::BIGINT AS bits FROM m)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, (bits & 7) = 0 AS kept,
       (bits + 16 * coalesce((SELECT n_lines >= 4 AND 2 * l.n_dup_lines > n_lines FROM l JOIN d ON l.rid = d.rid WHERE d.doc_id = b.doc_id LIMIT 1), false)::BIGINT)::BIGINT AS failed_bits
FROM b
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": OP5_SQL}
