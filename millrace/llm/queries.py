"""The registered queries of this subpackage and the SQL that some of them have to match."""

from __future__ import annotations

from . import decontamination, filter_audit, hard_negatives, mixing, near_duplicates, pii, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_counts, tool_calls

_MODULES = (suffix_dedup, decontamination, pii, mixing, quality_rules, quality_classifier, tool_calls, near_duplicates, sharding, token_counts, filter_audit, hard_negatives, simhash)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
