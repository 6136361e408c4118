"""Registered queries over the test tables, with the SQL each has to match."""

from . import aggregates, incremental, joins, parsing, ranking, rules, similarity, sources, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
