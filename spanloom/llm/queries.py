"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import q_chat, q_lattice, q_lm, q_minhash, q_pieces, q_quality, q_spotsigs, q_substring, q_tokens

_MODULES = (q_chat, q_lattice, q_lm, q_minhash, q_pieces, q_quality, q_spotsigs, q_substring, q_tokens)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
