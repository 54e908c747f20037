"""Queries of this subpackage."""

from __future__ import annotations

from samewise.llm import decontamination, editembed, hmm, language, packing, shards, simhash, substrings, tokencount, toxicity

MODULES = [simhash, toxicity, editembed, decontamination, substrings, packing, language, tokencount, hmm, shards]
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
