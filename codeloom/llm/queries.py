"""Registered queries of this package, gathered from its modules."""

from __future__ import annotations

from codeloom.llm import doc_pairs, languages, leakage, neighbours, packing, parse_check, secrets, splitting, written_by_hand

_MODULES = [doc_pairs, languages, leakage, neighbours, packing, secrets, written_by_hand, splitting, parse_check]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
