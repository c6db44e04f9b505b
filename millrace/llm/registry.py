"""Queries and SQL of the subpackage."""

from __future__ import annotations

from millrace.llm import boilerplate, cooccurrence, exclude, languages, leakage, lookalikes, packing, spam, splitting

MODULES = (boilerplate, cooccurrence, exclude, languages, leakage, lookalikes, packing, spam, splitting)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
