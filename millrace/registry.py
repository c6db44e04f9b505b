"""Queries and SQL of the core."""

from __future__ import annotations

from millrace.operators import blocks, documents, files, markdown, pages, posts, site, sync, tags, timestamps
from millrace.streaming import sync as streams

MODULES = (blocks, documents, files, markdown, pages, posts, site, streams, sync, tags, timestamps)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
