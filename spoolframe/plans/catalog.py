"""All queries of the library over the shared tables, and their SQL twins."""

from __future__ import annotations

from . import containers, details, records, recordings, relations, rules, selection

MODULES = [selection, rules, relations, containers, records, recordings, details]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
