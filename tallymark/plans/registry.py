"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from tallymark.plans import run_queries, snapshot_queries, source_queries

_MODULES = [snapshot_queries, source_queries, run_queries]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
FLAGSHIP = "claim_tiers"
