"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from tallymark.llm import boilerplate, confusables, encoding, leakage, mixing, residue, sentences, toxicity, truncation

_MODULES = [encoding, residue, boilerplate, sentences, truncation, confusables, leakage, mixing, toxicity]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
