"""Every query of the library with the DuckDB SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from glyphmill.plans import audits, files, gates, inputs, reports, roster, rules, scores

_ALL = {**scores.QUERIES, **roster.QUERIES, **reports.QUERIES, **inputs.QUERIES, **rules.QUERIES, **audits.QUERIES, **files.QUERIES, **gates.QUERIES}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
