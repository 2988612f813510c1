"""Registered queries of the question-answering engine and their DuckDB SQL."""

from __future__ import annotations

from lectern.plans import queries_index, queries_state, queries_text

QUERIES: dict = {**queries_text.QUERIES, **queries_index.QUERIES, **queries_state.QUERIES}
ORACLES: dict = {**queries_text.ORACLES, **queries_index.ORACLES, **queries_state.ORACLES}
