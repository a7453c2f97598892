"""All queries of the library (without those of the llm subpackage), by name."""

from __future__ import annotations

from . import body_queries, control_queries, event_queries, pass_queries, render_queries, session_queries, state_queries, text_queries

MODULES = (session_queries, text_queries, state_queries, pass_queries, render_queries, body_queries, event_queries, control_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
