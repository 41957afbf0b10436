"""Registry of the queries over the financial-message operators."""

from __future__ import annotations

from tidewire.plans import cash_queries, event_queries, render_queries, source_queries

MODULES = (cash_queries, event_queries, source_queries, render_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
