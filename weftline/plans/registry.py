"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from weftline.plans import problems, problems_sql, reference, source_queries

# source_queries adds to those of reference.
_MODULES = [(reference.QUERIES, reference.SQL), (problems.QUERIES, problems_sql.SQL)]
__all__ = ["queries", "sql", "source_queries"]


def queries() -> dict:
    return {k: f for q, _ in _MODULES for k, f in q.items()}


def sql() -> dict[str, str]:
    return {k: s for _, x in _MODULES for k, s in x.items()}
