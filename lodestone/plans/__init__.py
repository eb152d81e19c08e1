"""Plans: the queries of the engine and their SQL counterparts."""

from __future__ import annotations


def all_queries() -> dict:
    from lodestone.plans import files, parsed, queries

    del files, parsed
    return dict(queries.QUERIES)


def all_sql() -> dict:
    from lodestone.plans import files, parsed, queries

    del files, parsed
    return dict(queries.SQL)
