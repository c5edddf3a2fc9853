"""Registered queries."""

from postweave.plans.registry import Query


def all_queries() -> dict[str, Query]:
    from postweave.plans import classify_queries, phrase_queries, stream_queries, table_queries, text_queries

    parts = (classify_queries, table_queries, text_queries, phrase_queries, stream_queries)
    return {name: query for part in parts for name, query in part.QUERIES.items()}


__all__ = ["Query", "all_queries"]
