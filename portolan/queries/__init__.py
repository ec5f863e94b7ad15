"""Queries over the given tables, one per operator, with their checking SQL."""

from importlib import import_module

AREAS = ["graphs", "ranks", "event_queries", "filter_queries", "text_queries", "search_queries", "dependency_queries", "relation_queries", "report_queries", "source_queries"]


def load():
    """Import every area; returns the queries and their SQL."""
    from portolan.queries import registry

    for area in AREAS:
        import_module(f"portolan.queries.{area}")
    return registry.QUERIES, registry.ORACLES
