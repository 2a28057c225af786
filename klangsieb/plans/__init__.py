"""Query families. Importing this package registers all of them."""

from klangsieb.plans import catalog, curation, joining, loading, scoring, selection, star, streams, structures, timeline, words  # noqa: F401


def all_queries() -> dict:
    return catalog.QUERIES


def all_sql() -> dict:
    return catalog.SQL
