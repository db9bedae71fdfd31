"""Importing this module registers every query."""

from . import (  # noqa: F401
    queries_aggregates,
    queries_browse,
    queries_indexes,
    queries_linkage,
    queries_merge,
    queries_pages,
    queries_quality,
    queries_reconcile,
    queries_run,
    queries_scalars,
    queries_scoring,
    queries_sources,
)
