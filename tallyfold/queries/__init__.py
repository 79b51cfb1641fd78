"""The queries of the reference's operators, by name; each takes (spark, sf_dir)."""

from tallyfold.queries import discovery, facets, listings, models, pages, places, retrieval, sources, streams, texts, upkeep  # noqa: F401
from tallyfold.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
