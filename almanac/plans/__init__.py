"""All registered queries of the listing engine."""

from . import ingest, listing, merging, publication, regions, text
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "ingest", "listing", "merging", "publication", "regions", "text"]
