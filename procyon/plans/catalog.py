"""All registered queries of the library."""

from . import ingest, streams  # noqa: F401  (they add their queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
