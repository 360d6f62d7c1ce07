"""Named queries over the given tables."""

from tidemark.registry import labels, ledger, metrics, models, quality, sources, streams, trades, training, windows  # noqa: F401
from tidemark.registry.core import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
