"""Operators for preparing training text at scale, and their queries.

Nothing else in the library imports this subpackage.
"""

from . import exact_dedup, jaccard, licenses, mixing, neighbours, packing, passages, personal, runs, tokens, toxicity, tries, urls  # noqa: F401
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
