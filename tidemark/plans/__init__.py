"""The named queries over the test tables, by family."""

from . import evaluation, lifecycle, modelling, monitoring, preparation, profiling, selection  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
