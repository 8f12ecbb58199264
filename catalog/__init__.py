"""Queries over the given tables and their DuckDB twins."""

from .registry import ORACLE, QUERIES  # noqa: F401
from . import text, counts, windowed, stores, templates, neighbours, streams  # noqa: F401
