"""Registered queries over the test tables, each with the SQL a second engine checks it with."""

from . import tender_queries, expression_queries, source_queries, gazette_queries, write_queries  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
