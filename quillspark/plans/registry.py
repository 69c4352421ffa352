"""All queries over the reference tables and the SQL that checks them."""

from __future__ import annotations

from .queries import QUERIES
from .oracle import SQL

__all__ = ["QUERIES", "SQL"]
