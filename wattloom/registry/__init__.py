"""Every operator as a named query over the star schema, with the SQL that must agree with it."""

from wattloom.registry import models, series, specs, streams  # noqa: F401  (fill the tables)
from wattloom.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
