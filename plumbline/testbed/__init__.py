"""Every operator as a query on the given tables, next to independent SQL."""

from plumbline.testbed import accounts, maintenance, metrics, quality, relational, storage  # noqa: F401
from plumbline.testbed.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
