"""All registered queries."""

from privatrail.plans import text, store, web, history, policy, forms, stream, decisions  # noqa: F401, I001
from privatrail.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
