"""Inventory and sales analytics as Spark DataFrame operators."""

from granary.schema import CANONICAL_FIELDS, REQUIRED_FIELDS, OPTIONAL_FIELDS, Sales

__all__ = ["CANONICAL_FIELDS", "REQUIRED_FIELDS", "OPTIONAL_FIELDS", "Sales"]
