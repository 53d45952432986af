"""Derived tables, registered queries and their SQL twins."""
