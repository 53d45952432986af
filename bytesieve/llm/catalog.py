"""Queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from bytesieve.llm import (
    op1_queries,
    op2_queries,
    op3_queries,
    op4_queries,
    op5_queries,
    op6_queries,
    op7_queries,
    op8_queries,
    op9_queries,
    op10_queries,
    op11_queries,
    op12_queries,
    op13_queries,
)

MODULES = (op1_queries, op2_queries, op3_queries, op4_queries, op5_queries, op6_queries, op7_queries, op8_queries,
           op9_queries, op10_queries, op11_queries, op12_queries, op13_queries)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
