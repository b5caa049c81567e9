"""Whole-table operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def append_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns matched by name, absent ones NULL."""
    if not tables:
        raise ValueError("no tables to append")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
