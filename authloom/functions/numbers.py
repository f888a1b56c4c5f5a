"""Exact integer arithmetic on columns (``/`` would go through doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_of(column: str, size: int | str) -> Column:
    """Number of the block of ``size`` that a whole number falls into."""
    return F.expr(f"`{column}` div {size}")
