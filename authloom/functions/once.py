"""Keeping expensive derived columns from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Same rows and columns, with everything except ``keys`` fixed at this point of the plan.

    The optimizer moves a filter on a derived column below the projections that derive it and
    copies their expressions on the way. With staged regex parsing that multiplies the regex work
    (and the plan) with every stage. A one-element generator is not crossed by filters on its
    output, while filters on ``keys`` still reach the scan.
    """
    derived = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.inline_outer(F.array(F.struct(*derived)))).select(*df.columns)
