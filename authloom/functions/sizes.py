"""Broadcast only what is known to be small."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 * 1024 * 1024


def literal_rows(spark, rows: list, schema: str) -> DataFrame:
    """Driver-side configuration as a DataFrame, hinted for broadcast when measurably small."""
    text = json.dumps(rows, ensure_ascii=False)
    df = spark.range(1).select(
        F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))
    return F.broadcast(df) if len(text.encode()) <= BROADCAST_BYTES else df
