"""One ad-hoc alert query against the registered sources of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authloom import schemas
from authloom.functions import fixed
from authloom.operators import evidence, requests
from authloom.sources import files


def find_entry(entries: list[dict], node_id: str, source: str) -> dict:
    """First registry row for the node and source; `-` and `_` are the same in source names."""
    wanted = source.replace("-", "_")
    for e in entries:
        if e["node_id"] == node_id and e["source_name"].replace("-", "_") == wanted:
            if not e.get("local_path"):
                raise ValueError(f"source {source!r} of {node_id!r} has no path")
            return e
    raise ValueError(f"source {source!r} is not registered for {node_id!r}")


def answer(spark: SparkSession, entries: list[dict], query_id: str, node_id: str,
           source: str = "wazuh_alerts", time_window: str | None = None,
           filters: dict | None = None, limit: int = fixed.REQUEST_LIMIT, fields: list[str] | None = None,
           base: str | None = None) -> DataFrame:
    """Standard evidence items for the earliest ``limit`` alerts that match, or their ``fields``.

    ``entries`` are flat registry rows with paths relative to ``base``. Filters and the column choice
    reach the scan; a filter on the source is answered by the entry itself.
    """
    entry = find_entry(entries, node_id, source)
    alerts = files.scan_source(spark, [entry], entry["source_name"], schema=schemas.ALERT, base=base)
    alerts = alerts.withColumn("source", F.lit(entry["source_name"]))
    if fields:
        return requests.query_alerts(alerts, fields, time_window, filters, limit)
    rows = requests.filter_alerts(alerts, time_window, filters).orderBy("timestamp", "id").limit(limit)
    return evidence.gateway_evidence(rows, F.lit(query_id), entry["source_name"])
