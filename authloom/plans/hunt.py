"""From events to signals, and from signals to the evidence that answers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authloom.operators import detection, evidence, normalize, requests


def signals(events: DataFrame, rules: list[dict]) -> DataFrame:
    return detection.build_signals(detection.fires(events, rules), rules)


def evidence_for(sig: DataFrame, events: DataFrame,
                 case_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, requests, auth evidence rows)."""
    asked = requests.query_requests(sig, case_id)
    return sig, asked, evidence.auth_evidence(evidence.retrieve_evidence(asked, events, hashed=True))


def case_rows_of(auth_evidence: DataFrame, now: Column) -> DataFrame:
    """Normalised evidence keyed for review: one case per query, arrival order = retrieval rank."""
    flat = normalize.normalize_auth(auth_evidence, now, keep=("node_id", "rank"))
    return flat.withColumnRenamed("rank", "ord").withColumn("case_key", F.col("query_id"))
