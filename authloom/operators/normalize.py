"""Source-specific evidence -> one flat schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authloom import schemas
from authloom.functions import fixed
from authloom.functions.fields import log_type_severity
from authloom.functions.text import non_empty
from authloom.functions.times import normalize_ts


def _or_blank(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def normalize_auth(evidence: DataFrame, now: Column, offset: str = "+0000",
                   rule_from_signal: DataFrame | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Auth evidence in the common schema; the rule id is the log type. ``keep`` names columns to
    carry along.

    ``rule_from_signal`` (query_id, rule_id) replaces it by the rule that raised the request.
    """
    kind = F.coalesce("log_type", F.lit("unknown"))
    rule = kind
    if rule_from_signal is not None:
        evidence = evidence.join(
            rule_from_signal.select("query_id", F.col("rule_id").alias("_rule")), "query_id", "left")
        rule = F.coalesce("_rule", kind)
    return evidence.select(
        normalize_ts(F.col("timestamp"), now, offset).alias("timestamp"),
        log_type_severity(kind).alias("severity"),
        rule.alias("rule_id"),
        _or_blank("message").alias("description"),
        F.coalesce(non_empty(F.col("src_ip")), F.lit(fixed.NO_IP)).alias("src_ip"),
        "hostname", "evidence_id",
        F.lit("auth_log").alias("source"),
        _or_blank("raw_line").alias("raw_log"),
        _or_blank("raw_ref").alias("raw_ref"),
        _or_blank("lineage_id").alias("lineage_id"),
        _or_blank("query_id").alias("query_id"),
        *keep,
    )


def normalize_alerts(evidence: DataFrame, now: Column, offset: str = "+0000") -> DataFrame:
    """Alert evidence (agent_ip, agent_name, level, full_log names) in the common schema."""
    return evidence.select(
        normalize_ts(F.col("timestamp"), now, offset).alias("timestamp"),
        F.col("level").alias("severity"),
        "rule_id", "description",
        F.coalesce(non_empty(F.col("agent_ip")), F.lit(fixed.NO_IP)).alias("src_ip"),
        F.col("agent_name").alias("hostname"),
        "evidence_id",
        F.lit("wazuh-alerts").alias("source"),
        F.col("full_log").alias("raw_log"),
        _or_blank("raw_ref").alias("raw_ref"),
        _or_blank("lineage_id").alias("lineage_id"),
        _or_blank("query_id").alias("query_id"),
    )


def alert_fields(gateway: DataFrame) -> DataFrame:
    """Gateway evidence under the names :func:`normalize_alerts` reads."""
    return gateway.select(
        "evidence_id", "query_id", "raw_ref", "lineage_id", "timestamp", "rule_id", "description",
        F.col("src_ip").alias("agent_ip"), F.col("hostname").alias("agent_name"),
        F.col("severity").alias("level"), F.col("raw_log").alias("full_log"),
    )


def union_evidence(*frames: DataFrame) -> DataFrame:
    """All evidence in the common schema, duplicates kept."""
    out = frames[0].select(*schemas.EVIDENCE_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*schemas.EVIDENCE_COLUMNS))
    return out
