"""Monitor events from the stage tables and the figures drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.text import short_hash

# --- fixed values: which component emits which event -----------------------------------------
EMITTER = {
    "signal.sent": "DetectionEngine",
    "signal.received": "SignalListener",
    "query.sent": "SignalListener",
    "query.received": "DuckDBSidecar",
    "query.executed": "DuckDBSidecar",
    "result.sent": "DuckDBSidecar",
    "result.received": "QueryResultListener",
    "evidence.saved": "QueryResultListener",
}

BUFFER = 1000
LATEST = 50


def side_of(component: Column) -> Column:
    return F.when(component.isin(fixed.CLIENT_COMPONENTS), F.lit("client")).otherwise(F.lit("server"))


def _emit(df: DataFrame, types: list[str], subject: str, payload: list[str]) -> DataFrame:
    """One monitor event per row and type, exploded from a single pass over the stage table.

    Server components have no node of their own, so their events leave it empty.
    """
    kinds = F.explode(F.array(*[
        F.struct(F.lit(t).alias("event_type"), F.lit(EMITTER[t]).alias("component")) for t in types
    ]))
    rows = df.withColumn("_k", kinds).select("*", "_k.*").drop("_k")
    source = side_of(F.col("component"))
    return rows.select(
        F.concat(F.lit("evt-"), short_hash(F.col("event_type"), F.col(subject))).alias("event_id"),
        "event_type", source.alias("source"), "component",
        F.when(source == "client", F.col("node_id")).otherwise(F.lit("")).alias("node_id"),
        F.col("node_id").alias("subject_node"),
        F.date_format("at", "HH:mm:ss").alias("timestamp"),
        "at",
        F.to_json(F.struct(*payload)).alias("payload"),
    )


def monitor_events(signals: DataFrame, summary: DataFrame) -> DataFrame:
    """All eight event types. ``signals`` needs ``at``; ``summary`` (one row per query) needs
    signal_id, evidence_count, ``at`` and, where it was measured, duration_ms."""
    timed = ["duration_ms"] if "duration_ms" in summary.columns else []
    return (
        _emit(signals, ["signal.sent", "signal.received"], "signal_id", ["signal_id", "rule_id"])
        .unionByName(_emit(summary, ["query.sent", "query.received"], "query_id",
                           ["query_id", "signal_id"]))
        .unionByName(_emit(summary, ["query.executed", "result.sent"], "query_id",
                           ["query_id", *timed, "evidence_count"]))
        .unionByName(_emit(summary, ["result.received", "evidence.saved"], "query_id",
                           ["query_id", "evidence_count"]))
    )


def monitor_counts(events: DataFrame) -> DataFrame:
    """Counts by side and type with subtotals and a grand total."""
    return events.rollup("source", "event_type").agg(F.count("*").alias("events")).select(
        F.coalesce("source", F.lit("*")).alias("source"),
        F.coalesce("event_type", F.lit("*")).alias("event_type"), "events")


def node_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("subject_node").agg(F.count("*").alias("events"))


def monitor_latest(events: DataFrame, n: int = LATEST, buffer: int = BUFFER) -> DataFrame:
    """The latest n events. The view holds ``buffer`` of them; asking for more is an error."""
    if n > buffer:
        raise ValueError(f"the view holds {buffer} events, {n} are asked for")
    return events.orderBy(F.desc("at"), F.desc("event_id")).limit(n)


def funnel(signals: DataFrame, summary: DataFrame, verified: DataFrame) -> DataFrame:
    """Signals -> queries -> answered -> evidence rows -> verdicts per node, with drop-off.

    ``summary`` has one row per query with evidence_count, ``verified`` one per case keyed by the
    query id.
    """
    s = signals.groupBy("node_id").agg(F.count("*").alias("signals"))
    q = summary.join(
        verified.select(F.col("case_key").alias("query_id"), "verified"), "query_id", "left",
    ).groupBy("node_id").agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("evidence_count") > 0).alias("answered"),
        F.sum("evidence_count").alias("evidence_rows"),
        F.count_if(F.coalesce("verified", F.lit(False))).alias("verdicts"),
    )
    out = s.join(q, "node_id", "left").na.fill(0)
    return out.withColumn("unanswered", F.col("queries") - F.col("answered")).withColumn(
        "unverified", F.col("answered") - F.col("verdicts"))


def query_latency(log: DataFrame) -> DataFrame:
    """Per node: queries, failures, mean and maximum milliseconds, last query id.

    ``log``: query_id, node_id, at, duration_ms (integer), ok.
    """
    return log.groupBy("node_id").agg(
        F.count("*").alias("queries"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.floor(F.sum("duration_ms") / F.count("*")).alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.max_by("query_id", F.struct("at", "query_id")).alias("last_query_id"),
    )


def recent_cases(analysed: DataFrame, n: int = 10, node: str | None = None,
                 event_type: str | None = None) -> DataFrame:
    """Last n cases by ``at`` with node and event type, optionally filtered."""
    out = analysed
    if node:
        out = out.where(F.col("node_id") == node)
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    return out.orderBy(F.desc("at"), F.desc("case_key")).limit(n).select(
        "case_key", "node_id", "event_type", "at")


def payload_figures(events: DataFrame) -> DataFrame:
    """Per side and type: events, the evidence rows that their payloads tell of, and payloads that name a signal.

    Payloads of different types have different fields; each is read as a variant.
    """
    body = F.try_parse_json("payload")
    got = events.withColumn("_rows", F.try_variant_get(body, "$.evidence_count", "bigint")).withColumn(
        "_signal", F.try_variant_get(body, "$.signal_id", "string"))
    return got.groupBy("source", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("_rows").alias("evidence_rows"), F.count("_signal").alias("with_signal"))
