"""Signals -> query requests, and the event and alert queries themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.text import non_empty, short_hash

FILTERS = (
    "struct<src_ip:string,process:string,log_type:string,since:timestamp_ntz,"
    "rule_id:string,source:string,dst_user:string>"
)


def source_name(col: Column) -> Column:
    """Registry spelling of a source name (`-` and `_` are used for the same source)."""
    return F.replace(col, F.lit("-"), F.lit("_"))


def fresh_signals(signals: DataFrame, now: Column,
                  max_age_seconds: int = fixed.STALE_AFTER_SECONDS) -> DataFrame:
    """Drop signals older than the limit; a missing or unreadable time passes."""
    at = F.col("event_time").try_cast("timestamp")
    return signals.where(at.isNull() | (now - F.make_dt_interval(secs=F.lit(max_age_seconds)) <= at))


def query_requests(signals: DataFrame, case_id: str,
                   limit: int = fixed.REQUEST_LIMIT) -> DataFrame:
    """One evidence request per signal."""
    rule = F.coalesce("detection_rule_id", F.lit(""))
    source = F.coalesce(F.try_element_at("suggested_logs", F.lit(1)), F.lit("wazuh-alerts"))
    is_auth = source == "auth_log"
    process = (
        F.when(rule.contains("SSH"), F.lit("sshd"))
        .when(rule.contains("SUDO"), F.lit("sudo"))
        .when(rule.contains("SU_"), F.lit("su"))
    )
    src_ip = F.when(F.col("src_ip") != fixed.NO_IP, non_empty(F.col("src_ip")))
    nothing = F.lit(None)
    return signals.select(
        F.concat(F.lit("qry-"), short_hash(F.col("signal_id"))).alias("query_id"),
        F.lit(case_id).alias("case_id"),
        "node_id", "signal_id",
        source_name(source).alias("source"),
        F.struct(
            F.when(is_auth, src_ip).alias("src_ip"),
            F.when(is_auth, process).alias("process"),
            nothing.cast("string").alias("log_type"),
            nothing.cast("timestamp_ntz").alias("since"),
            F.when(~is_auth, F.col("rule_id")).alias("rule_id"),
            nothing.cast("string").alias("source"),
            nothing.cast("string").alias("dst_user"),
        ).alias("filters"),
        F.lit(limit).alias("limit"),
    )


def node_targeting(requests: DataFrame, nodes: DataFrame, salts: int = 16) -> DataFrame:
    """Request x node it reaches; a request without a node reaches every node.

    An equi join: each node answers to its own name and to the wildcard. The wildcard is one hot
    key, so it is spread over ``salts`` copies of the (small) node list instead of one task.
    ``nodes`` has one row per ``node_id``.
    """
    answers = nodes.select("node_id", F.explode(F.concat(
        F.array(F.struct(F.col("node_id").alias("_to"), F.lit(0).alias("_salt"))),
        F.transform(F.sequence(F.lit(0), F.lit(salts - 1)),
                    lambda i: F.struct(F.lit("*").alias("_to"), i.alias("_salt"))),
    )).alias("_a")).select("node_id", "_a.*")
    named = non_empty(F.col("node_id"))
    asked = requests.select(
        F.coalesce(named, F.lit("*")).alias("_to"),
        F.when(named.isNull(), F.pmod(F.hash("query_id"), F.lit(salts))).otherwise(F.lit(0))
        .alias("_salt"),
        *[c for c in requests.columns if c != "node_id"],
    )
    return asked.join(answers, ["_to", "_salt"]).select(*requests.columns)


def query_events(events: DataFrame, filters: dict | None = None,
                 limit: int | None = fixed.EVENT_QUERY_LIMIT) -> DataFrame:
    """Events matching the given filters, newest first; a limit of None or <= 0 returns all."""
    filters = filters or {}
    out = events
    for name in ("src_ip", "process", "log_type", "dst_user"):
        if filters.get(name):
            out = out.where(F.col(name) == filters[name])
    if filters.get("since"):
        out = out.where(F.col("timestamp") >= F.lit(filters["since"]).cast("timestamp_ntz"))
    out = out.orderBy(F.desc("timestamp"), F.desc("id"))
    return out.limit(limit) if limit and limit > 0 else out


DEFAULT_FIELDS = ["timestamp", "rule.id", "agent.name", "agent.ip", "full_log"]


def filter_alerts(alerts: DataFrame, time_window: str | None = None,
                  filters: dict | None = None) -> DataFrame:
    """Alert rows inside an inclusive ``"a/b"`` window (ignored unless two parts) and filters."""
    filters = filters or {}
    out = alerts
    parts = (time_window or "").split("/")
    if len(parts) == 2:
        out = out.where(F.col("timestamp").between(parts[0], parts[1]))
    rule_id = filters.get("rule.id") or filters.get("rule_id")
    if rule_id:
        out = out.where(F.col("rule.id") == rule_id)
    if filters.get("source"):
        if "source" not in alerts.columns:
            raise ValueError("a filter on the source needs alerts with a source column")
        out = out.where(F.col("source") == filters["source"])
    return out


def query_alerts(alerts: DataFrame, fields: list[str] | None = None,
                 time_window: str | None = None, filters: dict | None = None,
                 limit: int = fixed.REQUEST_LIMIT) -> DataFrame:
    """Projected alert fields (dotted paths become underscored names), first ``limit`` by time."""
    fields = fields or DEFAULT_FIELDS
    top = filter_alerts(alerts, time_window, filters).orderBy("timestamp", "id").limit(limit)
    return top.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])
