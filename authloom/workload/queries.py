"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authloom import schemas
from authloom.functions import fields, fixed
from authloom.functions.sizes import literal_rows
from authloom.functions.text import non_empty
from authloom.functions.times import normalize_ts, parse_any_ts
from authloom.operators import (
    detection, evidence, messages, monitoring, normalize, parsing, readiness, reporting, requests,
    rules, triage, verification,
)
from authloom.plans import cases as case_plan
from authloom.plans import gateway, hunt
from authloom.sources import files, registry, sinks
from authloom.sources.scratch import materialize, shared_dir
from authloom.streaming import detect, ingest, lineage
from authloom.workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-01-15 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def named(name: str):
    """Register under a name the module already uses for the function being exercised."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def at(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


def second(col: str = "timestamp"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def joined(col) -> F.Column:
    return F.array_join(col, "; ")


# --- sources and sinks -----------------------------------------------------------------------

def _written_logs(spark, sf) -> tuple[str, dict[str, str]]:
    """Log lines as text files per node, with blank lines in between."""
    base = shared_dir(spark) + "/logs"
    lines = t.auth_lines(spark, sf).select(
        "node_id",
        F.when(F.col("line_no") % 89 == 3, F.concat("value", F.lit("\n   "))).otherwise(F.col("value"))
        .alias("value"))
    lines.write.partitionBy("node_id").text(base)
    nodes = {f"{base}/node_id=node-{i}": f"node-{i}" for i in range(3)}
    return base, nodes


@query
def auth_lines(spark, sf):
    _, nodes = _written_logs(spark, sf)
    return files.read_auth_lines(spark, nodes).select("node_id", "value")


@query
def auth_line_numbers(spark, sf):
    _, nodes = _written_logs(spark, sf)
    numbered = files.number_lines(files.read_auth_lines(spark, nodes))
    per_file = numbered.groupBy("node_id", "file").agg(
        F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"),
        F.count_distinct("line_no").alias("u"))
    return per_file.groupBy("node_id").agg(
        F.sum("n").alias("lines"),
        F.bool_and((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("u") == F.col("n")))
        .alias("dense"))


@query
def stream_ingest_latest(spark, sf):
    """A tail that starts at the end: what was there before its start is not read."""
    out, lines = shared_dir(spark), t.auth_lines(spark, sf).select("node_id", "line_no", "value")
    nodes = {f"{out}/logs/node_id=node-{i}": f"node-{i}" for i in range(3)}
    lines.where("line_no % 2 = 0").drop("line_no").write.partitionBy("node_id").text(f"{out}/logs")
    time.sleep(1.1)  # files carry the time they were written at, and the start is a whole second
    since = spark.sql("SELECT date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss\") AS s").first().s
    time.sleep(1.1)
    lines.where("line_no % 2 = 1").drop("line_no").write.mode("append").partitionBy("node_id").text(f"{out}/logs")
    tail = ingest.stream_auth_lines(spark, nodes, start="latest", since=since)
    ingest.to_table(tail, f"{out}/lines", f"{out}/ck").awaitTermination()
    return spark.read.parquet(f"{out}/lines").select("node_id", "value")


@query
def stream_ingest(spark, sf):
    base, nodes = _written_logs(spark, sf)
    out = shared_dir(spark)
    ingest.tail_to_table(spark, nodes, f"{out}/lines", f"{out}/ck")
    return spark.read.parquet(f"{out}/lines").select("node_id", "value")


def _written_alerts(spark, sf) -> str:
    path = shared_dir(spark) + "/alerts"
    whole = t.alerts(spark, sf)
    doc = F.to_json(F.struct(*[c for c in whole.columns if c != "node_id"]))
    cut = F.expr("CAST(substr(id, 4) AS BIGINT) % 53 = 0")
    whole.select(F.when(cut, F.substring(doc, 1, 60)).otherwise(doc).alias("value")).write.text(path)
    return path


@query
def alerts_scan(spark, sf):
    good, _ = files.read_alerts(spark, _written_alerts(spark, sf))
    return good.select(
        "id", "timestamp", F.col("rule.id").alias("rule_id"), F.col("rule.level").alias("rule_level"),
        F.col("agent.name").alias("agent_name"), F.col("agent.ip").alias("agent_ip"), "full_log")


@query
def alerts_unreadable(spark, sf):
    _, broken = files.read_alerts(spark, _written_alerts(spark, sf))
    return broken.groupBy(F.length("line").cast("bigint").alias("line_length")).agg(
        F.count("*").alias("lines"))


@query
def evidence_scan(spark, sf):
    """Evidence written as JSON array files, one per task, and read back."""
    path = shared_dir(spark) + "/evidence"
    rows = t.case_evidence(spark, sf).select(*schemas.EVIDENCE_COLUMNS)
    doc = rows.select(F.to_json(F.struct("*")).alias("j"), F.spark_partition_id().alias("p"),
                      F.floor(F.monotonically_increasing_id() / 1000).alias("chunk"))
    arrays = doc.groupBy("p", "chunk").agg(F.concat(
        F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    # every array becomes a document of its own; multi-line JSON reads one value per file
    arrays.select("value", F.concat_ws("-", "p", "chunk").alias("doc")).write.partitionBy("doc").text(path)
    return files.read_evidence(spark, path).select(*schemas.EVIDENCE_COLUMNS)


@query
def registry_flat(spark, sf):
    return registry.parse_registry(t.registry_docs(spark, sf)).select(
        "entry_no", "node_id", F.col("source_no").cast("bigint").alias("source_no"), "source_name",
        "local_path", "format", "retention_days")


@query
def federated_scan(spark, sf):
    """The auth_log source of three nodes in three formats, one path with blanks and one relative."""
    out = shared_dir(spark)
    lines = t.auth_lines(spark, sf)
    entries = []
    for i, fmt in enumerate(["syslog", "parquet", "json"]):
        part = lines.where(F.col("node_id") == f"node-{i}").select("value")
        name = ["logs of node+0 100%", "node-1", "node-2"][i]
        {"syslog": part.write.text, "parquet": part.write.parquet, "json": part.write.json}[fmt](f"{out}/{name}")
        entries.append({"node_id": f"node-{i}", "source_name": "auth_log", "format": fmt,
                        "local_path": f"./{name}" if i == 1 else f"{out}/{name}"})
    return files.scan_source(spark, entries, "auth_log", schema="value string", base=out).select("node_id", "value")


def _sink_rows(spark, sf):
    """Evidence with the stored time forms and some misfits."""
    return t.case_evidence(spark, sf).withColumns({
        "timestamp": F.expr(
            "CASE WHEN ord % 5 = 0 THEN CAST(1704067200000 + ord AS STRING) ELSE replace(timestamp, '.250000Z', '.250Z') END"),
        "severity": F.expr("CASE WHEN ord % 83 = 0 THEN 'high' ELSE CAST(severity AS STRING) END"),
        "src_ip": F.expr("CASE WHEN ord % 79 = 0 THEN '10.0.0.999' WHEN ord % 77 = 0 THEN 'fe80::1' ELSE src_ip END"),
    })


@query
def evidence_conform(spark, sf):
    return sinks.conform_evidence(_sink_rows(spark, sf)).select(
        "ord", F.unix_micros("event_time").alias("event_us"), "severity_value", "src_ip", "problem")


@query
def bulk_split_counts(spark, sf):
    return sinks.bulk_counts(sinks.conform_evidence(_sink_rows(spark, sf)))


@query
def sink_roundtrip(spark, sf):
    """Signals and evidence written to day-partitioned tables and read back per day."""
    base = shared_dir(spark)
    ev = t.case_evidence(spark, sf).withColumn(
        "at", F.coalesce(parse_any_ts(F.col("timestamp")), F.lit("2024-01-01").cast("timestamp")))
    sinks.write_tables({"signals": _signals(spark, sf).withColumn(
        "at", F.col("event_time").cast("timestamp")), "evidence": ev}, base, "run-1")
    return sinks.read_table(spark, base, "signals").groupBy(F.lit("signals").alias("name"), "dt").agg(
        F.count("*").alias("n")).unionByName(
        sinks.read_table(spark, base, "evidence").groupBy(F.lit("evidence").alias("name"), "dt").agg(
            F.count("*").alias("n"))).select("name", F.col("dt").cast("string").alias("dt"), "n")


@query
def latest_run(spark, sf):
    runs = t.table(spark, sf, "events").selectExpr(
        "event_id", "date_format(ts, 'yyyyMMdd_HH') AS run_id")
    return sinks.latest_run(runs).select("run_id", "event_id")


def _write_runs(spark, sf):
    """Three loads: a whole one, one that fails after its first table, and one that is repeated."""
    base = shared_dir(spark)
    sig = _signals(spark, sf).withColumn("at", F.col("event_time").cast("timestamp"))
    # the evidence of the chain isn't loaded here, so it isn't retrieved either
    asked = t.asked_requests(spark, sf).join(sig.select("signal_id", "at"), "signal_id").select("query_id", "signal_id", "at")
    late = sig.where("rule_level >= 5")
    sinks.write_tables({"signals": sig, "evidence": asked}, base, "run-1")
    try:
        sinks.write_tables({"signals": sig, "none": asked}, base, "run-3")
    except ValueError:
        pass
    for _ in range(2):
        sinks.write_tables({"signals": late, "evidence": asked}, base, "run-2")
    return base


@query
def committed_runs(spark, sf):
    """Rows per run and table after a failed and a repeated load, as counted while writing and as read back."""
    base = _write_runs(spark, sf)
    told = sinks.runs(spark, base).select("run_id", F.explode("tables").alias("name", "counted"))
    held = None
    for name in ("signals", "evidence"):
        one = sinks.read_table(spark, base, name).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        held = one if held is None else held.unionByName(one)
    return told.join(held, ["run_id", "name"], "full").select("run_id", "name", "counted", "n")


@query
def latest_table(spark, sf):
    """The latest committed run of a table."""
    return sinks.read_table(spark, _write_runs(spark, sf), "signals", latest=True).select("run_id", "signal_id", "rule_level")


@query
def load_counts(spark, sf):
    """Counters of two loads, taken by the pass that writes: evidence that fits or not, lines parsed or not."""
    out = shared_dir(spark)
    stored = sinks.load_evidence(_sink_rows(spark, sf), f"{out}/evidence", "run-1")
    lines = parsing.load_lines(t.parsed_lines(spark, sf), f"{out}/events")
    back = spark.read.parquet(f"{out}/evidence").groupBy("fits").agg(F.count("*").alias("n"))
    counted = {**stored, **lines}
    return literal_rows(spark, [{"name": k, "n": v} for k, v in counted.items()], "name string, n bigint").unionByName(
        back.select(F.concat(F.lit("read back "), F.col("fits").cast("string")).alias("name"), "n"))


@query
def evidence_search_files(spark, sf):
    """Search over a table of many files, of which a text index leaves those that may hold the text."""
    out = shared_dir(spark)
    (t.case_evidence(spark, sf).repartitionByRange(12, "ord").write.parquet(f"{out}/evidence"))
    sinks.write_text_index(spark, f"{out}/evidence", "description", f"{out}/index")
    found = None
    for needle in ("告警 12", "告警 77", "告警 5", "警"):
        one = sinks.search_files(spark, f"{out}/evidence", f"{out}/index", "description", needle, {"rule_id": "5503"}, 10, ["ord"])
        one = one.select(F.lit(needle).alias("needle"), "case_key", "ord", "evidence_id", "description")
        found = one if found is None else found.unionByName(one)
    return found


@query
def evidence_search(spark, sf):
    return sinks.search(t.case_evidence(spark, sf), {"rule_id": "5503"}, ("description", "告警 1"),
                        size=10, order=["ord"]).select("case_key", "ord", "evidence_id", "description")


# --- parsing and scalar functions ------------------------------------------------------------

@query
def parse_header(spark, sf):
    p = parsing.parse_header(t.auth_lines(spark, sf)).where("header_ok")
    return p.select("node_id", "line_no", "month", "day", "hostname", "process", "pid_text", "message")


@query
def syslog_timestamp(spark, sf):
    p = t.parsed_lines(spark, sf)
    return p.select("line_no", second().alias("ts"))


def _classified(spark, sf, process):
    return t.parsed_lines(spark, sf).where(F.col("process") == process).select(
        "line_no", "log_type", "dst_user", "src_ip", "src_port")


@query
def classify_sshd(spark, sf):
    return _classified(spark, sf, "sshd")


@query
def classify_sudo(spark, sf):
    return _classified(spark, sf, "sudo")


@query
def classify_su(spark, sf):
    return _classified(spark, sf, "su")


@query
def classify_other(spark, sf):
    return t.parsed_lines(spark, sf).where(~F.col("process").isin("sshd", "sudo", "su")).select(
        "line_no", "process", "log_type", "dst_user")


@query
def classify_events(spark, sf):
    return t.parse_events(spark, sf).select(
        "node_id", "id", second().alias("ts"), "hostname", "process", "pid", "message", "src_ip",
        "src_port", "dst_user", "log_type", "raw_line")


@query
def parse_rejects(spark, sf):
    _, rejects = parsing.split_rejects(t.parsed_lines(spark, sf))
    return rejects.select("node_id", "line_no", "reject_reason")


@query
def ingest_stats(spark, sf):
    return parsing.ingest_stats(t.parsed_lines(spark, sf), at(), 5 * t.DAY)


@query
def event_ids(spark, sf):
    events, _ = parsing.split_rejects(t.stored(spark, sf, "parsed", t.parsed_lines))
    return parsing.assign_ids(events, block=500).select("node_id", "file", "line_no", "id")


def _stamps(spark, sf):
    return t.table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN iso || 'Z'
           WHEN 3 THEN iso || '+08:00' WHEN 4 THEN iso || '-0330' WHEN 5 THEN ' ' || iso || ' '
           ELSE plain END AS stamp""".replace("iso", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")
        .replace("plain", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"))


@named("normalize_ts")
def normalize_stamps(spark, sf):
    return _stamps(spark, sf).select(
        "event_id", normalize_ts(F.col("stamp"), F.lit("2024-02-01T00:00:00+0000")).alias("stamp"))


@named("parse_any_ts")
def parse_any_stamp(spark, sf):
    return t.case_evidence(spark, sf).select(
        "ord", F.unix_micros(parse_any_ts(F.col("timestamp"))).alias("us"))


@query
def extract_fields(spark, sf):
    raw = t.table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'x' ELSE CAST(event_id % 15 AS STRING) END AS severity",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 9 AS STRING) END AS level",
        "CASE WHEN event_id % 5 = 0 THEN '' ELSE '10.1.1.1' END AS src_ip",
        "CASE WHEN event_id % 2 = 0 THEN NULL ELSE '10.2.2.2' END AS agent_ip",
        "'10.3.3.3' AS `data.srcip`",
        "CASE WHEN event_id % 3 = 0 THEN 'h' END AS hostname",
        "CASE WHEN event_id % 4 = 0 THEN 'a' END AS agent_name",
    )
    return raw.select("event_id", fields.severity_of(raw).alias("severity"),
                      fields.src_ip_of(raw).alias("src_ip"), fields.hostname_of(raw).alias("hostname"))


@query
def json_roundtrip(spark, sf):
    events = t.auth_events(spark, sf)
    back, _ = messages.decode(messages.to_message(events), "id bigint, timestamp string, process string, src_ip string, src_port int")
    return back.select("id", F.substring(F.replace("timestamp", F.lit("T"), F.lit(" ")), 1, 19).alias("ts"),
                       "process", "src_ip", "src_port")


_MESSAGE = "signal_id string, rule_id string, matched_count bigint"


@query
def decode_messages(spark, sf):
    good, _ = messages.decode(t.bus_messages(spark, sf), _MESSAGE)
    return good.select("seq", "stream", "signal_id", "rule_id", "matched_count")


@query
def verdict_json(spark, sf):
    return fields.parse_replies(t.replies(spark, sf)).select(
        "case_key", F.col("verdict").isNotNull().alias("readable"), "verdict.priority",
        "verdict.event_type", "verdict.summary", joined("verdict.suggested_actions").alias("actions"))


# --- filters and projections -----------------------------------------------------------------

@query
def query_events(spark, sf):
    return requests.query_events(
        t.auth_events(spark, sf), {"process": "sshd", "log_type": "ssh_accepted", "since": "2024-01-05 00:00:00"}, 50,
    ).select("id", second().alias("ts"), "src_ip", "log_type")


@query
def query_alerts(spark, sf):
    return requests.query_alerts(
        t.alerts(spark, sf), ["timestamp", "rule.id", "agent.name", "agent.ip", "full_log"],
        "2024-01-03T00:00:00/2024-01-20T00:00:00", {"rule.id": "5710"}, 20)


def _signals(spark, sf):
    return t.signals(spark, sf)


@query
def fresh_signals(spark, sf):
    odd = _signals(spark, sf).withColumn("event_time", F.expr(
        "CASE WHEN matched_count % 5 = 0 THEN 'not-a-time' WHEN matched_count % 7 = 0 THEN NULL ELSE event_time END"))
    return requests.fresh_signals(odd, F.lit(NOW).cast("timestamp")).select("signal_id", "event_time")


@query
def retention_filter(spark, sf):
    return parsing.retain(t.auth_events(spark, sf), at(), 7 * t.DAY).select("id", second().alias("ts"))


@query
def registry_retention(spark, sf):
    reg = registry.parse_registry(t.registry_docs(spark, sf))
    return parsing.retain_by_registry(t.auth_events(spark, sf), reg, at("2024-01-31 00:00:00")).select(
        "node_id", "id")


@query
def query_requests(spark, sf):
    return requests.query_requests(_signals(spark, sf), t.CASE_ID).select(
        "query_id", "case_id", "node_id", "signal_id", "source",
        F.col("filters.src_ip").alias("src_ip"), F.col("filters.process").alias("process"),
        F.col("filters.rule_id").alias("rule_id"), "limit")


@query
def severity_level(spark, sf):
    words = t.table(spark, sf, "orders").selectExpr("o_orderkey", "lower(split(o_orderpriority, '-')[1]) AS word")
    return words.select("o_orderkey", "word", fields.severity_level(F.col("word")).alias("level"))


@query
def signals_build(spark, sf):
    return hunt.signals(t.auth_events(spark, sf), t.rules()).withColumn("suggested_logs", joined("suggested_logs"))


@query
def node_targeting(spark, sf):
    asked = t.table(spark, sf, "orders").selectExpr(
        "'qry-' || o_orderkey AS query_id",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'node-' || o_orderkey % 40 END AS node_id")
    nodes = registry.parse_registry(t.registry_docs(spark, sf)).select("node_id").distinct()
    return requests.node_targeting(asked, nodes)


# --- joins -----------------------------------------------------------------------------------

@query
def rule_matches(spark, sf):
    return t.matches(spark, sf).select("node_id", "id", "rule_id", "group_key")


@query
def rule_matches_large_catalog(spark, sf):
    """The same rules within a catalog of a hundred, half of them with nulls for defaults."""
    more = [{"id": f"R{i}", "match": {"process": "sshd" if i % 2 else f"daemon{i}", "patterns": [f"no such text {i}"]},
             "threshold": {"count": None, "window_seconds": None, "group_by": None} if i % 2 else None,
             "cooldown_seconds": None} for i in range(100 - len(t.rules()))]
    return rules.match_rules(t.auth_events(spark, sf), more[:40] + t.rules() + more[40:]).select(
        "node_id", "id", "rule_id", "group_key")


@query
def catalog_matches(spark, sf):
    """A catalog table of one rule per part, found by pieces of their patterns."""
    return rules.match_catalog(t.auth_events(spark, sf), t.part_catalog(spark, sf)).select(
        "node_id", "id", "rule_id", "group_key", "need", "window_seconds")


@query
def catalog_windows(spark, sf):
    """Sliding counts of that catalog: three hundred window lengths in one frame."""
    return detection.threshold_hits(t.auth_events(spark, sf), t.part_catalog(spark, sf)).select(
        "node_id", "rule_id", "group_key", F.timestamp_micros("us").alias("t"), "window_count").withColumn("t", second("t"))


@query
def rule_group_columns(spark, sf):
    """Rules that group by columns other than address and user."""
    own = t.rules()
    for rule, column in zip(own, ["hostname", "log_type", None, "pid", "hostname"]):
        rule["threshold"]["group_by"] = column
    return detection.group_stats(t.auth_events(spark, sf), own).select(
        "node_id", "rule_id", "group_key", "matched_count")


@query
def retrieve_evidence(spark, sf):
    events = t.auth_events(spark, sf)
    asked = requests.query_requests(_signals(spark, sf), t.CASE_ID)
    return evidence.retrieve_evidence(asked, events).select("query_id", "node_id", "rank", "id")


@query
def retrieve_everything(spark, sf):
    """Requests without a limit, by user and since a time, over all nodes."""
    events = t.auth_events(spark, sf)
    asked = t.table(spark, sf, "supplier").selectExpr(
        "'qry-' || s_suppkey AS query_id", "'node-' || s_suppkey % 3 AS node_id", "'auth_log' AS source",
        """named_struct('src_ip', CASE WHEN s_suppkey % 4 > 0 THEN '10.0.' || s_suppkey div 256 || '.' || s_suppkey % 256 END,
            'process', CASE WHEN s_suppkey % 2 = 0 THEN 'sshd' END,
            'log_type', CASE WHEN s_suppkey % 4 = 0 THEN 'ssh_scan' END,
            'since', TIMESTAMP_NTZ'2024-01-10 00:00:00') AS filters""",
        "0 AS limit")
    return evidence.retrieve_evidence(asked, events).select("query_id", "id")


@query
def retrieve_mixed(spark, sf):
    """One batch of requests with absent, small, large and no limits, empty filters and users."""
    asked = t.table(spark, sf, "supplier").selectExpr(
        "'qry-' || s_suppkey AS query_id", "'node-' || s_suppkey % 3 AS node_id", "'auth_log' AS source",
        """named_struct('src_ip', CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '10.0.0.' || s_suppkey % 256 END,
            'process', CASE WHEN s_suppkey % 2 = 0 THEN 'su' END,
            'dst_user', CASE WHEN s_suppkey % 5 < 4 THEN 'user' || s_suppkey % 100 END) AS filters""",
        "CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 500 ELSE -(s_suppkey % 2) END AS limit")
    return evidence.retrieve_evidence(asked, t.auth_events(spark, sf)).select("query_id", "rank", "id")


def _source_requests(spark, sf):
    return t.table(spark, sf, "orders").selectExpr(
        "'qry-' || o_orderkey AS query_id", "'node-' || o_orderkey % 40 AS node_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'auth_log' WHEN 1 THEN 'wazuh_alerts' ELSE 'nginx_access' END AS source")


@query
def registry_lookup(spark, sf):
    asked = _source_requests(spark, sf)
    reg = registry.parse_registry(t.registry_docs(spark, sf))
    return registry.registry_lookup(asked, reg).select("query_id", "local_path", "format", "error")


@query
def registry_file_lookup(spark, sf):
    """The same lookup against registry files, one per node, each a list of entries."""
    path = shared_dir(spark) + "/registry"
    docs = t.registry_docs(spark, sf).withColumn("node", F.get_json_object("doc", "$.node_id"))
    docs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("entry_no", "doc"))).alias("d")).select(
        "node", F.concat(F.lit("["), F.array_join(F.transform("d", lambda x: x["doc"]), ",\n"), F.lit("]")).alias("value"),
    ).write.partitionBy("node").text(path)
    return registry.registry_lookup(_source_requests(spark, sf), registry.load_registry(spark, path)).select(
        "query_id", "local_path", "format", "error")


@query
def dangling_refs(spark, sf):
    return verification.dangling_refs(t.cited_refs(spark, sf), t.case_evidence(spark, sf)).select(
        "case_key", "evidence_id")


def _chain(spark, sf):
    return t.chain(spark, sf)


@query
def lineage_chain(spark, sf):
    sig, asked, ev = _chain(spark, sf)
    return evidence.lineage_chain(sig, asked, ev)


@query
def lookup_enrich(spark, sf):
    """Rule -> event type, priority and advice; log type -> severity, without any join."""
    events = t.case_evidence(spark, sf)
    kind = F.coalesce(triage.lookup(F.col("rule_id"), fixed.TRIAGE_EVENT_TYPE), F.lit("unknown"))
    return events.select(
        "ord", kind.alias("event_type"),
        triage.lookup(F.col("rule_id"), fixed.TRIAGE_PRIORITY).alias("priority"),
        fields.log_type_severity(F.col("rule_id")).alias("log_severity"),
        joined(triage.actions_for(kind)).alias("actions"))


@query
def registry_checks(spark, sf):
    reg = registry.parse_registry(t.registry_docs(spark, sf))
    return registry.registry_checks(t.clients(spark, sf), reg)


# --- detection -------------------------------------------------------------------------------

@query
def rule_catalog(spark, sf):
    return rules.parse_catalog(t.rule_docs(spark, sf)).withColumns({
        "patterns": joined("patterns"), "suggested_logs": joined("suggested_logs")})


@query
def threshold_snapshot(spark, sf):
    return detection.threshold_snapshot(t.auth_events(spark, sf), t.rules(), at()).where(
        F.col("group_key") != fixed.GLOBAL_GROUP)


@query
def threshold_global(spark, sf):
    return detection.threshold_snapshot(t.auth_events(spark, sf), t.rules(), at()).where(
        F.col("group_key") == fixed.GLOBAL_GROUP)


def _hits(spark, sf):
    return detection.threshold_hits(t.auth_events(spark, sf), t.rules())


@query
def threshold_sliding(spark, sf):
    return _hits(spark, sf).select(
        "node_id", "rule_id", "group_key", F.timestamp_micros("us").alias("t"), "n", "window_count",
    ).withColumn("t", second("t"))


@query
def cooldown_fires(spark, sf):
    return detection.fires(t.auth_events(spark, sf), t.rules()).select(
        "node_id", "rule_id", "group_key", second().alias("t"), "window_count")


@query
def detect_stats(spark, sf):
    return detection.detect_stats(t.auth_events(spark, sf), t.rules())


@query
def signal_group_stats(spark, sf):
    return detection.group_stats(t.auth_events(spark, sf), t.rules()).withColumns({
        "first_time": second("first_time"), "last_time": second("last_time")})


# --- evidence and normalisation --------------------------------------------------------------

@query
def evidence_auth(spark, sf):
    asked = requests.query_requests(_signals(spark, sf), t.CASE_ID)
    return evidence.auth_evidence(evidence.retrieve_evidence(asked, t.auth_events(spark, sf), hashed=True)).drop("rank")


def _alert_requests(spark, sf):
    return t.alerts(spark, sf).select("node_id", F.col("rule.id").alias("rid")).distinct().selectExpr(
        "'qry-' || node_id || '-' || rid AS query_id", "node_id", "'wazuh_alerts' AS source",
        "named_struct('rule_id', rid) AS filters")


@query
def evidence_alerts(spark, sf):
    found = evidence.retrieve_alerts(_alert_requests(spark, sf), t.alerts(spark, sf))
    return evidence.alert_evidence(found)


def _gateway(spark, sf, alerts=None):
    return evidence.gateway_evidence(
        alerts or t.alerts(spark, sf), F.concat(F.lit("qry-"), F.col("node_id"), F.lit("-"), F.col("rule.id")))


@query
def evidence_gateway(spark, sf):
    return _gateway(spark, sf)


@query
def tamper_check(spark, sf):
    """Evidence altered after the fact is found again."""
    ev = _chain(spark, sf)[2]
    altered = ev.withColumn("message", F.when(F.col("pid") % 6 == 0, F.lit("nothing happened"))
                            .otherwise(F.col("message")))
    return evidence.tampered(altered).select("evidence_id", "query_id")


@query
def query_summary(spark, sf):
    _, asked, ev = _chain(spark, sf)
    return evidence.query_summary(asked, ev)




def _now_text():
    return F.lit("2024-02-01T00:00:00+0000")


@query
def normalize_auth(spark, sf):
    return normalize.normalize_auth(_chain(spark, sf)[2], _now_text())


@query
def normalize_by_signal(spark, sf):
    sig, asked, ev = _chain(spark, sf)
    link = asked.select("query_id", "signal_id").join(sig.select("signal_id", "rule_id"), "signal_id")
    return normalize.normalize_auth(ev, _now_text(), rule_from_signal=link).select(
        "evidence_id", "rule_id", "severity")


@query
def normalize_alerts(spark, sf):
    return normalize.normalize_alerts(normalize.alert_fields(_gateway(spark, sf)), _now_text())


@query
def normalized_union(spark, sf):
    # of both kinds of evidence it reads four columns
    found, alerts = t.unless_stored(spark, sf, "evidence", t.answers), t.unless_stored(spark, sf, "alerts", t.made_alerts)
    both = normalize.union_evidence(
        normalize.normalize_auth(found, _now_text()),
        normalize.normalize_alerts(normalize.alert_fields(_gateway(spark, sf, alerts)), _now_text()))
    return both.groupBy("source", "rule_id", "severity", "src_ip").agg(F.count("*").alias("n"))


# --- readiness -------------------------------------------------------------------------------

def _ready(spark, sf):
    return readiness.readiness(t.case_evidence(spark, sf), t.cases(spark, sf))


@query
def readiness_coverage(spark, sf):
    lost, issue = readiness._coverage()
    counts = t.cases(spark, sf).join(readiness.field_counts(t.case_evidence(spark, sf)), "case_key", "left").na.fill(0)
    return counts.select("case_key", F.col("n").alias("evidence_count"), "missing", lost.alias("deduction"), issue.alias("issue"))


@query
def readiness_integrity(spark, sf):
    lost, issue = readiness._integrity()
    return readiness.field_counts(t.case_evidence(spark, sf)).select(
        "case_key", "good", lost.alias("deduction"), issue.alias("issue"))


@query
def readiness_temporal(spark, sf):
    return readiness.time_order(t.case_evidence(spark, sf), run=1000).select(
        "case_key", "n_ts", "unordered", F.floor(F.col("span") * 1000).alias("span_ms"))


@query
def readiness_uniqueness(spark, sf):
    return readiness.duplicate_ids(t.case_evidence(spark, sf))


@query
def readiness_level(spark, sf):
    return _ready(spark, sf).select("case_key", "score", "level", joined("allowed_actions").alias("allowed"),
                                    joined("blocked_actions").alias("blocked"))


@query
def readiness_report(spark, sf):
    return _ready(spark, sf).select(
        "case_key", "score", "level", "evidence_count", "valid_count", joined("issues").alias("issues"),
        "checks.field_coverage", "checks.field_integrity", "checks.temporal_consistency", "checks.uniqueness")


@query
def readiness_gate(spark, sf):
    return readiness.gate(_ready(spark, sf), "persist").select("case_key", "score")


# --- triage ----------------------------------------------------------------------------------

@query
def rule_histogram(spark, sf):
    return triage.rule_histogram(t.case_evidence(spark, sf))


@query
def triage_best_rule(spark, sf):
    return triage.best_rule(triage.rule_histogram(t.case_evidence(spark, sf)))


@query
def triage_confidence(spark, sf):
    return triage.triage(t.case_evidence(spark, sf), t.cases(spark, sf)).drop("best_rule")


@query
def kill_chain(spark, sf):
    return triage.kill_chain(t.case_evidence(spark, sf))


@query
def kill_chain_members(spark, sf):
    return triage.phase_members(t.case_evidence(spark, sf)).select("case_key", "ord", "kill_chain_phase")


@query
def kill_chain_progress(spark, sf):
    return triage.chain_progress(triage.kill_chain(t.case_evidence(spark, sf)))


@query
def actions(spark, sf):
    return triage.triage(t.case_evidence(spark, sf), t.cases(spark, sf)).select(
        "case_key", "event_type", joined(triage.actions_for(F.col("event_type"))).alias("actions"))


@query
def analysis(spark, sf):
    return triage.analysis(t.case_evidence(spark, sf), t.cases(spark, sf)).withColumn("actions", joined("actions"))


@query
def analysis_defaults(spark, sf):
    """Cases whose analysis failed (here: none was made for the empty ones) get the hand-over row."""
    return triage.analysis_or_default(
        t.cases(spark, sf), triage.analysis(t.case_evidence(spark, sf))).withColumn("actions", joined("actions"))


@query
def evidence_digest(spark, sf):
    return triage.evidence_digest(t.case_evidence(spark, sf), rows=20)


@query
def verdict_merge(spark, sf):
    return triage.analysis(t.case_evidence(spark, sf), t.cases(spark, sf), t.replies(spark, sf)).withColumn(
        "actions", joined("actions"))


# --- verification and reports ----------------------------------------------------------------

@query
def verify_evidence_ref(spark, sf):
    return verification.check_refs(t.cited_refs(spark, sf), t.case_evidence(spark, sf), most=None)


@query
def verify_ref_parts(spark, sf):
    """All unknown ids of a case in parts of three."""
    return verification.dangling_parts(t.cited_refs(spark, sf), t.case_evidence(spark, sf), most=3, run=500)


@query
def verify_raw_ref(spark, sf):
    return verification.check_raw_ref(t.case_evidence(spark, sf))


@query
def verify_query_id(spark, sf):
    return verification.check_query_id(t.case_evidence(spark, sf))


@query
def verify_lineage(spark, sf):
    return verification.lineage_status(t.case_evidence(spark, sf))


@query
def verify_lineage_issue(spark, sf):
    return verification.check_lineage(t.case_evidence(spark, sf))


@query
def verify_conclusion(spark, sf):
    reviewed = _review(spark, sf)
    return reviewed.select("case_key", joined(verification.conclusion_issues(
        F.col("conclusion"), F.col("evidence_count"), F.col("score"))).alias("issues"))


def _review(spark, sf):
    return case_plan.review(t.case_evidence(spark, sf), t.cases(spark, sf), t.replies(spark, sf),
                            t.cited_refs(spark, sf))


@query
def verify_overall(spark, sf):
    ev, known = t.case_evidence(spark, sf), t.cases(spark, sf)
    analysed = triage.analysis(ev, known, t.replies(spark, sf))
    verified = verification.verify(analysed, _ready(spark, sf), ev, t.cited_refs(spark, sf))
    return verified.select(
        "case_key", "verified", joined("issues").alias("issues"),
        F.concat_ws(",", "checks.evidence_ref", "checks.raw_ref", "checks.query_id", "checks.lineage_id",
                    "checks.conclusion").alias("checks"),
        "final_confidence", "final_conclusion")


@query
def case_report(spark, sf):
    return reporting.report_parts(_review(spark, sf), t.case_evidence(spark, sf),
                                  F.lit("20240201_000000"), block=1000)


@query
def case_report_sections(spark, sf):
    """Numbered evidence entries of the reports, in small blocks."""
    r = reporting.numbered_evidence(t.case_evidence(spark, sf), run=1000)
    return r.select("case_key", "position", reporting.evidence_block(F.col("position")).alias("entry"))


@query
def case_review(spark, sf):
    return _review(spark, sf).drop("readiness_checks", "allowed_actions", "checks").withColumns({
        "actions": joined("actions"), "issues": joined("issues"),
        "readiness_issues": joined("readiness_issues")})


def _signal_cases(spark, sf):
    """Rows of the cases that answered signals make, a projection of their stored evidence, and the stored reviews."""
    rows = hunt.case_rows_of(t.chain(spark, sf)[2], _now_text())
    return rows, t.stored(spark, sf, "signal_reviews", lambda s, d: case_plan.review(
        rows, rows.select("case_key").distinct()))


@query
def signal_case_review(spark, sf):
    """One reviewed case per answered signal."""
    return _signal_cases(spark, sf)[1].select(
        "case_key", "score", "event_type", "priority", "verified", "final_confidence", "evidence_count")


@query
def hunt_report(spark, sf):
    """From raw lines to report parts in one run, with nothing stored but evidence and reviews."""
    out = shared_dir(spark)
    events, _ = parsing.split_rejects(t.parsed_lines(spark, sf))
    events = events.withColumn("id", F.col("line_no")).select(*parsing.EVENT_COLUMNS)
    _, _, found = hunt.evidence_for(hunt.signals(events, t.rules()), events, t.CASE_ID)
    rows = materialize(hunt.case_rows_of(found, _now_text()), f"{out}/rows")
    reviewed = materialize(case_plan.review(rows, rows.select("case_key").distinct()), f"{out}/reviews")
    return reporting.report_parts(reviewed, rows, F.lit("20240201_000000"), block=7)


@query
def result_tables(spark, sf):
    """All six result tables written, read back and compared by a hash of every row's columns, per day."""
    base, (rows, reviewed) = shared_dir(spark), _signal_cases(spark, sf)
    latest = {"at": F.col("timestamp").cast("timestamp")}
    at_of = rows.groupBy("case_key").agg(*[F.max(c).alias(n) for n, c in latest.items()])
    reviewed = reviewed.join(at_of, "case_key")
    sinks.write_tables({
        "signals": _signals(spark, sf).withColumn("at", F.col("event_time").cast("timestamp")),
        "evidence": rows.withColumn("at", F.col("timestamp").cast("timestamp")),
        "readiness": reviewed.select("case_key", "at", "score", "level"),
        "analysis": reviewed.select("case_key", "at", "event_type", "priority", "conclusion"),
        "verification": reviewed.select("case_key", "at", "verified", "final_confidence"),
        "reports": reporting.report_parts(reviewed, rows, F.lit("20240201_000000"), largest=latest),
    }, base, "run-1")
    out = None
    for name in sinks.TABLES:
        back = sinks.read_table(spark, base, name).select(
            F.col("dt").cast("string").alias("dt"), F.md5(F.concat_ws("|", *[text_of(F.col(c)) for c in _COMPARED[name]])).alias("row"))
        part = back.groupBy("dt").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("row", 1, 8), 16, 10).cast("long")).alias("content"))
        part = part.select(F.lit(name).alias("name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_COMPARED = {
    "signals": ["signal_id", "node_id", "rule_id", "rule_level", "rule_desc", "severity", "category", "src_ip", "event_time",
                "raw_ref", "matched_count"],
    "evidence": ["evidence_id", "case_key", "query_id", "timestamp", "rule_id", "severity", "description", "hostname", "src_ip"],
    "readiness": ["case_key", "score", "level"],
    "analysis": ["case_key", "event_type", "priority", "conclusion"],
    "verification": ["case_key", "verified", "final_confidence"],
    "reports": ["case_key", "part", "text"],
}


def text_of(c):
    return F.coalesce(c.cast("string"), F.lit("~"))


@query
def gateway_query(spark, sf):
    """Ad-hoc alert queries against written registry sources, whole items and chosen fields."""
    out = shared_dir(spark)
    alerts = t.alerts(spark, sf)
    entries = [{"node_id": f"node-{i}", "source_name": "wazuh_alerts", "format": "json", "local_path": f"alerts/{i}"} for i in range(3)]
    for i, e in enumerate(entries):
        alerts.where(F.col("node_id") == e["node_id"]).drop("node_id").write.json(f"{out}/{e['local_path']}")
    window = "2024-01-05T00:00:00.000000+00:00/2024-01-20T00:00:00.000000+00:00"
    items = gateway.answer(spark, entries, "qry-1", "node-1", "wazuh-alerts", window, {"rule.id": "5710"}, 30, base=out)
    fields = gateway.answer(spark, entries, "qry-2", "node-2", time_window=window, filters={"rule_id": "5503"}, limit=25,
                            fields=["timestamp", "agent.name", "full_log"], base=out)
    return items.unionByName(fields.select(
        F.lit("qry-2").alias("query_id"), "timestamp", F.col("agent_name").alias("hostname"), F.col("full_log").alias("raw_log")),
        allowMissingColumns=True)


# --- monitoring ------------------------------------------------------------------------------

def _monitor(spark, sf):
    sig, asked, ev = _chain(spark, sf)
    when = F.col("event_time").cast("timestamp").cast("timestamp_ntz")
    sig_at = sig.withColumn("at", when)
    counts = evidence.query_summary(asked, ev)
    summary = counts.join(asked.select("query_id", "signal_id"), "query_id").join(
        sig_at.select("signal_id", "at"), "signal_id")
    return sig_at, summary


@query
def monitor_events(spark, sf):
    return monitoring.monitor_events(*_monitor(spark, sf)).drop("at")


@query
def monitor_counts(spark, sf):
    return monitoring.monitor_counts(monitoring.monitor_events(*_monitor(spark, sf)))


@query
def monitor_node_counts(spark, sf):
    return monitoring.node_counts(monitoring.monitor_events(*_monitor(spark, sf)))


@query
def monitor_latest(spark, sf):
    return monitoring.monitor_latest(monitoring.monitor_events(*_monitor(spark, sf))).select(
        "event_id", "event_type", "timestamp")


@query
def monitor_funnel(spark, sf):
    sig, summary = _monitor(spark, sf)
    return monitoring.funnel(sig, summary, _signal_cases(spark, sf)[1].select("case_key", "verified"))


@query
def query_latency(spark, sf):
    log = t.table(spark, sf, "events").selectExpr(
        "'qry-' || event_id AS query_id", "'node-' || user_id % 3 AS node_id", "ts AS at",
        "CAST(floor(value * 10) AS BIGINT) AS duration_ms", "event_id % 12 <> 0 AS ok")
    return monitoring.query_latency(log)


@query
def recent_cases(spark, sf):
    done = t.table(spark, sf, "orders").selectExpr(
        "'case-' || o_orderkey AS case_key", "'node-' || o_custkey % 3 AS node_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'scanning' ELSE 'unknown' END AS event_type",
        "CAST(o_orderdate AS STRING) AS at")
    return monitoring.recent_cases(done, 10, node="node-1", event_type="scanning")


# --- message tables and streams --------------------------------------------------------------

@query
def dead_letter(spark, sf):
    _, failed = messages.decode(t.bus_messages(spark, sf), _MESSAGE)
    again, dead = messages.retry_or_dead_letter(failed)
    return again.withColumn("fate", F.lit("retry")).unionByName(dead.withColumn("fate", F.lit("dead"))).select(
        "seq", "stream", "attempts", "fate")


@query
def message_fields(spark, sf):
    """Typed fields of all payloads, broken ones included."""
    return messages.typed_fields(t.bus_messages(spark, sf), {"signal_id": "string", "matched_count": "bigint", "extra": "boolean", "rule_id": "int"}).drop(
        "payload", "published_at")


@query
def monitor_payloads(spark, sf):
    return monitoring.payload_figures(monitor_events(spark, sf))


@query
def stream_decode(spark, sf):
    """Messages decoded as they arrive: good ones, ones to deliver again, ones given up."""
    out = shared_dir(spark)
    t.bus_messages(spark, sf).write.parquet(f"{out}/bus")
    places = {fate: f"{out}/{fate}" for fate in ("good", "retry", "dead")}
    ingest.decode_batches(ingest._stream_parquet(spark, f"{out}/bus"), _MESSAGE, *places.values(), f"{out}/ck").awaitTermination()
    found = None
    for fate, path in places.items():
        one = spark.read.parquet(path).select("seq", "stream", "attempts", F.lit(fate).alias("fate"))
        found = one if found is None else found.unionByName(one)
    return found


@query
def stream_retention(spark, sf):
    return messages.retain_stream(t.bus_messages(spark, sf), at("2024-01-20 00:00:00"), 15 * t.DAY, 50_000).select(
        "stream", "seq")


@query
def stream_inventory(spark, sf):
    return messages.stream_inventory(t.bus_messages(spark, sf), t.consumers(spark, sf))


_HALF = "2024-01-16 00:00:00"
_LATE = "10 days"


def _land_in_pieces(spark, sf, path, since=None, until=None, days=8):
    """Land events a few days at a time, as a log arrives."""
    events = t.auth_events(spark, sf)
    first, last = events.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
    for k in range(0, (last - first).days + 1 if first else 0, days):
        lo, hi = (f"{first + datetime.timedelta(days=d)} 00:00:00" for d in (k, k + days))
        if (since is None or hi > since) and (until is None or lo < until):
            detect.land_events(events.where((F.col("timestamp") >= t.naive(max(lo, since or lo)))
                                            & (F.col("timestamp") < t.naive(min(hi, until or hi)))), path)


def _fires_of(spark, out):
    return spark.read.parquet(f"{out}/fires").select(
        "node_id", "rule_id", "group_key", second().alias("t"), "window_count")


@query
def stream_detect(spark, sf):
    """Continuous detection in several triggers with a restart; what arrives too late is left out."""
    out = shared_dir(spark)
    run = lambda: detect.run_detection(
        spark, f"{out}/events", t.rules(), f"{out}/fires", f"{out}/ck", delay=_LATE, max_files=8)
    _land_in_pieces(spark, sf, f"{out}/events", until=_HALF)
    run()
    _land_in_pieces(spark, sf, f"{out}/events", since=_HALF)
    run()
    # once more the first day, weeks behind the watermark
    detect.land_events(t.auth_events(spark, sf).where(F.col("timestamp") < t.naive("2024-01-02 00:00:00")), f"{out}/events")
    detect.land_end(spark, f"{out}/events")
    run()
    return _fires_of(spark, out)


@query
def rule_reload(spark, sf):
    """A reload between two runs of one stream: counts and cool-downs begin anew."""
    out = shared_dir(spark)
    for version, (since, until) in enumerate([(None, _HALF), (_HALF, None)]):
        _land_in_pieces(spark, sf, f"{out}/events", since, until, days=31)
        if version:
            detect.land_end(spark, f"{out}/events")
        detect.run_detection(spark, f"{out}/events", t.rules(), f"{out}/fires", f"{out}/ck", delay=_LATE, rules_version=version)
    return _fires_of(spark, out)


@query
def rule_reload_live(spark, sf):
    """A version of the rules that lands between two triggers of one running query."""
    out = shared_dir(spark)
    detect.publish_rules(t.shipped_catalog(spark), f"{out}/rules", 0)
    _land_in_pieces(spark, sf, f"{out}/events", until=_HALF, days=31)
    live = detect.match_live(spark, f"{out}/events", f"{out}/rules", f"{out}/matches", f"{out}/ck-live")
    try:
        live.processAllAvailable()
        detect.publish_rules(t.shipped_catalog(spark), f"{out}/rules", 1)
        _land_in_pieces(spark, sf, f"{out}/events", since=_HALF, days=31)
        live.processAllAvailable()
        detect.land_end(spark, f"{out}/events")
        live.processAllAvailable()
    finally:
        live.stop()
    detect.run_judging(spark, f"{out}/matches", f"{out}/fires", f"{out}/ck", delay=_LATE)
    return _fires_of(spark, out)


@query
def lineage_live(spark, sf):
    """Lineage by stream-stream joins, landed in two pieces with a restart between them."""
    out = shared_dir(spark)
    sig, asked, found = _chain(spark, sf)
    sig = sig.withColumn("at", F.col("event_time").cast("timestamp"))
    asked = asked.select("query_id", "signal_id").join(sig.select("signal_id", "at"), "signal_id")
    found = found.select("evidence_id", "query_id", "lineage_id", "raw_ref").join(asked.select("query_id", "at"), "query_id")
    half = F.lit(_HALF).cast("timestamp")
    for piece in (F.col("at") < half, F.col("at") >= half):
        for name, rows in (("signals", sig.select("signal_id", "raw_ref", "at")), ("requests", asked), ("evidence", found)):
            lineage.land(rows.where(piece), f"{out}/{name}")
        lineage.run_lineage(spark, out, f"{out}/chains", f"{out}/ck", delay=_LATE)
    lineage.land_ends(spark, out)
    lineage.run_lineage(spark, out, f"{out}/chains", f"{out}/ck", delay=_LATE)
    return lineage.read_lineage(spark, f"{out}/chains")


@query
def state_cleanup(spark, sf):
    """Fires per rule, with the state that is left once all keys have gone quiet."""
    out = shared_dir(spark)
    detect.land_events(t.auth_events(spark, sf), f"{out}/events")
    detect.land_end(spark, f"{out}/events")
    done = detect.run_detection(spark, f"{out}/events", t.rules(), f"{out}/fires", f"{out}/ck", delay=_LATE)
    left = sum(int(o["numRowsTotal"]) for o in done.lastProgress["stateOperators"])
    left += detect.keys_in_state(spark, f"{out}/ck").count()
    return spark.read.parquet(f"{out}/fires").groupBy("rule_id").agg(
        F.count("*").alias("fires"), F.lit(left).cast("long").alias("state_rows"))


@query
def stream_threshold(spark, sf):
    """Tumbling-window thresholds with a watermark."""
    out = shared_dir(spark)
    detect.land_events(t.auth_events(spark, sf), f"{out}/events")
    detect.land_end(spark, f"{out}/events")
    detect.run_windows(spark, f"{out}/events", t.rules(), f"{out}/win", f"{out}/ck", "3 days", _LATE)
    return spark.read.parquet(f"{out}/win").select(
        "node_id", "rule_id", "group_key", second("window_start").alias("window_start"), "matched_count")


@query
def stream_fresh(spark, sf):
    out = shared_dir(spark)
    _signals(spark, sf).write.parquet(f"{out}/signals")
    ingest.fresh_to_table(spark, f"{out}/signals", NOW, f"{out}/fresh", f"{out}/ck")
    return spark.read.parquet(f"{out}/fresh").select("signal_id", "event_time")


@query
def stream_dedup(spark, sf):
    out = shared_dir(spark)
    sig = t.bus_messages(spark, sf).selectExpr(
        "'sig-' || seq div 3 AS signal_id", "stream", "published_at")
    sig.write.parquet(f"{out}/signals")
    ingest.dedup_to_table(spark, f"{out}/signals", f"{out}/once", f"{out}/ck", "60 days")
    return spark.read.parquet(f"{out}/once").select("signal_id")
