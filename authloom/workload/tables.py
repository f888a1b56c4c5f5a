"""Inputs for every query, derived from the given tables by Spark expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.sizes import literal_rows
from authloom.operators import parsing
from authloom.operators.evidence import auth_evidence, retrieve_evidence
from authloom.operators.requests import query_requests
from authloom.operators.rules import match_rules, parse_catalog
from authloom.plans import hunt
from authloom.sources.scratch import shared_dir
from authloom.workload import texts

REF_YEAR = 2024
CASE_ID = "case-1"
DAY = 86_400

# The test users are sparse, so the shipped rules get longer windows here.
_SCALE = {
    "LOCAL_SSH_BRUTE_FORCE": (3, 2 * DAY, DAY // 2),
    "LOCAL_SSH_SCAN": (3, 3 * DAY, DAY),
    "LOCAL_SUDO_FAILURES": (3, 2 * DAY, 2 * DAY),
    "LOCAL_SU_FAILURES": (3, 2 * DAY, DAY // 2),
    "LOCAL_SSH_ACCEPTED": (1, 1, 0),
}


def rules() -> list[dict]:
    out = deepcopy(fixed.DEFAULT_RULES)
    for r in out:
        count, window, cooldown = _SCALE[r["id"]]
        r["threshold"].update(count=count, window_seconds=window)
        r["cooldown_seconds"] = cooldown
    return out


def session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf}/{name}.parquet")


def base_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the parts a log line is made of."""
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "event_type",
        "date_trunc('second', ts) AS at",
        "ts",
        "event_id % 20 AS k", "event_id % 97 AS d",
        "'node-' || user_id % 3 AS node_id", "'host-' || user_id % 3 AS host",
        "'10.0.' || user_id div 256 || '.' || user_id % 256 AS ip",
        "1024 + event_id % 60000 AS port", "1000 + event_id % 50000 AS pid",
        "'user' || user_id AS usr",
        "split(date_format(ts, 'MMM|d|dd|HH:mm:ss|yyyyMMdd'), '[|]') AS w",
    ).selectExpr(
        "* EXCEPT (w)", "w[0] AS month", "w[1] AS day1", "w[2] AS day2", "w[3] AS clock", "w[4] AS ymd")


ROWS_PER_FILE = 10_000
FILES = 64  # of a table with as many rows as there are events, once these are many
_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str,
           build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A stage table, written on first use in this session and read back as parquet.

    The stages (raw lines, events, signals, evidence) are stored tables in operation too; reading
    them keeps every query from recomputing what lies before its own stage.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/{name}"
        # in several files, as they would lie on a cluster, so that a small table is read by many tasks, and a
        # large one is not cut into thousands of files
        rows = max(ROWS_PER_FILE, table(spark, sf, "events").count() // FILES)
        build(session(spark), sf).write.option("maxRecordsPerFile", rows).parquet(path)
        _STORED[key] = path
    return session(spark).read.parquet(_STORED[key])


def unless_stored(spark: SparkSession, sf: str, name: str,
                  build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A stage table if it has been written in this session, else its rows derived anew.

    For queries that read few columns of it: the others are then neither made, shuffled nor written.
    """
    if (spark.sparkContext.applicationId, sf, name) in _STORED:
        return stored(spark, sf, name, build)
    return build(session(spark), sf)


def auth_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Stored raw lines: node_id, file, line_no, value."""
    return stored(spark, sf, "lines", lambda s, d: _auth_lines(s, d))


def _auth_lines(spark: SparkSession, sf: str) -> DataFrame:
    return (
        base_events(spark, sf)
        .selectExpr("*", f"{texts.MESSAGE} AS message", f"{texts.PROCESS} AS proc",
                    f"{texts.STAMP} AS stamp", f"{texts.PID_TEXT} AS pid_text")
        .selectExpr(
            "node_id", "'auth.log-' || ymd AS file", "event_id AS line_no",
            f"CASE WHEN d = 19 THEN '  ' || {texts.RAW_LINE} || ' ' ELSE {texts.RAW_LINE} END AS value",
        )
    )


def parsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse_lines(auth_lines(spark, sf), REF_YEAR)


def auth_events(spark: SparkSession, sf: str) -> DataFrame:
    """Stored usable events."""
    return stored(spark, sf, "events", parse_events)


def parse_events(spark: SparkSession, sf: str) -> DataFrame:
    """Usable events straight from the lines; the line number serves as event id."""
    events, _ = parsing.split_rejects(parsed_lines(spark, sf))
    return events.withColumn("id", F.col("line_no")).select(*parsing.EVENT_COLUMNS)


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return match_rules(auth_events(spark, sf), rules())


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored nested alert rows plus node_id."""
    return stored(spark, sf, "alerts", made_alerts)


def made_alerts(spark: SparkSession, sf: str) -> DataFrame:
    lines = auth_lines(spark, sf).select(F.col("line_no").alias("event_id"),
                                         F.trim("value").alias("full_log"))
    return base_events(spark, sf).join(lines, "event_id").selectExpr(
        "node_id",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || '+00:00' AS timestamp",
        f"""named_struct('level', {texts.ALERT_LEVEL}, 'description', {texts.ALERT_TEXT},
            'id', {texts.ALERT_RULE}, 'firedtimes', CAST(k AS INT), 'mail', false,
            'groups', array('syslog', 'authentication_failed')) AS rule""",
        """named_struct('id', lpad(user_id % 3, 3, '0'), 'name', host,
            'ip', CASE WHEN event_id % 7 = 0 THEN NULL ELSE ip END) AS agent""",
        "named_struct('name', 'manager') AS manager",
        "'al-' || event_id AS id",
        "full_log",
        """named_struct('program_name', 'sshd', 'timestamp', month || ' ' || day2 || ' ' || clock,
            'hostname', host) AS predecoder""",
        "named_struct('name', 'sshd') AS decoder",
        "'/var/log/auth.log' AS location",
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Stored signals."""
    return stored(spark, sf, "signals", lambda s, d: hunt.signals(auth_events(s, d), rules()))


def asked_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Stored requests, one per signal."""
    return stored(spark, sf, "requests", lambda s, d: query_requests(signals(s, d), CASE_ID))


def chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored (signals, requests, evidence)."""
    sig, asked = signals(spark, sf), asked_requests(spark, sf)
    return sig, asked, stored(spark, sf, "evidence", answers)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence for the stored requests, not stored itself."""
    return auth_evidence(retrieve_evidence(asked_requests(spark, sf), auth_events(spark, sf), hashed=True))


def _case_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "ts",
        "user_id * 1000 + dayofyear(ts) div (1 + user_id % 7) AS cno",
    )


def case_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Stored common-schema evidence with case_key, ord and deliberate defects."""
    return stored(spark, sf, "case_evidence", _case_evidence)


def _case_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _case_rows(spark, sf)
        .selectExpr(
            "*", "'case-' || cno AS case_key",
            "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS iso",
            "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS plain",
            "date_format(ts, 'yyyy/MM/dd HH:mm:ss') AS slashed",
        )
        .selectExpr(
            "case_key",
            "CASE WHEN user_id % 3 = 0 THEN 1000000000 - event_id ELSE event_id END AS ord",
            "'node-' || user_id % 3 AS node_id",
            f"{texts.CASE_TIME} AS timestamp",
            f"{texts.CASE_SEVERITY} AS severity",
            f"{texts.CASE_RULE} AS rule_id",
            "CASE WHEN event_id % 9 = 0 THEN '' ELSE '告警 ' || event_id END AS description",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE '10.0.0.' || user_id % 256 END AS src_ip",
            "CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'host-' || user_id % 3 END AS hostname",
            """CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'ev-dup-' || cno
                ELSE 'ev-' || event_id END AS evidence_id""",
            "CASE WHEN user_id % 10 = 0 THEN '' ELSE 'auth_log' END AS source",
            "CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'raw ' || event_id END AS raw_log",
            """CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN 'nowhere'
                ELSE 'node/auth_log#' || event_id END AS raw_ref""",
            """CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 67 = 0 THEN 'plain'
                ELSE 'qry-' || cno || ':' || event_id END AS lineage_id""",
            "CASE WHEN event_id % 71 = 0 THEN 'qry-other' ELSE 'qry-' || cno END AS query_id",
        )
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """All case keys; every customer adds one case that never got evidence."""
    return stored(spark, sf, "cases", _cases)


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    filled = _case_rows(spark, sf).selectExpr("'case-' || cno AS case_key").distinct()
    empty = table(spark, sf, "customer").selectExpr("'case-empty-' || c_custkey AS case_key")
    return filled.unionByName(empty)


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """External verdict texts for four of five cases, one of them unreadable."""
    return stored(spark, sf, "replies", _replies)


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _case_rows(spark, sf).select("cno").distinct()
        .selectExpr("cno", f"{texts.REPLY_BODY} AS body", "chr(10) AS nl")
        .selectExpr("'case-' || cno AS case_key", f"{texts.REPLY} AS reply")
        .where("reply IS NOT NULL")
    )


def cited_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence ids cited by analyses; some cite an id their case does not hold."""
    return stored(spark, sf, "cited_refs", _cited_refs)


def _cited_refs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id * 1000 + dayofyear(ts) div (1 + user_id % 7) AS cno",
    ).selectExpr(
        "'case-' || cno AS case_key", "event_id AS ord",
        """CASE WHEN event_id % 73 = 0 THEN 'ev-ghost-' || event_id
            WHEN event_id % 11 = 0 OR event_id % 47 = 0 THEN '' ELSE 'ev-' || event_id END AS evidence_id""",
    )


def registry_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS sk", "s_suppkey % 37 AS node_no").selectExpr(
        "sk AS entry_no", f"{texts.REGISTRY_DOC} AS doc")


def clients(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "'client-' || c_custkey div 2 * 2 % 1000 AS client_id", "'node-' || c_custkey % 997 AS node_id")


def rule_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS pk", "p_size AS psize").selectExpr(
        f"{texts.RULE_DOC} AS doc")


def part_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A rule per part: two patterns each, windows of three hundred lengths."""
    docs = table(spark, sf, "part").selectExpr(f"{texts.PART_RULE} AS doc")
    # one small file becomes many patterns and pieces, which shouldn't all be the work of the task that reads it
    return parse_catalog(docs.repartition(spark.sparkContext.defaultParallelism))


def shipped_catalog(spark: SparkSession) -> DataFrame:
    """The rules of ``rules`` as a table."""
    return parse_catalog(literal_rows(spark, [{"doc": json.dumps(r)} for r in rules()], "doc string"))


def bus_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Message table: three streams, some broken payloads, delivery attempts."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS seq", "ts AS published_at",
        "CASE user_id % 3 WHEN 0 THEN 'SIGNALS' WHEN 1 THEN 'QUERY_REQUESTS' ELSE 'QUERY_RESULTS' END AS stream",
        "CAST(1 + event_id % 4 AS INT) AS attempts",
        """CASE WHEN event_id % 10 = 3 THEN '{"signal_id": "sig-' || event_id || '", "matched_count": '
            WHEN event_id % 10 = 7 THEN 'oops ' || event_id
            ELSE '{"signal_id": "sig-' || event_id || '", "rule_id": "' || event_type
                 || '", "matched_count": ' || user_id || ', "extra": true}' END AS payload""",
    )


def consumers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "CASE user_id % 3 WHEN 0 THEN 'SIGNALS' WHEN 1 THEN 'QUERY_REQUESTS' ELSE 'QUERY_RESULTS' END AS stream",
        "'consumer-' || user_id AS consumer")


def naive(text: str):
    return F.lit(text).cast("timestamp_ntz")
