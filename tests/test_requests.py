import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from authloom.operators import evidence, requests

SIGNAL = (
    "signal_id string, node_id string, detection_rule_id string, rule_id string, rule_level int, "
    "rule_desc string, severity string, category string, src_ip string, event_time string, "
    "suggested_logs array<string>, raw_ref string, matched_count bigint")

T0 = datetime(2024, 5, 1)
EVENT = ("node_id string, id bigint, timestamp timestamp_ntz, hostname string, process string, pid int, "
         "message string, src_ip string, src_port int, dst_user string, log_type string, raw_line string")


def signals(spark, rows):
    base = dict(signal_id="s", node_id="n", detection_rule_id="", rule_id="", rule_level=5, rule_desc="",
                severity="", category="", src_ip="0.0.0.0", event_time=None, suggested_logs=["auth_log"],
                raw_ref="", matched_count=1)
    names = [c.split()[0] for c in SIGNAL.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SIGNAL)


def test_request_goldens(spark):
    df = signals(spark, [
        dict(signal_id="1", detection_rule_id="LOCAL_SSH_X", src_ip="10.0.0.5"),
        dict(signal_id="2", detection_rule_id="LOCAL_SUDO_FAILURES"),
        dict(signal_id="3", detection_rule_id="LOCAL_SU_FAILURES"),
        dict(signal_id="4", rule_id="5710", suggested_logs=[]),
        dict(signal_id="5", rule_id="5710", suggested_logs=["wazuh-alerts", "auth_log"])])
    got = {r.signal_id: (r.source, r.filters.src_ip, r.filters.process, r.filters.rule_id, r.limit)
           for r in requests.query_requests(df, "c").collect()}
    assert got == {
        "1": ("auth_log", "10.0.0.5", "sshd", None, 20), "2": ("auth_log", None, "sudo", None, 20),
        "3": ("auth_log", None, "su", None, 20), "4": ("wazuh_alerts", None, None, "5710", 20),
        "5": ("wazuh_alerts", None, None, "5710", 20)}


def test_stale_signals(spark):
    times = {"old": "2024-05-01T11:54:59Z", "edge": "2024-05-01T11:55:00Z", "odd": "yesterday", "none": None}
    df = signals(spark, [dict(signal_id=k, event_time=v) for k, v in times.items()])
    now = F.lit("2024-05-01T12:00:00Z").cast("timestamp")
    assert {r.signal_id for r in requests.fresh_signals(df, now).collect()} == {"edge", "odd", "none"}


def make_events(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["n1", "n1", "n2"]), i, T0 + timedelta(seconds=rnd.randrange(60)), "h",
             rnd.choice(["sshd", "sudo"]), 1, "m", rnd.choice(["hot"] * 4 + ["b", None]), 1, "u",
             rnd.choice(["x", "y"]), "raw") for i in range(n)]
    return rows, spark.createDataFrame(rows, EVENT)


def make_requests(spark, limits):
    since = T0 + timedelta(seconds=30)
    rows = []
    for i, (ip, proc, kind, s, user) in enumerate([
            ("hot", "sshd", None, None, None), (None, "sudo", None, since, None), ("b", "", "x", None, ""),
            (None, None, None, None, None), ("zz", None, None, None, None), ("hot", "sshd", None, since, None),
            ("hot", "sshd", None, None, ""), (None, None, None, None, "u1")]):
        rows.append((f"q{i}", "n1" if i != 3 else None, "auth_log", (ip, proc, kind, s, None, None, user), limits[i % len(limits)]))
    rows.append(("other", "n1", "wazuh_alerts", (None,) * 7, 1))
    return rows, spark.createDataFrame(
        rows, f"query_id string, node_id string, source string, filters {requests.FILTERS}, limit int")


def brute(events, reqs):
    out = set()
    for q, node, source, (ip, proc, kind, since, _, _, user), limit in reqs:
        if source != "auth_log":
            continue
        limit = 20 if limit is None else limit
        for n in [node] if node else ["n1", "n2"]:
            hits = [e for e in events if e[0] == n and (not ip or e[7] == ip) and (not proc or e[4] == proc)
                    and (not kind or e[10] == kind) and (since is None or e[2] >= since) and (not user or e[9] == user)]
            hits.sort(key=lambda e: (e[2], e[1]), reverse=True)
            out |= {(q, n, k + 1 if limit > 0 else None, e[1]) for k, e in enumerate(hits[:limit] if limit > 0 else hits)}
    return out


@pytest.mark.parametrize("limits", [[7], [0], [None, 3, 0, 500], [-1, None]])
def test_retrieval_equals_brute_force(spark, limits):
    erows, ev = make_events(spark)
    rrows, reqs = make_requests(spark, limits)
    nodes = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    got = evidence.retrieve_evidence(reqs, ev, nodes).collect()
    assert {(r.query_id, r.node_id, r.rank, r.id) for r in got} == brute(erows, rrows)


def test_retrieval_scans_events_once(spark, tmp_path):
    _, ev = make_events(spark, 50)
    ev.write.parquet(str(tmp_path / "ev"))
    _, reqs = make_requests(spark, [None, 3, 0])
    plan = evidence.retrieve_evidence(reqs, spark.read.parquet(str(tmp_path / "ev")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Cartesian" not in plan


def test_evidence_rows_and_tamper(spark):
    _, ev = make_events(spark, 30)
    _, reqs = make_requests(spark, [5])
    rows = evidence.auth_evidence(evidence.retrieve_evidence(reqs, ev)).cache()
    assert evidence.tampered(rows).count() == 0
    bad = rows.withColumn("pid", F.lit(99))
    assert evidence.tampered(bad).count() == rows.count()
    r = rows.where("src_ip = 'hot'").first()
    assert r.raw_ref == f"{r.node_id}/auth_log#hot#{r.timestamp}" and r.lineage_id == f"{r.query_id}:{r.hash}"
    assert "message" not in evidence.auth_evidence(evidence.retrieve_evidence(reqs, ev), minimize=True).columns
    summary = {x.query_id: x.evidence_count for x in evidence.query_summary(reqs, rows).collect()}
    assert summary["q4"] == 0 and summary["q0"] == 5
    rows.unpersist()


def test_query_events(spark):
    rows, ev = make_events(spark)
    got = [r.id for r in requests.query_events(ev, {"process": "sshd", "src_ip": "", "since": T0 + timedelta(seconds=10)}, 0).collect()]
    want = [e[1] for e in sorted(rows, key=lambda e: (e[2], e[1]), reverse=True)
            if e[4] == "sshd" and e[2] >= T0 + timedelta(seconds=10)]
    assert got == want
    assert [r.id for r in requests.query_events(ev, {"process": "sshd"}, 3).collect()] == [
        e[1] for e in sorted(rows, key=lambda e: (e[2], e[1]), reverse=True) if e[4] == "sshd"][:3]


def test_unlimited_requests_of_one_node_spread(spark):
    """One node with a third of all events, asked for without limit by several requests: no task has much more than others."""
    from authloom.operators import evidence

    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'hot', 'n' || id % 40) AS node_id", "id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS timestamp",
        "'h' AS hostname", "'sshd' AS process", "1 AS pid", "'m' AS message", "'1.1.1.1' AS src_ip", "1 AS src_port", "'u' AS dst_user", "'t' AS log_type", "'r' AS raw_line")
    asked = spark.createDataFrame(
        [(f"q{k}", "auth_log", node, limit, {}) for k, (node, limit) in enumerate([("hot", 0)] * 4 + [("hot", 3)] + [(f"n{k}", 0) for k in range(40)])],
        "query_id string, source string, node_id string, limit int, filters struct<src_ip:string,process:string,log_type:string,dst_user:string>")
    small = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as for a table that cannot be broadcast
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        found = evidence.retrieve_evidence(asked, rows)
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        per_query = {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [per_query[f"q{k}"] for k in range(5)] == [10_000] * 4 + [3] and sum(per_query.values()) == 60_003
    assert max(per_task) < 3 * sorted(per_task)[len(per_task) // 2]


def test_many_questions_are_not_broadcast(spark, tmp_path):
    """A question stands in many parts; what is small as a file is not small then."""
    spark.range(20_000).selectExpr(
        "'q' || id AS query_id", "'n' AS node_id", "'auth_log' AS source", "named_struct('src_ip', 'ip' || id) AS filters",
        "CASE id % 2 WHEN 0 THEN 0 ELSE 5 END AS limit").write.parquet(str(tmp_path / "asked"))
    cols = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in ("process", "log_type", "dst_user"))
    spark.range(400_000).selectExpr(
        "id", "'n' AS node_id", "'ip' || id AS src_ip", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS timestamp", "sha2(CAST(id AS STRING), 256) AS raw",
        *cols.split(", ")).write.parquet(str(tmp_path / "rows"))
    found = evidence.retrieve_evidence(spark.read.parquet(str(tmp_path / "asked")), spark.read.parquet(str(tmp_path / "rows")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "[_key" in plan and "BroadcastHashJoin [_key" not in plan
    assert found.count() == 20_000


def test_keys_that_nobody_asks_for_are_not_shuffled(spark):
    """Three shapes make three keys of every event; 2,002 of these 60,000 rows are asked for."""
    rows = spark.range(20_000).selectExpr(
        "'n' AS node_id", "id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS timestamp", "'ip' || id AS src_ip",
        "'p' || id AS process", "if(id % 10 = 0, 'root', 'u' || id) AS dst_user", "CAST(NULL AS STRING) AS log_type")
    asked = spark.createDataFrame(
        [("q0", "auth_log", "n", 0, ("ip7", None, None)), ("q1", "auth_log", "n", 5, (None, "p9", None)),
         ("q2", "auth_log", "n", 0, (None, None, "root")), ("q3", "auth_log", "n", 0, (None, None, "nobody"))],
        "query_id string, source string, node_id string, limit int, filters struct<src_ip:string,process:string,dst_user:string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for requests that cannot be broadcast
    try:
        found = evidence.retrieve_evidence(asked, rows)
        got = [(r.query_id, r.id) for r in found.collect()]
        plan = found._jdf.queryExecution().executedPlan()
        plan.execute().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == sorted([("q0", 7), ("q1", 9)] + [("q2", k) for k in range(0, 20_000, 10)])


    def most_written(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return most_written(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return most_written(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        below = [most_written(node.children().apply(i)) for i in range(node.children().size())]
        return max([own.get().value() if own.isDefined() else 0, *below])

    assert 2_002 <= most_written(plan) < 4_000


def test_a_row_stands_beside_itself_for_all_its_requests(spark, tmp_path):
    """A result of requests times rows: the next row comes after all requests for the one before, so files stay small."""
    rows = spark.range(1000).selectExpr(
        "'n' AS node_id", "xxhash64(id) AS id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS timestamp", "'ip' AS src_ip",
        "'p' AS process", "'u' AS dst_user", "CAST(NULL AS STRING) AS log_type")
    asked = spark.range(300).selectExpr("'q' || id AS query_id", "'auth_log' AS source", "'n' AS node_id", "0 AS limit",
                                        "named_struct('src_ip', CAST(NULL AS STRING)) AS filters")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for requests that cannot be broadcast
    try:
        found = evidence.retrieve_evidence(asked, rows).select("query_id", "rank", "id")
        ids = [r.id for r in found.collect()]
        found.write.parquet(str(tmp_path / "found"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(ids) == 300_000 and sum(a != b for a, b in zip(ids, ids[1:])) < 1010
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 300_000
