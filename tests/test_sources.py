import json

import pytest
from pyspark.sql import functions as F

from authloom.operators import messages
from authloom.sources import files, registry, scratch, sinks


def test_auth_lines_of_many_nodes(spark, tmp_path):
    a, b = tmp_path / "a" / "auth.log", tmp_path / "b"
    a.parent.mkdir()
    b.mkdir()
    a.write_bytes(b"one\n\n  \ntwo\r\nbad \xff byte\n")
    (b / "x.log").write_text("three four\n")
    got = files.number_lines(files.read_auth_lines(spark, {str(a): "na", str(b): "nb"})).collect()
    by_node = {}
    for r in sorted(got, key=lambda r: r.line_no):
        by_node.setdefault(r.node_id, []).append((r.line_no, r.value))
    assert [n for n, _ in by_node["na"]] == [1, 2, 3] and by_node["na"][1][1] == "two\r"
    assert by_node["nb"] == [(1, "three four")]


def test_alerts_quarantine_and_search(spark, tmp_path):
    p = tmp_path / "alerts.json"
    p.write_text('{"timestamp":"t","rule":{"id":"5503","level":5},"id":"1"}\n{"timestamp":"t","rule":{"id"')
    good, bad = files.read_alerts(spark, str(p))
    assert [(r.id, r.rule.id) for r in good.collect()] == [("1", "5503")]
    assert [r.line for r in bad.collect()] == ['{"timestamp":"t","rule":{"id"']


def test_gateway_answers_from_the_registry(spark, tmp_path):
    from authloom.plans import gateway

    def alert(i, rule):
        return json.dumps({"timestamp": f"2024-05-0{i}T00:00:00Z", "id": str(i), "full_log": f"l{i}",
                           "rule": {"id": rule, "level": 5, "description": "d"}, "agent": {"name": "h", "ip": "" if i == 2 else "1.1.1.1"}})

    p = tmp_path / "alerts.json"
    p.write_text("\n".join(alert(i, "5710" if i % 2 else "5503") for i in range(1, 7)))
    entries = [{"node_id": "n1", "source_name": "wazuh_alerts", "local_path": str(p), "format": "json"},
               {"node_id": "n2", "source_name": "wazuh_alerts", "local_path": ""}]
    got = gateway.answer(spark, entries, "q1", "n1", "wazuh-alerts", "2024-05-02T00:00:00Z/2024-05-06T00:00:00Z", {"rule.id": "5503"}, 2)
    rows = got.collect()
    assert [(r.raw_log, r.src_ip, r.severity, r.rule_id) for r in rows] == [("l2", "0.0.0.0", 5, "5503"), ("l4", "1.1.1.1", 5, "5503")]
    assert rows[0].raw_ref == "n1/wazuh_alerts#2024-05-02T00:00:00Z" and rows[0].lineage_id == f"q1:{rows[0].hash}"
    for node in ("n2", "n3"):
        with pytest.raises(ValueError):
            gateway.answer(spark, entries, "q", node)


def test_alert_requests_with_and_without_rule(spark):
    from authloom.operators import evidence

    rows = [(f"n{i % 2}", str(i), f"t{i:03d}", ("5710" if i % 3 else "5503",)) for i in range(40)]
    alerts = spark.createDataFrame(rows, "node_id string, id string, timestamp string, rule struct<id:string>")
    asked = spark.createDataFrame([("q1", "n1", "wazuh_alerts", ("5503",), 3), ("q2", None, "wazuh_alerts", (None,), 5)],
                                  "query_id string, node_id string, source string, filters struct<rule_id:string>, limit int")
    nodes = spark.createDataFrame([("n0",), ("n1",)], "node_id string")
    got = {(r.query_id, r.node_id, r.id) for r in evidence.retrieve_alerts(asked, alerts, nodes).collect()}
    want = {("q1", "n1", r[1]) for r in [x for x in rows if x[0] == "n1" and x[3][0] == "5503"][:3]}
    for n in ("n0", "n1"):
        want |= {("q2", n, r[1]) for r in [x for x in rows if x[0] == n][:5]}
    assert got == want


def test_registry_shapes(spark, tmp_path):
    flat = {"node_id": "n1", "source_name": "auth_log", "local_path": "/a", "format": "syslog", "retention_days": 7}
    nested = {"node_id": "n2", "sources": [{"source_name": "auth_log", "local_path": "/b"}, {"source_name": "w", "local_path": ""}]}
    one, many = tmp_path / "one.json", tmp_path / "many.json"
    one.write_text(json.dumps(flat))
    many.write_text(json.dumps([flat, nested], indent=2))
    assert registry.load_registry(spark, str(one)).count() == 1
    reg = registry.load_registry(spark, str(many)).cache()
    assert {(r.node_id, r.source_name) for r in reg.collect()} == {("n1", "auth_log"), ("n2", "auth_log"), ("n2", "w")}
    asked = spark.createDataFrame([("q1", "n1", "auth_log"), ("q2", "n2", "w"), ("q3", "n3", "w")], "query_id string, node_id string, source string")
    got = {r.query_id: r.error for r in registry.registry_lookup(asked, reg).collect()}
    assert got == {"q1": None, "q2": "source has no path", "q3": "source not found"}
    cl = spark.createDataFrame([("c1", "n1"), ("c1", "n9"), ("c2", "n1")], "client_id string, node_id string")
    assert {(r.problem, r.subject) for r in registry.registry_checks(cl, reg).collect()} == {
        ("node_without_auth_log", "c1"), ("client_id_repeated", "c1"), ("node_has_several_clients", "n1")}


def test_federated_scan_prunes_nodes(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.log").write_text(f"line of {n}\n")
    entries = [{"node_id": n, "source_name": "auth_log", "local_path": str(tmp_path / f"{n}.log"), "format": "syslog"} for n in "ab"]
    assert {(r.node_id, r.value) for r in files.scan_source(spark, entries, "auth_log").collect()} == {("a", "line of a"), ("b", "line of b")}
    one = files.scan_source(spark, entries, "auth_log", nodes=["b"])
    assert [r.node_id for r in one.collect()] == ["b"] and len(one.inputFiles()) == 1
    with pytest.raises(ValueError):
        files.scan_source(spark, entries, "nothing")


def test_many_nodes(spark, tmp_path):
    nodes = {}
    for i in range(40):
        d = tmp_path / ("deep/er" if i % 2 else "flat") / f"n{i}"
        d.mkdir(parents=True)
        (d / "auth.log").write_text(f"line {i}\n")
        nodes[str(d / "auth.log") if i % 3 else str(d)] = f"node-{i}"
    got = {(r.node_id, r.value) for r in files.read_auth_lines(spark, nodes).collect()}
    assert got == {(f"node-{i}", f"line {i}") for i in range(len(nodes))}


def test_paths_that_need_care(spark, tmp_path):
    names = {"with blank": "n1", "a+b%20c": "n2", "rel/x": "n3", "ümläut": "n4"}
    for name, n in names.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "auth.log").write_text(f"{n}\n")
    nodes = {(f"./{k}" if k == "rel/x" else str(tmp_path / k)): n for k, n in names.items()}
    got = files.read_auth_lines(spark, nodes, base=str(tmp_path)).collect()
    assert {(r.node_id, r.value) for r in got} == {(n, n) for n in names.values()}
    with pytest.raises(ValueError, match="base folder"):
        files.read_auth_lines(spark, {"rel/x": "n3"})
    df = spark.createDataFrame([("/a/b/f",), ("/c",)], "p string")
    assert [r.node_id for r in files.tag_node(df, F.col("p"), {"/": "root", "/a": "a"}).orderBy("p").collect()] == ["a", "root"]


def test_conform(spark):
    rows = [("2026-05-14T12:00:00+0800", "5", "10.0.0.1", None), ("2026-05-14T12:00:00", "5", "::1", None),
            ("2026-05-14T12:00:00.123+0000", None, None, None), ("1700000000000", "5", "1.1.1.1", None), (None, "1", "1.1.1.1", None),
            ("14.05.2026", "5", "1.1.1.1", "timestamp"), ("2026-05-14T12:00:00", "x", "1.1.1.1", "severity"), ("2026-05-14T12:00:00", "5", "1.1.1.256", "src_ip")]
    df = spark.createDataFrame(rows, "timestamp string, severity string, src_ip string, want string").withColumn("source", F.lit("s"))
    out = sinks.conform_evidence(df)
    assert all(r.problem == r.want for r in out.collect())
    good, bad = sinks.split_valid(out)
    assert (good.count(), bad.count()) == (5, 3)
    c = sinks.bulk_counts(out).first()
    assert (c.stored, c.failed) == (5, 3)


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch.shared_dir(spark), scratch.shared_dir(spark)
    assert one.startswith(base + "/") and one != two


def test_messages(spark):
    df = spark.createDataFrame([(1, 1, '{"a": 1}'), (2, 2, "oops"), (3, 3, "[1"), (4, 1, "[1]")], "seq bigint, attempts int, payload string")
    good, bad = messages.decode(df, "a int")
    assert [(r.seq, r.a) for r in good.collect()] == [(1, 1)]
    again, dead = messages.retry_or_dead_letter(bad)
    assert sorted((r.seq, r.attempts) for r in again.collect()) == [(2, 3), (4, 2)]
    assert [r.seq for r in dead.collect()] == [3]


def test_loads_are_repeatable_and_pruned(spark, tmp_path):
    """A failed load counts for nothing, a repeated one once; the latest run is one partition by its plan."""
    base = str(tmp_path / "tables")
    rows = lambda n: spark.range(n).selectExpr("'s' || id AS signal_id", "timestamp'2024-01-01' + make_dt_interval(id % 3) AS at")
    assert sinks.write_tables({"signals": rows(30), "evidence": rows(5)}, base, "run-1") == {"signals": 30, "evidence": 5}
    with pytest.raises(ValueError, match="unknown table"):
        sinks.write_tables({"signals": rows(7), "nothing": rows(1)}, base, "run-3")
    for _ in range(2):
        sinks.write_tables({"signals": rows(12), "evidence": rows(0)}, base, "run-2")
    assert sinks.read_table(spark, base, "signals").count() == 42 and sinks.read_table(spark, base, "evidence").count() == 5
    assert {(r.run_id, r.tables["signals"]) for r in sinks.runs(spark, base).collect()} == {("run-1", 30), ("run-2", 12)}
    latest = sinks.read_table(spark, base, "signals", latest=True)
    assert latest.count() == 12 and {r.run_id for r in latest.select("run_id").collect()} == {"run-2"}
    executed = latest.select("signal_id")
    executed.collect()
    plan = executed._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    plan = plan.plan() if plan.getClass().getSimpleName() == "ResultQueryStageExec" else plan
    leaves = plan.collectLeaves()
    read = [leaves.apply(k).metrics().get("numPartitions") for k in range(leaves.size())]
    assert [m.get().value() for m in read if m.isDefined()] == [3]  # the days of one run


def test_counters_come_with_the_load(spark, tmp_path):
    """One scan: counted while writing."""
    from authloom.operators import parsing

    bad = [("2024-01-01T00:00:00", "5", "1.1.1.1", "a"), ("never", "5", "1.1.1.1", "b"), ("2024-01-01T00:00:00", "x", "1.1.1.1", "c"), (None, None, None, "d")]
    evidence = spark.createDataFrame(bad, "timestamp string, severity string, src_ip string, evidence_id string")
    evidence.write.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)
    counted = spark.read.parquet(str(tmp_path / "in")).mapInArrow(_tally(reads), evidence.schema)
    for _ in range(2):
        assert sinks.load_evidence(counted, str(tmp_path / "out"), "r") == {"read": 4, "stored": 2, "failed": 2}
    assert reads.value == 8  # four rows in each of two loads
    assert {(r.evidence_id, r.fits) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {
        ("a", "true"), ("b", "false"), ("c", "false"), ("d", "true")}
    lines = spark.createDataFrame([("Jan  1 00:00:01 h sshd[1]: Failed password for x from 1.1.1.1 port 1 ssh2", "n"), ("garbage", "n")], "value string, node_id string")
    parsed = parsing.parse_lines(lines, 2024)
    assert parsing.load_lines(parsed, str(tmp_path / "lines")) == {"lines_parsed": 2, "lines_inserted": 1, "errors": 0}


def _tally(reads):
    def run(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch
    return run


def test_search_reads_only_files_that_may_hold_the_text(spark, tmp_path):
    path, index = str(tmp_path / "t"), str(tmp_path / "i")
    for k in range(8):
        spark.range(50).selectExpr(f"id + {50 * k} AS n", f"concat('common words, File{k} row ', id) AS text").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(999, None), (1000, ""), (1001, "ab")], "n bigint, text string").coalesce(1).write.mode("append").parquet(path)
    sinks.write_text_index(spark, path, "text", index)
    assert sinks.files_with(spark, index, "file3 ROW").count() == 1 and sinks.files_with(spark, index, "common").count() == 8
    for needle in ("file3 row 1", "COMMON", "ab", "nowhere at all", "row 49"):
        got = sinks.search_files(spark, path, index, "text", needle, None, 10_000, ["n"])
        want = sinks.search(spark.read.parquet(path), None, ("text", needle), 10_000, ["n"])
        assert got.collect() == want.collect()
    assert len(sinks.search_files(spark, path, index, "text", "file3 row 1", None, 10, ["n"]).inputFiles()) == 1


def test_text_index_sorts_distinct_bits_only(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("'the same text' AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    sinks.write_text_index(spark, str(tmp_path / "t"), "text", str(tmp_path / "i"))
    bits = F.sum(F.bitmap_count("bits"))
    assert spark.read.parquet(str(tmp_path / "i")).agg(bits).first()[0] == len({"the same text"[k:k + 3] for k in range(11)})
    seen, kind = [], type(spark.range(1))
    group = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda df, *c: seen.append(df) or group(df, *c))
    sinks.write_text_index(spark, str(tmp_path / "t"), "text", str(tmp_path / "j"))
    assert [df.count() for df in seen] == [11]


def test_runs_of_signals_retrieve_no_evidence(spark, tmp_path):
    """Loads of signals and requests don't build the stage table of evidence, which nothing of theirs reads."""
    from authloom.workload import tables
    from authloom.workload.queries import QUERIES

    spark.range(300).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id as int)) AS ts", "id % 7 AS user_id",
        "element_at(array('error', 'click', 'view', 'signup', 'purchase'), cast(id % 5 as int) + 1) AS event_type",
        "1D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["committed_runs"](spark, str(tmp_path)).count() > 0
    built = {name for _, sf, name in tables._STORED if sf == str(tmp_path)}
    assert "requests" in built and "evidence" not in built
