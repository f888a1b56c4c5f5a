from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from authloom import schemas
from authloom.functions import fixed
from authloom.operators import normalize, readiness, reporting, triage, verification
from authloom.plans import cases as plan

SCHEMA = f"case_key string, ord bigint, {schemas.EVIDENCE}"
T0 = datetime(2026, 5, 14, 12)


def row(i, **kw):
    base = dict(case_key="c", ord=i, timestamp=(T0 + timedelta(seconds=60 * i)).strftime("%Y-%m-%dT%H:%M:%SZ"),
                severity=5, rule_id="5503", description="SSH登录失败", src_ip="10.0.0.1", hostname="h",
                evidence_id=f"ev-{i}", source="wazuh", raw_log="raw", raw_ref="n/auth_log#x", lineage_id="q:1",
                query_id="q")
    base.update(kw)
    return base


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def score(spark, rows):
    return readiness.readiness(frame(spark, rows)).first()


def test_clean_and_sparse_rows(spark):
    assert (score(spark, [row(i) for i in range(5)]).score) == 100
    r = score(spark, [row(i, hostname=None, raw_log=None) for i in range(3)])
    assert (r.score, r.level, r.allowed_actions) == (100, "完整可用", ["analyze", "report", "persist"])


def test_coverage_keeps_the_float_order(spark):
    rows = [row(i) for i in range(5)]
    for i in range(3):
        rows[i]["src_ip"] = None
    r = score(spark, rows)
    assert r.score == 97 and r.issues == ["字段覆盖度不足：3/30 个必需字段缺失"]


@pytest.mark.parametrize("times,lost,words", [
    ((60, 0), 10, "时间戳存在乱序"), ((0, 0), 10, "时间跨度不足 30 秒（当前 0 秒）"), ((10, 0), 20, "时间戳存在乱序"),
    ((0,), 10, "时间戳不足 2 条（当前 1 条），无法评估时序一致性")])
def test_temporal(spark, times, lost, words):
    rows = [row(i, timestamp=(T0 + timedelta(seconds=t)).strftime("%Y-%m-%d %H:%M:%S")) for i, t in enumerate(times)]
    r = score(spark, rows)
    assert r.score == 100 - lost and words in r.issues and r.checks.temporal_consistency == "failed"


def test_order_is_seen_across_runs(spark):
    rows = [row(i) for i in range(10)]
    rows[7]["timestamp"] = "2026-05-14T11:00:00Z"
    for size in (2, 3, 100):
        assert readiness.time_order(frame(spark, rows), run=size).first().unordered is True
    assert readiness.time_order(frame(spark, rows[:7]), run=2).first().unordered is False


def test_duplicates_and_empty_case(spark):
    rows = [row(0, evidence_id="x"), row(1, evidence_id="x")]
    assert score(spark, rows).score == 90
    known = spark.createDataFrame([("c",), ("empty",)], "case_key string")
    r = readiness.readiness(frame(spark, rows), known).where("case_key = 'empty'").first()
    assert (r.score, r.level, r.allowed_actions, r.checks.field_coverage) == (40, "数据不足", ["analyze"], "passed")
    t = triage.triage(frame(spark, rows), known).where("case_key = 'empty'").first()
    assert (t.priority, t.event_type, t.confidence, t.summary) == ("low", "unknown", "low", "无证据，无法分诊")
    assert readiness.gate(readiness.readiness(frame(spark, rows), known), "report").count() == 1


@pytest.mark.parametrize("rules,want", [
    (["5503"] * 5, ("brute_force", "high", "high")), (["5503"] * 3, ("brute_force", "high", "medium")),
    (["ssh_failed_password"] * 6, ("unknown", "medium", "low")), (["5710"] * 3 + ["5503"], ("brute_force", "high", "medium")),
    (["5710", "5712"], ("scanning", "medium", "low")), (["5712", "5710", "5710"], ("scanning", "medium", "medium"))])
def test_triage(spark, rules, want):
    t = triage.triage(frame(spark, [row(i, rule_id=r) for i, r in enumerate(rules)])).first()
    assert (t.event_type, t.priority, t.confidence) == want


def test_kill_chain(spark):
    sev = [5, 3, 9, None, 12, 15, 99]
    chain = triage.kill_chain(frame(spark, [row(i, severity=s, description="" if i == 1 else "d") for i, s in enumerate(sev)]))
    got = {r.kill_chain_phase: (r.evidence_count, r.first_ord, r.description) for r in chain.collect()}
    assert got == {fixed.PHASE_WEAPON: (1, 0, "d"), fixed.PHASE_RECON: (2, 1, "规则 5503 触发的告警"),
                   fixed.PHASE_EXPLOIT: (2, 2, "d"), fixed.PHASE_C2: (1, 4, "d"), fixed.PHASE_ACTIONS: (1, 5, "d")}
    assert triage.chain_progress(chain).first().progress.startswith(f"攻击链进展: {fixed.PHASE_WEAPON}, {fixed.PHASE_RECON}")


def review(spark, rows, **kw):
    ev = frame(spark, rows)
    return plan.review(ev, ev.select("case_key").distinct(), **kw).first()


@pytest.mark.parametrize("n,confidence", [(4, "中"), (5, "高")])
def test_verified(spark, n, confidence):
    r = review(spark, [row(i) for i in range(n)])
    assert (r.verified, r.final_confidence, r.issues) == (True, confidence, [])
    assert r.final_conclusion == r.conclusion


@pytest.mark.parametrize("change,check", [
    (dict(raw_ref=""), "raw_ref"), (dict(raw_ref="nowhere"), "raw_ref"), (dict(lineage_id=None), "lineage_id"),
    (dict(lineage_id="plain"), "lineage_id"), (dict(query_id="other"), "query_id")])
def test_failed_checks(spark, change, check):
    r = review(spark, [row(i) for i in range(4)] + [row(4, **change)])
    assert not r.verified and r.checks[check] == "failed" and r.final_confidence == "低"
    assert sum(v == "failed" for v in r.checks.asDict().values()) == 1
    assert r.final_conclusion == "证据有限或校验未通过，结论谨慎使用"


def test_dangling_reference_and_issue_text(spark):
    refs = spark.createDataFrame([("c", 0, "ev-0"), ("c", 1, "ghost"), ("c", 2, "")], "case_key string, ord bigint, evidence_id string")
    r = review(spark, [row(i) for i in range(5)], refs=refs)
    assert r.issues == ["研判引用了不存在的 evidence_id: ['ghost']"]


def test_conclusion_rules(spark):
    df = spark.createDataFrame([("系统遭 APT攻击", 5, 100), ("12345678901", 2, 100), ("1234567890", 2, 100), ("ok", 3, 59), ("ok", 2, 59)],
                               "t string, n bigint, s int")
    got = [len(r[0]) for r in df.select(verification.conclusion_issues(F.col("t"), F.col("n"), F.col("s"))).collect()]
    assert got == [1, 1, 0, 1, 0]


def test_lineage_status_stops_at_the_first_bad_row(spark):
    rows = [row(0), row(1, lineage_id="x"), row(2)]
    got = {r.evidence_id: r.status for r in verification.lineage_status(frame(spark, rows)).collect()}
    assert got == {"ev-0": "valid", "ev-1": "invalid_format"}


def test_replies(spark):
    ev = frame(spark, [row(i, case_key=k) for k in "abcd" for i in range(3)])
    replies = spark.createDataFrame([
        ("a", 'x ```json\n{"event_type": "scanning"}\n``` y'), ("b", "```\n{\"priority\": \"low\", \"suggested_actions\": [\"z\"]}```"),
        ("c", "{broken")], "case_key string, reply string")
    got = {r.case_key: r for r in triage.analysis(ev, None, replies).collect()}
    assert (got["a"].event_type, got["a"].priority, got["a"].summary, got["a"].actions) == ("scanning", "medium", "LLM 分析完成", [])
    assert (got["b"].event_type, got["b"].priority, got["b"].actions) == ("unknown", "low", ["z"])
    assert got["c"].event_type == got["d"].event_type == "brute_force" and len(got["c"].actions) == 4


def test_report_is_whole_however_it_is_cut(spark):
    ev = frame(spark, [row(i) for i in range(7)])
    rev = plan.review(ev, ev.select("case_key").distinct())

    def text(block):
        parts = reporting.report_parts(rev, ev, F.lit("20260514_203349"), block=block).orderBy("part").collect()
        return len(parts), "".join(p.text for p in parts)

    (n1, whole), (n2, cut) = text(1000), text(2)
    assert whole == cut and (n1, n2) == (3, 6)
    assert whole.count("【证据 ") == 7 and "- 发现问题：[]" in whole and "**通过**" in whole


def test_normalize_goldens(spark):
    from authloom.functions.times import normalize_ts

    df = spark.createDataFrame([("2026-05-14T12:00:00Z",), ("2026-05-14T12:00:00+08:00",), ("2026-05-14T12:00:00",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(normalize_ts(F.col("t"), F.lit("NOW"), "+0800")).collect()]
    assert got == ["2026-05-14T12:00:00Z", "2026-05-14T12:00:00+0800", "2026-05-14T12:00:00+0800", "NOW", "NOW"]
    ev = spark.createDataFrame([(k, "", "t") for k in [*fixed.LOG_TYPE_SEVERITY, "zzz"]], "log_type string, src_ip string, timestamp string")
    for c in ("message", "hostname", "evidence_id", "raw_line", "raw_ref", "lineage_id", "query_id"):
        ev = ev.withColumn(c, F.lit(None).cast("string"))
    out = {r.rule_id: (r.severity, r.src_ip, r.description) for r in normalize.normalize_auth(ev, F.lit("N")).collect()}
    assert out["ssh_accepted"] == (1, "0.0.0.0", "") and out["zzz"][0] == 3 and out["su_failed"][0] == 5


def test_review_has_no_unbounded_lists_or_cross_joins(spark):
    ev = frame(spark, [row(i) for i in range(3)])
    text = plan.review(ev, ev.select("case_key").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_evidence_is_scanned_few_times(spark, tmp_path):
    import re

    from authloom.plans import cases as case_plan

    columns = "case_key string, ord bigint, " + ", ".join(f"{c} string" for c in (
        "timestamp", "severity", "rule_id", "description", "src_ip", "hostname", "evidence_id", "source", "raw_log", "raw_ref",
        "lineage_id", "query_id"))
    rows = [(f"c{i % 3}", i, "2024-01-01T00:00:00", "5", "5503", "d", "1.1.1.1", "h", f"e{i % 7}", "s", "r", "n/a#1", "q:1", f"q{i % 2}")
            for i in range(40)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "ev"))
    ev = spark.read.parquet(str(tmp_path / "ev"))
    refs = ev.select("case_key", "ord", "evidence_id")
    out = case_plan.review(ev, spark.createDataFrame([("c0",), ("c9",)], "case_key string"), refs=spark.createDataFrame(
        refs.collect(), refs.schema))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Scan parquet", plan)) <= 4


def test_parts_name_every_value(spark):
    """A case with a hundred thousand unknown ids: parts of a thousand, no longer cell, and none left out."""
    from authloom.operators import verification

    refs = spark.range(100_000).selectExpr("'c' AS case_key", "id AS ord", "'ghost-' || lpad(id, 6, '0') AS evidence_id").unionByName(
        spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 0, "y"), ("d", 2, ""), ("d", 3, None)], "case_key string, ord bigint, evidence_id string"))
    none = spark.createDataFrame([], "case_key string, evidence_id string")
    issues = {r.case_key: r.ref_issue for r in verification.check_refs(refs, none).collect()}
    assert issues["d"] == "研判引用了不存在的 evidence_id: ['y', 'x', 'x']"
    assert issues["c"].count("ghost-") == verification.LISTED and issues["c"].endswith("（第 1 部分，共 100 部分，100000 项）")
    parts = verification.dangling_parts(refs, none, run=3000).collect()
    assert sum(r.n for r in parts) == 100_003 and max(r.n for r in parts) == verification.LISTED
    every = ", ".join(r.listed for r in sorted(parts, key=lambda r: r.part) if r.case_key == "c")
    assert every == ", ".join(f"'ghost-{k:06d}'" for k in range(100_000))
    assert max(len(r.listed) for r in parts) < 20_000


def test_many_queries_of_a_case(spark):
    from authloom.operators import verification

    rows = spark.range(5000).selectExpr("'c' AS case_key", "id AS ord", "'e' || id AS evidence_id", "'n/a#1' AS raw_ref", "'q:1' AS lineage_id",
                                        "'q' || lpad(id % 2500, 4, '0') AS query_id")
    row = verification.trace_checks(rows).first()
    assert row.query_issue.startswith("证据来自多个查询: {'q0000', 'q0001'") and row.query_issue.endswith("（第 1 部分，共 3 部分，2500 项）")
    assert row.query_issue.count("'q") == verification.LISTED


def test_report_parts_carry_what_is_largest_in_their_case(spark):
    """Every part has the case's last time, also where a case has many runs, without a join of the texts."""
    ev = frame(spark, [row(i * 60_000, case_key=k, timestamp=f"2026-05-{14 + (i + n) % 5:02d}T10:00:00Z")
                       for n, k in enumerate("ab") for i in range(5 - 3 * n)])
    last = {"at": F.col("timestamp").cast("timestamp")}
    at_of = ev.groupBy("case_key").agg(F.max(last["at"]).alias("at"))
    rev = plan.review(ev, ev.select("case_key").distinct()).join(at_of, "case_key")
    plain = reporting.report_parts(rev, ev, F.lit("20260514_203349"), block=2).join(at_of, "case_key")
    got = reporting.report_parts(rev, ev, F.lit("20260514_203349"), block=2, largest=last)
    rows = lambda df: sorted(map(tuple, df.select("case_key", "part", "text", "at").collect()))
    assert rows(got) == rows(plain) and len(rows(got)) == 5 + 3
    assert {r.at.day for r in got.collect()} == {18, 16}


def test_a_review_names_every_unknown_id_and_query(spark):
    """More than a part of a listing: unknown ids over several runs of places, one without a place, and queries."""
    ev = frame(spark, [row(i, query_id=f"q{i:04d}") for i in range(1200)])
    refs = spark.range(2500).selectExpr("'c' AS case_key", "id * 1000 - 50000 AS ord", "'ghost-' || lpad(id, 4, '0') AS evidence_id").unionByName(
        spark.createDataFrame([("c", None, "z"), ("c", 7, "x"), ("c", 7, "x"), ("c", 7, "ev-3"), ("c", 8, ""), (None, 1, "y")],
                              "case_key string, ord bigint, evidence_id string"))
    r = plan.review(ev, ev.select("case_key").distinct(), refs=refs).first()
    ghosts = [f"ghost-{k:04d}" for k in range(2500)]
    want = ["z", *ghosts[:51], "x", "x", *ghosts[51:]]
    assert r.issues[:2] == [f"{fixed.UNKNOWN_REFS}{str(want)[1:-1]}]",
                            f"{fixed.SEVERAL_QUERIES}{str([f'q{i:04d}' for i in range(1200)])[1:-1]}}}"]
    assert [x.case_key for x in verification.check_refs(refs, ev, most=None).collect()] == ["c"]
    base = spark.createDataFrame([("c", "text", 100, 1200)], "case_key string, conclusion string, score int, evidence_count bigint")
    assert verification.verify(base, base, ev, refs).first().issues[:2] == r.issues[:2]
