import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.operators import detection, rules as rule_ops

T0 = datetime(2024, 5, 1)
SCHEMA = ("node_id string, id bigint, timestamp timestamp_ntz, process string, message string, "
          "src_ip string, dst_user string")
MESSAGES = {
    "LOCAL_SSH_BRUTE_FORCE": ("sshd", "Failed password for x"),
    "LOCAL_SSH_SCAN": ("sshd", "Did not receive identification string from y"),
    "LOCAL_SUDO_FAILURES": ("sudo", "authentication failure"),
    "LOCAL_SU_FAILURES": ("su", "FAILED SU (to x)"),
    "LOCAL_SSH_ACCEPTED": ("sshd", "Accepted password for x"),
}


def events(spark, items):
    """items: (second, rule id, ip, user)"""
    rows = [("n", i, T0 + timedelta(seconds=s), *MESSAGES[rid], ip, user)
            for i, (s, rid, ip, user) in enumerate(items)]
    return spark.createDataFrame(rows, SCHEMA)


def fired(spark, items, rules=None):
    return detection.fires(events(spark, items), rules or fixed.DEFAULT_RULES)


def test_seed_log_fires_only_the_login(spark):
    items = [(0, "LOCAL_SSH_ACCEPTED", "10.0.0.9", "a")]
    items += [(i, "LOCAL_SSH_BRUTE_FORCE", "10.0.0.5", "a") for i in range(4)]
    items += [(4, "LOCAL_SSH_BRUTE_FORCE", "10.0.0.8", "a")]
    rows = detection.build_signals(fired(spark, items), fixed.DEFAULT_RULES).collect()
    assert [(r.rule_id, r.src_ip, r.matched_count, r.rule_level) for r in rows] == [
        ("LOCAL_SSH_ACCEPTED", "0.0.0.0", 1, 2)]
    assert rows[0].raw_ref == "n/auth_log#global#2024-05-01T00:00:00Z"
    assert rows[0].rule_desc == "SSH Successful Login: 1 matches from global"


@pytest.mark.parametrize("rid,n,level,by_ip", [
    ("LOCAL_SSH_BRUTE_FORCE", 6, 8, True), ("LOCAL_SSH_SCAN", 4, 5, True),
    ("LOCAL_SUDO_FAILURES", 4, 5, False), ("LOCAL_SU_FAILURES", 4, 5, False)])
def test_scenarios(spark, rid, n, level, by_ip):
    items = [(i * 5, rid, "10.0.99.1", "root") for i in range(n)]
    rows = detection.build_signals(fired(spark, items), fixed.DEFAULT_RULES).collect()
    assert [(r.rule_id, r.rule_level, r.src_ip) for r in rows] == [
        (rid, level, "10.0.99.1" if by_ip else "0.0.0.0")]


def test_event_exactly_one_window_old_counts(spark):
    items = [(0, "LOCAL_SSH_BRUTE_FORCE", "1", "a")] + [
        (300, "LOCAL_SSH_BRUTE_FORCE", "1", "a")] * 4
    assert fired(spark, items).count() == 1
    items[0] = (-1, "LOCAL_SSH_BRUTE_FORCE", "1", "a")
    assert fired(spark, items).count() == 0


def test_matching_is_case_sensitive_with_wildcards_and_skips_unusable_rules(spark):
    ev = spark.createDataFrame(
        [("n", 1, T0, "sshd", "error: PAM: Authentication failure", None, None),
         ("n", 2, T0, "sshd", "a_c 100% \\d", None, None)], SCHEMA)
    mk = lambda rid, *p: {"id": rid, "match": {"process": "sshd", "patterns": list(p)}}
    rules = [mk("r1", "authentication failure"), mk("r2", "a_c"), mk("r3", "a%\\d"),
             {"id": "r4", "match": {"process": "sshd"}}, {"id": "r5", "match": {"patterns": ["a"]}}]
    want = {("r2", 2), ("r3", 2)}
    assert {(r.rule_id, r.id) for r in rule_ops.match_rules(ev, rules).collect()} == want
    assert rule_ops.match_rules(ev, []).count() == 0
    many = [mk(f"m{i}", f"zz{i}") for i in range(120)] + rules
    assert {(r.rule_id, r.id) for r in rule_ops.match_rules(ev, many).collect()} == want


def brute_fires(items, rules):
    out = set()
    for rule in rules:
        th = rule["threshold"]
        groups = {}
        for s, rid, ip, user in items:
            if rid == rule["id"]:
                g = {"src_ip": ip, "dst_user": user}.get(th.get("group_by")) or "global"
                groups.setdefault(g, []).append(s)
        for g, secs in groups.items():
            last = None
            for t in sorted(set(secs)):
                c = sum(t - th["window_seconds"] <= s <= t for s in secs)
                if c >= th["count"] and (last is None or t >= last + rule["cooldown_seconds"]):
                    last = t
                    out.add((rule["id"], g, t, c))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_and_cooldown_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    # one hot group holds most rows
    items = [(rnd.randrange(4000), rnd.choice(list(MESSAGES)),
              rnd.choice(["hot"] * 6 + ["b", "c", None]), rnd.choice(["u"] * 5 + ["v", None]))
             for _ in range(1500)]
    got = {(r.rule_id, r.group_key, int((r.timestamp - T0).total_seconds()), r.window_count)
           for r in fired(spark, items).collect()}
    assert got == brute_fires(items, fixed.DEFAULT_RULES)




@pytest.mark.parametrize("more", [0, 100])
def test_nulls_mean_defaults_in_any_catalog(spark, more):
    ev = spark.createDataFrame([("n", i, T0, "sshd", "hello", f"10.0.0.{i}", None) for i in range(3)], SCHEMA)
    plain = {"match": {"process": "sshd", "patterns": ["hello"]}}
    rules = [{**plain, "id": "a", "threshold": {"count": None, "window_seconds": None}, "cooldown_seconds": None, "signal": None},
             {**plain, "id": "b"}, {**plain}, {**plain, "id": "c", "threshold": {"count": "x"}}, "nonsense",
             {**plain, "id": "d", "threshold": {"group_by": "src_ip"}}]
    rules += [{"id": f"x{i}", "match": {"process": "sshd", "patterns": [f"never {i}"]}} for i in range(more)]
    usable, problems = rule_ops.normalise(rules)
    assert [r.rule_id for r in usable][:3] == ["a", "b", "d"] and len(problems) == 3
    rows = {(r.rule_id, r.need, r.window_seconds, r.cooldown_seconds) for r in rule_ops.match_rules(ev, rules).collect()}
    assert rows == {(k, 1, 300, 600) for k in "abd"}
    with pytest.raises(ValueError, match="groups by 'nothing'"):
        rule_ops.match_rules(ev, [{**plain, "id": "e", "threshold": {"group_by": "nothing"}}])
    assert detection.fires(ev, [{**plain, "id": "w", "threshold": {"window_seconds": 0}}]).count() == 1


def test_one_key_with_most_hits(spark):
    items = [(k, "LOCAL_SSH_BRUTE_FORCE", "hot", "u") for k in range(0, 9000, 3)] + [
        (k, "LOCAL_SSH_BRUTE_FORCE", f"ip{k % 7}", "u") for k in range(300)]
    got = {(r.rule_id, r.group_key, int((r.timestamp - T0).total_seconds()), r.window_count) for r in fired(spark, items).collect()}
    assert got == brute_fires(items, fixed.DEFAULT_RULES)


def catalog_of(spark, rules):
    return rule_ops.parse_catalog(spark.createDataFrame([(json.dumps(r),) for r in rules], "doc string"))


def test_catalog_as_data_equals_constant_rules(spark):
    """Wildcards, short and empty patterns, shared pieces, several patterns of a rule, defaults."""
    messages = ["error: PAM: Authentication failure", "a_c 100% \\d", "Failed password for root from 10.0.0.1", "abc", "", None,
                "Failed none for root", "aaaaaaaa", "日本語のログ"]
    ev = spark.createDataFrame([("n", 10 * i + k, T0, p, m, "1", "u") for k, p in enumerate(["sshd", "su"])
                                for i, m in enumerate(messages)], SCHEMA)
    mk = lambda rid, *p, **more: {"id": rid, "match": {"process": "sshd", "patterns": list(p)}, **more}
    rules = [mk("r1", "authentication failure"), mk("r2", "a_c"), mk("r3", "a%\\d"), mk("r4", "Failed password", "Failed", "for root"),
             mk("r5", "%"), mk("r6", ""), mk("r7", "Failed%root%10"), mk("r8", "aaaa", "aaa"), mk("r9", "のログ"), mk("r10", "本語の"),
             mk("r11", "F_iled password", threshold={"count": 3, "window_seconds": 7, "group_by": "src_ip"}, cooldown_seconds=9),
             {"id": "r12", "match": {"process": "su", "patterns": ["Failed"]}, "threshold": {"group_by": "dst_user"}}]
    columns = ["id", "rule_id", "need", "window_seconds", "cooldown_seconds", "group_key"]
    want = sorted(map(tuple, rule_ops.match_rules(ev, rules).select(*columns).collect()))
    assert sorted(map(tuple, rule_ops.match_catalog(ev, catalog_of(spark, rules)).select(*columns).collect())) == want and len(want) > 20
    assert rule_ops.match_catalog(ev, catalog_of(spark, rules).limit(0)).count() == 0
    assert rule_ops.match_catalog(ev.limit(0), catalog_of(spark, rules)).count() == 0
    odd = catalog_of(spark, [mk("x", "Failed", threshold={"group_by": "nothing"})])
    with pytest.raises(Exception, match="groups by nothing"):
        rule_ops.match_catalog(ev, odd).collect()


def test_twenty_thousand_rules(spark):
    """Found by their pieces; the plan is that of a catalog of one rule."""
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(20_000)})
    rules = [{"id": n, "match": {"process": "sshd", "patterns": [f"user {n} from", f"no {n}"]}} for n in names]
    rows = [("n", i, T0, "sshd", f"login of user {rnd.choice(names)} from here, no {rnd.choice(names)[:6]}", "1", "u") for i in range(500)]
    ev = spark.createDataFrame(rows, SCHEMA)
    catalog = catalog_of(spark, rules)
    got = {(r.id, r.rule_id) for r in rule_ops.match_catalog(ev, catalog).collect()}
    known = set(names)
    want = {(r[1], w) for r in rows for w in [r[4].split("user ")[1][:7]] if w in known}
    assert got == want and len(got) == 500
    size = lambda c: len(rule_ops.match_catalog(ev, c)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(catalog) - size(catalog_of(spark, rules[:1]))) < 200  # but for numbers of columns


def test_three_hundred_windows(spark):
    """As many window lengths as rules, one frame."""
    rules = [{"id": f"w{k}", "match": {"process": "sshd", "patterns": ["Accepted"]}, "cooldown_seconds": 0,
              "threshold": {"count": 3, "window_seconds": k}} for k in range(300)]
    secs = sorted(random.Random(7).sample(range(2000), 150))
    ev = events(spark, [(s, "LOCAL_SSH_ACCEPTED", "1", "u") for s in secs])
    hits = detection.threshold_hits(ev, catalog_of(spark, rules))
    got = {(r.rule_id, (r.us - int(T0.replace(tzinfo=timezone.utc).timestamp()) * 10**6) // 10**6, r.window_count) for r in hits.collect()}
    want = {(f"w{k}", t, c) for k in range(300) for t in secs if (c := sum(t - k <= s <= t for s in secs)) >= 3}
    assert got == want
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") == 1


@pytest.mark.parametrize("block", [1, 600, 86_400])
def test_cooldown_of_one_key_spreads(spark, block):
    """95 % of the hits in one key: judged in many tasks, equal to one ordered fold."""
    rnd = random.Random(block)
    hits = [("n", "r", "hot", us * 10**6 + rnd.randrange(3), 5, 37) for us in rnd.sample(range(40_000), 9500)]
    hits += [("n", "r", f"g{k % 50}", rnd.randrange(40_000) * 10**6, 5, 37) for k in range(400)] + [("n", "f", "free", k, 1, 0) for k in range(100)]
    hits = list(set(hits))
    df = spark.createDataFrame(hits, "node_id string, rule_id string, group_key string, us bigint, window_count bigint, cooldown_seconds int")
    judged = detection.judge_hits(df, block_seconds=block)
    got = {(r.rule_id, r.group_key, r.us) for r in judged.where("fired").withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp"))).collect()}
    want, last = set(), {}
    for _, rule, group, us, _, wait in sorted(hits):
        if last.get((rule, group)) is None or us >= last[rule, group] + wait * 10**6:
            last[rule, group] = us
            want.add((rule, group, us))
    assert got == want and judged.count() == len(hits)
    if block < 86_400:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
        tasks = judged.where("group_key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert tasks > 2


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_rules_of_a_catalog_file(spark, tmp_path, kind):
    """A catalog file from reading to fires, with what makes no rule named."""
    rules = [*fixed.DEFAULT_RULES, {"id": "broken"}]
    path = tmp_path / f"rules.{kind}"
    if kind == "yaml":
        yaml = pytest.importorskip("yaml")
        path.write_text(yaml.safe_dump({"rules": rules}), encoding="utf-8")
    else:
        path.write_text(json.dumps({"rules": rules}), encoding="utf-8")
    loaded = rule_ops.load_rules(str(path))
    usable, problems = rule_ops.normalise(loaded)
    assert len(usable) == len(fixed.DEFAULT_RULES) and problems == [f"rule {len(usable)}: has no process or no patterns"]
    items = [(k, "LOCAL_SSH_BRUTE_FORCE", "hot", "u") for k in range(0, 900, 3)]
    got = {(r.rule_id, r.group_key, int((r.timestamp - T0).total_seconds()), r.window_count) for r in fired(spark, items, loaded).collect()}
    assert got == brute_fires(items, fixed.DEFAULT_RULES) and got
    (tmp_path / "empty.json").write_text("null")
    assert rule_ops.load_rules(str(tmp_path / "empty.json")) == []


def test_messages_cut_into_pieces_stay_off_the_driver(spark, tmp_path):
    """Pieces of messages are many rows of a small file: they are shuffled, and only those that rules may have."""
    spark.range(2000).selectExpr("id", "'n' AS node_id", "'sshd' AS process", "'Failed password for user' || id || ' from 10.0.0.1' AS message",
                                 "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS timestamp").write.parquet(str(tmp_path / "ev"))
    rules = [{"id": f"R{i}", "match": {"process": "sshd", "patterns": [f"user{i} from", "no such"]}} for i in (7, 1234, 99999)]
    found = rule_ops.match_catalog(spark.read.parquet(str(tmp_path / "ev")), catalog_of(spark, rules))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [process" not in plan and "BroadcastHashJoin [_of" not in plan
    assert sorted((r.id, r.rule_id) for r in found.collect()) == [(7, "R7"), (1234, "R1234")]


def test_a_pattern_stands_under_its_most_telling_piece(spark):
    """Numbered patterns share pieces of four characters with many others, but not their longer ones."""
    rules = [{"id": f"R{i}", "match": {"process": "sshd", "patterns": [f"port {i}%ssh2"]}} for i in range(100000, 103000)]
    most = rule_ops.pattern_index(catalog_of(spark, rules)).groupBy("gram").count().agg({"count": "max"}).first()[0]
    assert most == 1


def most_written(node):
    """The most rows that one shuffle of a plan has written."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_written(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return most_written(node.plan())
    own = node.metrics().get("shuffleRecordsWritten")
    below = [most_written(node.children().apply(i)) for i in range(node.children().size())]
    return max([own.get().value() if own.isDefined() else 0, *below])


def test_pieces_of_patterns_are_not_shuffled(spark):
    """Three thousand patterns have some fifty thousand pieces, of which each pattern needs one."""
    rules = [{"id": f"R{i}", "match": {"process": "sshd", "patterns": [f"port {i}%ssh2"]}, "threshold": {"group_by": "dst_user" if i % 2 else None}}
             for i in range(100000, 103000)]
    ev = spark.range(2000).selectExpr("'n' AS node_id", "id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS timestamp", "'sshd' AS process",
                                      "'a port ' || (id + 100000) || ' ssh2' AS message", "'1' AS src_ip", "'u' || id AS dst_user", "repeat(id, 100) AS raw_line")
    found = rule_ops.match_catalog(ev, catalog_of(spark, rules)).select("id", "rule_id", "group_key")
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.execute().count() == 2000 and most_written(plan) <= 6000
    assert {(r.id, r.rule_id, r.group_key) for r in found.collect()} == {
        (k, f"R{k + 100000}", "global" if k % 2 == 0 else f"u{k}") for k in range(2000)}


def test_few_pieces_of_messages_pass_for_pieces_of_a_large_index(spark):
    """Of a million pieces that no rule has, at most one in a thousand looks like one of two million that rules have."""
    index = spark.range(2_000_000).selectExpr("'sshd' AS process", "'piece' || id AS gram")
    other = spark.range(1_000_000).selectExpr("'sshd' AS process", "'other' || id AS gram")
    bits = F.expr(rule_ops._bits("h"))

    def passes(rows):
        word = F.get(rule_ops._piece_bits(index), F.expr(f"cast(h & {rule_ops.WORDS - 1} AS int)"))
        return rows.withColumn("h", F.xxhash64("process", "gram")).where(word.bitwiseAND(bits) == bits).count()

    assert passes(other) < 1000 and passes(index.where("gram LIKE 'piece77%'")) == 11_111


def matched(spark, rows):
    """Matches of one node: rule, window in seconds, microseconds since 1970."""
    return spark.createDataFrame([("n", r, "g", 1, w, 0, us) for r, w, us in rows],
                                 "node_id string, rule_id string, group_key string, need int, window_seconds int, cooldown_seconds int, us bigint").selectExpr(
        "* EXCEPT (us)", "CAST(timestamp_micros(us) AS timestamp_ntz) AS timestamp")


def test_windows_end_to_the_microsecond(spark):
    """Instants one window apart count, one microsecond more doesn't; wherever a bucket ends, before 1970 as well."""
    rnd, rows = random.Random(11), []
    for k in range(600):
        window = rnd.choice([1, 3, 7, 97, 7919, 86_399, 2_591_999, 31_536_001])
        us = rnd.randrange(-10**15, 2 * 10**15)
        rows += [(f"r{k}", window, us + d) for d in (0, window * 10**6, window * 10**6 + 1, 3 * window * 10**6)]
    got = {(r.rule_id, r.us): r.window_count for r in detection.sliding_counts(matched(spark, rows)).collect()}
    want = {(r, t): sum(t - w * 10**6 <= us <= t for q, _, us in rows[i // 4 * 4:i // 4 * 4 + 4]) for i, (r, w, t) in enumerate(rows)}
    assert got == want and set(want.values()) == {1, 2}


def test_rows_visit_few_buckets(spark):
    """A group of many windows: an instant is shuffled once, and some a second time, for what comes after their bucket."""
    plan = detection.sliding_counts(matched(spark, [("r", 10, 10**6 * k) for k in range(8000)]))._jdf.queryExecution().executedPlan()
    assert plan.execute().count() == 8000 and most_written(plan) < 10_500
