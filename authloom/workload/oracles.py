"""DuckDB SQL giving the same rows as ``queries.py``, written from the semantics.

Parsed columns are computed straight from the event fields (no regex), sliding counts by self
joins or frames, cool-downs by recursion: other ways than the Spark side takes.
"""

from __future__ import annotations

from authloom.functions import fixed
from authloom.workload import texts
from authloom.workload.tables import DAY, rules

ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-15 00:00:00'"
NOW_TEXT = "'2024-02-01T00:00:00+0000'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_of(expr: str, table: dict, default: str | None = None) -> str:
    whens = " ".join(
        f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {expr} {whens}" + (f" ELSE {default}" if default is not None else "") + " END"


def h16(*cols: str) -> str:
    return "substr(sha256(concat_ws('|', " + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + ")), 1, 16)"


# --- log lines and their parsed form ---------------------------------------------------------
BASE = """
base AS (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS sec, ts,
  event_id % 20 AS k, event_id % 97 AS d, 'node-' || user_id % 3 AS node_id,
  'host-' || user_id % 3 AS host, '10.0.' || user_id // 256 || '.' || user_id % 256 AS ip,
  1024 + event_id % 60000 AS port, 1000 + event_id % 50000 AS pid, 'user' || user_id AS usr,
  strftime(ts, '%b') AS month, CAST(day(ts) AS VARCHAR) AS day1, strftime(ts, '%d') AS day2,
  strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y%m%d') AS ymd FROM events)"""
LINES = f"""{BASE},
parts AS (SELECT *, {texts.MESSAGE} AS message, {texts.PROCESS} AS proc, {texts.STAMP} AS stamp,
  {texts.PID_TEXT} AS pid_text FROM base),
ln AS (SELECT *, {texts.RAW_LINE} AS raw_line FROM parts)"""
PARSED = f"""{LINES},
cls AS (SELECT *,
  CASE WHEN d = 5 THEN 'header' WHEN d IN (7, 11) THEN 'timestamp' WHEN d = 13 THEN 'integer' END AS reject,
  CASE event_type
   WHEN 'error' THEN CASE WHEN k IN (1, 2) THEN 'ssh_auth_failure' ELSE 'ssh_failed_password' END
   WHEN 'click' THEN CASE WHEN k IN (0, 4, 8) THEN 'ssh_scan' WHEN k = 3 THEN 'ssh_preauth_disconnect'
     WHEN k IN (7, 11) THEN 'ssh_other' ELSE 'ssh_connection_closed' END
   WHEN 'view' THEN 'ssh_accepted'
   WHEN 'signup' THEN CASE k WHEN 0 THEN 'sudo_success' WHEN 1 THEN 'sudo_other' ELSE 'sudo_auth_failure' END
   ELSE CASE k WHEN 0 THEN 'su_success' WHEN 1 THEN 'su_other' WHEN 2 THEN 'login_other' ELSE 'su_failed' END
  END AS log_type FROM ln),
pl AS (SELECT event_id, node_id, 'auth.log-' || ymd AS file, sec, host AS hostname, proc AS process,
  CAST(CASE WHEN d = 17 THEN 0 WHEN d = 13 THEN NULL ELSE pid END AS INTEGER) AS pid, message, raw_line,
  reject, log_type, ip, port, d,
  CASE log_type WHEN 'ssh_failed_password' THEN usr WHEN 'ssh_accepted' THEN usr
   WHEN 'ssh_connection_closed' THEN CASE WHEN k IN (1, 5, 9) THEN usr END
   WHEN 'sudo_success' THEN 'root' WHEN 'sudo_auth_failure' THEN CASE WHEN k = 2 THEN 'eve' ELSE usr END
   WHEN 'su_success' THEN 'root' WHEN 'su_failed' THEN usr END AS dst_user,
  CASE WHEN log_type IN ('ssh_failed_password', 'ssh_accepted', 'ssh_scan', 'ssh_preauth_disconnect',
    'ssh_connection_closed') THEN ip END AS src_ip,
  CAST(CASE WHEN log_type IN ('ssh_failed_password', 'ssh_accepted', 'ssh_scan', 'ssh_preauth_disconnect',
    'ssh_connection_closed') THEN port END AS INTEGER) AS src_port FROM cls),
ev AS (SELECT *, event_id AS id FROM pl WHERE reject IS NULL)"""

# --- detection -------------------------------------------------------------------------------
_RULE_ROWS = ", ".join(
    "({id}, {proc}, {need}, {win}, {cd}, {grp})".format(
        id=q(r["id"]), proc=q(r["match"]["process"]), need=r["threshold"]["count"],
        win=r["threshold"]["window_seconds"], cd=r["cooldown_seconds"],
        grp=q(r["threshold"].get("group_by", "")))
    for r in rules())
_PATTERN_ROWS = ", ".join(
    f"({q(r['id'])}, {q('%' + p + '%')})" for r in rules() for p in r["match"]["patterns"])
MATCH = f"""{PARSED},
rl(rule_id, proc, need, win, cd, grp) AS (VALUES {_RULE_ROWS}),
pat(rule_id, p) AS (VALUES {_PATTERN_ROWS}),
mt AS (SELECT ev.*, rl.rule_id, need, win, cd,
  coalesce(CASE grp WHEN 'src_ip' THEN src_ip WHEN 'dst_user' THEN dst_user END, 'global') AS group_key
  FROM ev JOIN rl ON ev.process = rl.proc
  WHERE EXISTS (SELECT 1 FROM pat WHERE pat.rule_id = rl.rule_id AND ev.message LIKE pat.p))"""
HITS = f"""{MATCH},
inst AS (SELECT node_id, rule_id, group_key, need, win, cd, sec AS t, count(*) AS n
  FROM mt GROUP BY ALL),
sl AS (SELECT a.node_id, a.rule_id, a.group_key, a.need, a.cd, a.t, a.n, CAST(sum(b.n) AS BIGINT) AS window_count
  FROM inst a JOIN inst b ON a.node_id = b.node_id AND a.rule_id = b.rule_id AND a.group_key = b.group_key
   AND b.t <= a.t AND b.t >= a.t - to_seconds(a.win) GROUP BY ALL),
hit AS (SELECT * FROM sl WHERE window_count >= need)"""
FIRES = f"""{HITS},
walk AS (SELECT node_id, rule_id, group_key, min(t) AS t FROM hit WHERE cd > 0 GROUP BY ALL
  UNION ALL
  SELECT w.node_id, w.rule_id, w.group_key, min(h.t) FROM walk w JOIN hit h
   ON w.node_id = h.node_id AND w.rule_id = h.rule_id AND w.group_key = h.group_key
   AND h.t >= w.t + to_seconds(h.cd) GROUP BY w.node_id, w.rule_id, w.group_key),
fire AS (SELECT h.node_id, h.rule_id, h.group_key, h.t, h.window_count FROM hit h
  WHERE h.cd = 0 OR EXISTS (SELECT 1 FROM walk w WHERE w.node_id = h.node_id AND w.rule_id = h.rule_id
   AND w.group_key = h.group_key AND w.t = h.t))"""

_BY_ID = {r["id"]: r for r in rules()}
SIGNALS = f"""{FIRES},
sig0 AS (SELECT *, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS event_time FROM fire),
sig AS (SELECT 'sig-' || {h16('node_id', 'rule_id', 'group_key', 'event_time')} AS signal_id, node_id,
  rule_id AS detection_rule_id, rule_id,
  {case_of('rule_id', {k: fixed.SEVERITY_LEVEL[r['severity']] for k, r in _BY_ID.items()})} AS rule_level,
  {case_of('rule_id', {k: r['name'] for k, r in _BY_ID.items()})} || ': ' || window_count || ' matches from ' || group_key AS rule_desc,
  {case_of('rule_id', {k: r['severity'] for k, r in _BY_ID.items()})} AS severity,
  {case_of('rule_id', {k: r['category'] for k, r in _BY_ID.items()})} AS category,
  CASE WHEN rule_id IN ('LOCAL_SSH_BRUTE_FORCE', 'LOCAL_SSH_SCAN') AND group_key <> 'global' THEN group_key
   ELSE '0.0.0.0' END AS src_ip,
  event_time, 'auth_log' AS suggested_logs,
  node_id || '/auth_log#' || group_key || '#' || event_time AS raw_ref, window_count AS matched_count, t
  FROM sig0)"""
REQUESTS = f"""{SIGNALS},
req AS (SELECT 'qry-' || {h16('signal_id')} AS query_id, 'case-1' AS case_id, node_id, signal_id,
  'auth_log' AS source, CASE WHEN src_ip <> '0.0.0.0' THEN src_ip END AS f_ip,
  CASE WHEN rule_id LIKE '%SSH%' THEN 'sshd' WHEN rule_id LIKE '%SUDO%' THEN 'sudo' ELSE 'su' END AS f_proc,
  20 AS lim FROM sig)"""
RETRIEVED = f"""{REQUESTS},
got AS (SELECT r.query_id, r.signal_id, e.*, row_number() OVER (PARTITION BY r.query_id ORDER BY e.sec DESC, e.id DESC) AS rank
  FROM req r JOIN ev e ON r.node_id = e.node_id AND r.f_proc = e.process
   AND (r.f_ip IS NULL OR r.f_ip = e.src_ip) QUALIFY rank <= 20)"""
_HASH = h16("strftime(sec, '%Y-%m-%d %H:%M:%S')", "hostname", "process", "pid", "src_ip", "src_port",
            "dst_user", "log_type", "message", "raw_line")
EVIDENCE = f"""{RETRIEVED},
evd0 AS (SELECT *, strftime(sec, '%Y-%m-%dT%H:%M:%S') AS tx, {_HASH} AS hash FROM got),
evd AS (SELECT 'ev-' || {h16('query_id', 'node_id', 'id')} AS evidence_id, query_id, node_id, rank,
  'auth_log' AS source, node_id || '/auth_log#' || coalesce(src_ip, '') || '#' || tx AS raw_ref,
  query_id || ':' || hash AS lineage_id, hash, tx AS timestamp, hostname, process, pid,
  coalesce(src_ip, '') AS src_ip, src_port, dst_user, log_type, message, raw_line, signal_id FROM evd0)"""

SECOND = "'%Y-%m-%d %H:%M:%S'"


def add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {ctes.strip()}\n{select}" if ctes else select


RAW_VALUE = "CASE WHEN d = 19 THEN '  ' || raw_line || ' ' ELSE raw_line END"
add("auth_lines", LINES, f"SELECT node_id, {RAW_VALUE} AS value FROM ln")
add("auth_line_numbers", LINES, "SELECT node_id, CAST(count(*) AS BIGINT) AS lines, true AS dense FROM ln GROUP BY 1")
add("stream_ingest", LINES, f"SELECT node_id, {RAW_VALUE} AS value FROM ln")
add("stream_ingest_latest", LINES, f"SELECT node_id, {RAW_VALUE} AS value FROM ln WHERE event_id % 2 = 1")
add("federated_scan", LINES, f"SELECT node_id, {RAW_VALUE} AS value FROM ln")

ALERTS = f"""{LINES},
al AS (SELECT node_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp,
  {texts.ALERT_RULE} AS rule_id, CAST({texts.ALERT_LEVEL} AS INTEGER) AS rule_level, {texts.ALERT_TEXT} AS rule_text,
  host AS agent_name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ip END AS agent_ip,
  'al-' || event_id AS id, event_id, raw_line AS full_log FROM ln)"""
add("alerts_scan", ALERTS, """SELECT id, timestamp, rule_id, rule_level, agent_name, agent_ip, full_log
 FROM al WHERE event_id % 53 <> 0""")
add("alerts_unreadable", ALERTS, """SELECT CAST(60 AS BIGINT) AS line_length, count(*) AS lines
 FROM al WHERE event_id % 53 = 0 HAVING count(*) > 0""")

# --- registry --------------------------------------------------------------------------------
REG = """
sup AS (SELECT s_suppkey AS sk, s_suppkey % 37 AS node_no FROM supplier),
reg AS (
 SELECT sk AS entry_no, 'node-' || node_no AS node_id, 0 AS source_no, 'auth_log' AS source_name,
  '/logs/' || sk || '/auth.log' AS local_path, 'syslog' AS format, 7 AS retention_days FROM sup WHERE sk % 5 = 0
 UNION ALL SELECT sk, 'node-' || node_no, 1, 'wazuh_alerts', '/logs/' || sk || '/alerts.json', 'json', 30 FROM sup WHERE sk % 5 = 0
 UNION ALL SELECT sk, 'node-' || node_no, 0, 'auth_log', '/logs/' || sk || '/auth.log', 'syslog', 14 FROM sup WHERE sk % 5 = 1
 UNION ALL SELECT sk, 'node-' || node_no, 0, 'wazuh_alerts', '', 'json', NULL FROM sup WHERE sk % 5 = 2
 UNION ALL SELECT sk, 'node-' || node_no, 0, 'nginx_access', '/logs/' || sk || '/access.json', 'json', NULL FROM sup WHERE sk % 5 = 3)"""
add("registry_flat", REG, """SELECT entry_no, node_id, CAST(source_no AS BIGINT) AS source_no, source_name,
 local_path, format, retention_days FROM reg""")
add("registry_lookup", f"""{REG},
fst AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY node_id, source_name ORDER BY entry_no, source_no) = 1),
ask AS (SELECT 'qry-' || o_orderkey AS query_id, 'node-' || o_orderkey % 40 AS node_id,
 CASE o_orderkey % 3 WHEN 0 THEN 'auth_log' WHEN 1 THEN 'wazuh_alerts' ELSE 'nginx_access' END AS source FROM orders)""",
    """SELECT query_id, local_path, format, CASE WHEN fst.node_id IS NULL THEN 'source not found'
 WHEN local_path = '' THEN 'source has no path' END AS error
 FROM ask LEFT JOIN fst ON ask.node_id = fst.node_id AND ask.source = fst.source_name""")
ORACLES["registry_file_lookup"] = ORACLES["registry_lookup"]
add("registry_checks", f"""{REG},
cl AS (SELECT 'client-' || (c_custkey // 2 * 2 % 1000) AS client_id, 'node-' || c_custkey % 997 AS node_id FROM customer)""",
    """SELECT 'node_without_auth_log' AS problem, client_id AS subject FROM cl
  WHERE node_id NOT IN (SELECT node_id FROM reg WHERE source_name = 'auth_log')
 UNION ALL SELECT 'client_id_repeated', client_id FROM cl GROUP BY client_id HAVING count(*) > 1
 UNION ALL SELECT 'node_has_several_clients', node_id FROM cl GROUP BY node_id HAVING count(*) > 1""")
add("node_targeting", f"""{REG},
nodes AS (SELECT DISTINCT node_id FROM reg),
ask AS (SELECT 'qry-' || o_orderkey AS query_id,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'node-' || o_orderkey % 40 END AS node_id FROM orders)""",
    """SELECT query_id, n.node_id FROM ask a JOIN nodes n ON a.node_id IS NULL OR a.node_id = n.node_id""")
add("rule_catalog", "", """WITH p AS (SELECT p_partkey AS pk, p_size AS psize FROM part)
SELECT 'R' || pk AS rule_id, 'rule ' || pk AS name,
 CASE WHEN pk % 4 = 0 THEN 'medium' ELSE 'high' END AS severity,
 CASE WHEN pk % 5 = 0 THEN 'unknown' ELSE 'scan' END AS category, 'sshd' AS process,
 'size ' || psize AS patterns,
 CAST(CASE WHEN pk % 3 = 0 THEN 1 ELSE psize END AS INTEGER) AS count,
 CASE WHEN pk % 3 = 0 THEN 300 ELSE 60 END AS window_seconds,
 CASE WHEN pk % 3 = 0 THEN NULL ELSE 'src_ip' END AS group_by,
 CASE WHEN pk % 2 = 0 THEN 600 ELSE 0 END AS cooldown_seconds,
 CASE WHEN pk % 2 = 0 THEN 'auth_log' ELSE 'a; b' END AS suggested_logs
FROM p WHERE pk % 7 <> 0 AND pk % 11 <> 0""")

# --- case evidence ---------------------------------------------------------------------------
CASES = f"""
cr AS (SELECT event_id, user_id, ts, user_id * 1000 + dayofyear(ts) // (1 + user_id % 7) AS cno,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain,
  strftime(ts, '%Y/%m/%d %H:%M:%S') AS slashed FROM events),
ce AS (SELECT event_id, cno, 'case-' || cno AS case_key,
  CASE WHEN user_id % 3 = 0 THEN 1000000000 - event_id ELSE event_id END AS ord,
  {texts.CASE_TIME} AS timestamp, {texts.CASE_SEVERITY} AS severity, {texts.CASE_RULE} AS rule_id,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE '告警 ' || event_id END AS description,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE '10.0.0.' || user_id % 256 END AS src_ip,
  CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'host-' || user_id % 3 END AS hostname,
  CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'ev-dup-' || cno ELSE 'ev-' || event_id END AS evidence_id,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 'auth_log' END AS source,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'raw ' || event_id END AS raw_log,
  CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN 'nowhere' ELSE 'node/auth_log#' || event_id END AS raw_ref,
  CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 67 = 0 THEN 'plain' ELSE 'qry-' || cno || ':' || event_id END AS lineage_id,
  CASE WHEN event_id % 71 = 0 THEN 'qry-other' ELSE 'qry-' || cno END AS query_id,
  CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL
   ELSE epoch_us(date_trunc('second', ts)) + CASE WHEN event_id % 6 = 4 THEN 250000 ELSE 0 END END AS us FROM cr),
allc AS (SELECT DISTINCT case_key FROM ce UNION ALL SELECT 'case-empty-' || c_custkey FROM customer)"""
add("evidence_scan", CASES, f"""SELECT timestamp, severity, rule_id, description, src_ip, hostname, evidence_id,
 source, raw_log, raw_ref, lineage_id, query_id FROM ce""")
SINK = f"""{CASES},
sk AS (SELECT ord, source,
 CASE WHEN ord % 5 = 0 THEN 1704067200000000 + ord * 1000
  WHEN timestamp IS NULL OR timestamp = 'not-a-time' OR event_id % 6 IN (2, 3) THEN NULL ELSE us END AS event_us,
 ord % 5 <> 0 AND timestamp IS NOT NULL AND (timestamp = 'not-a-time' OR event_id % 6 IN (2, 3)) AS bad_t,
 CASE WHEN ord % 83 = 0 THEN NULL ELSE severity END AS severity_value, ord % 83 = 0 AS bad_s,
 CASE WHEN ord % 79 = 0 THEN '10.0.0.999' WHEN ord % 77 = 0 THEN 'fe80::1' ELSE src_ip END AS src_ip FROM ce),
cf AS (SELECT *, CASE WHEN bad_t THEN 'timestamp' WHEN bad_s THEN 'severity' WHEN src_ip = '10.0.0.999' THEN 'src_ip' END AS problem FROM sk)"""
add("evidence_conform", SINK, "SELECT ord, event_us, severity_value, src_ip, problem FROM cf")
add("bulk_split_counts", SINK, """SELECT source, count(*) FILTER (problem IS NULL) AS stored,
 count(*) FILTER (problem IS NOT NULL) AS failed FROM cf GROUP BY 1""")
add("sink_roundtrip", f"{SIGNALS}, {CASES.strip()}", """SELECT 'signals' AS name, substr(event_time, 1, 10) AS dt, count(*) AS n FROM sig GROUP BY ALL
 UNION ALL SELECT 'evidence', CAST(CAST(coalesce(make_timestamp(us), TIMESTAMP '2024-01-01') AS DATE) AS VARCHAR), count(*) FROM ce GROUP BY ALL""")
add("latest_run", "", """SELECT strftime(ts, '%Y%m%d_%H') AS run_id, event_id FROM events
 WHERE strftime(ts, '%Y%m%d_%H') = (SELECT max(strftime(ts, '%Y%m%d_%H')) FROM events)""")
add("committed_runs", REQUESTS, """SELECT * FROM (SELECT 'run-1' AS run_id, 'signals' AS name, count(*) AS counted, count(*) AS n FROM sig
 UNION ALL SELECT 'run-2', 'signals', count(*), count(*) FROM sig WHERE rule_level >= 5
 UNION ALL SELECT r, 'evidence', count(*), count(*) FROM req, (VALUES ('run-1'), ('run-2')) AS v(r) GROUP BY r)""")
add("latest_table", SIGNALS, "SELECT 'run-2' AS run_id, signal_id, rule_level FROM sig WHERE rule_level >= 5")
add("load_counts", f"{PARSED}, {SINK.strip()}", """SELECT 'read' AS name, count(*) AS n FROM cf
 UNION ALL SELECT 'stored', count(*) FILTER (problem IS NULL) FROM cf UNION ALL SELECT 'failed', count(*) FILTER (problem IS NOT NULL) FROM cf
 UNION ALL SELECT 'read back true', count(*) FROM cf WHERE problem IS NULL UNION ALL SELECT 'read back false', count(*) FROM cf WHERE problem IS NOT NULL
 UNION ALL SELECT 'lines_parsed', count(*) FROM pl UNION ALL SELECT 'lines_inserted', count(*) FROM ev
 UNION ALL SELECT 'errors', count(*) FROM pl WHERE reject IN ('timestamp', 'integer')""")
add("evidence_search_files", f"""{CASES}, nd(needle) AS (VALUES ('告警 12'), ('告警 77'), ('告警 5'), ('警'))""",
    """SELECT needle, case_key, ord, evidence_id, description FROM ce JOIN nd ON contains(description, needle) WHERE rule_id = '5503'
 QUALIFY row_number() OVER (PARTITION BY needle ORDER BY ord) <= 10""")
add("evidence_search", CASES, """SELECT case_key, ord, evidence_id, description FROM ce
 WHERE rule_id = '5503' AND description LIKE '%告警 1%' ORDER BY ord LIMIT 10""")

# --- parsing ---------------------------------------------------------------------------------
add("parse_header", PARSED, """SELECT node_id, event_id AS line_no,
 CASE WHEN d = 7 THEN 'Mai' WHEN d = 11 THEN 'Feb' ELSE strftime(sec, '%b') END AS month,
 CASE WHEN d = 7 THEN '12' WHEN d = 11 THEN '30' WHEN d = 23 THEN strftime(sec, '%d') ELSE CAST(day(sec) AS VARCHAR) END AS day,
 hostname, process, CASE WHEN d = 13 THEN '99999999999' ELSE CAST(pid AS VARCHAR) END AS pid_text, message
 FROM pl WHERE d <> 5""")
add("syslog_timestamp", PARSED, f"""SELECT event_id AS line_no, CASE WHEN d IN (5, 7, 11) THEN NULL
 ELSE strftime(sec, {SECOND}) END AS ts FROM pl""")
for _p in ("sshd", "sudo", "su"):
    add(f"classify_{_p}", PARSED, f"""SELECT event_id AS line_no, log_type, dst_user, src_ip, src_port
 FROM pl WHERE process = '{_p}'""")
add("classify_other", PARSED, """SELECT event_id AS line_no, process, log_type, dst_user FROM pl
 WHERE process = 'login'""")
add("classify_events", PARSED, f"""SELECT node_id, id, strftime(sec, {SECOND}) AS ts, hostname, process, pid, message,
 src_ip, src_port, dst_user, log_type, raw_line FROM ev""")
add("parse_rejects", PARSED, "SELECT node_id, event_id AS line_no, reject AS reject_reason FROM pl WHERE reject IS NOT NULL")
add("ingest_stats", PARSED, f"""SELECT node_id, count(*) AS lines_parsed, count(*) FILTER (reject IS NULL) AS lines_inserted,
 count(*) FILTER (reject IN ('timestamp', 'integer')) AS errors,
 count(*) FILTER (reject IS NULL AND sec >= {NOW} - to_days(5)) AS events_held FROM pl GROUP BY 1""")
add("event_ids", PARSED, """SELECT node_id, file, event_id AS line_no,
 row_number() OVER (PARTITION BY node_id ORDER BY file, event_id) AS id FROM ev""")
add("normalize_ts", "", f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN {NOW_TEXT} WHEN 1 THEN {NOW_TEXT}
 WHEN 2 THEN iso || 'Z' WHEN 3 THEN iso || '+0800' WHEN 4 THEN iso || '-0330' WHEN 5 THEN iso || '+0000'
 ELSE strftime(ts, {SECOND}) || '+0000' END AS stamp
 FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events)""")
add("parse_any_ts", CASES, "SELECT ord, us FROM ce")
add("extract_fields", "", """SELECT event_id,
 CASE WHEN event_id % 3 = 1 THEN 0 WHEN event_id % 3 = 2 THEN CAST(event_id % 15 AS INTEGER)
  ELSE CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(event_id % 9 AS INTEGER) END END AS severity,
 CASE WHEN event_id % 5 <> 0 THEN '10.1.1.1' WHEN event_id % 2 <> 0 THEN '10.2.2.2' ELSE '10.3.3.3' END AS src_ip,
 CASE WHEN event_id % 3 = 0 THEN 'h' WHEN event_id % 4 = 0 THEN 'a' END AS hostname FROM events""")
add("json_roundtrip", PARSED, f"SELECT id, strftime(sec, {SECOND}) AS ts, process, src_ip, src_port FROM ev")
BUS = """
bus AS (SELECT event_id AS seq, ts AS published_at, user_id, event_type,
 CASE user_id % 3 WHEN 0 THEN 'SIGNALS' WHEN 1 THEN 'QUERY_REQUESTS' ELSE 'QUERY_RESULTS' END AS stream,
 CAST(1 + event_id % 4 AS INTEGER) AS attempts, event_id % 10 IN (3, 7) AS broken,
 CASE WHEN event_id % 10 = 3 THEN '{"signal_id": "sig-' || event_id || '", "matched_count": '
  WHEN event_id % 10 = 7 THEN 'oops ' || event_id
  ELSE '{"signal_id": "sig-' || event_id || '", "rule_id": "' || event_type || '", "matched_count": ' || user_id || ', "extra": true}' END AS payload
 FROM events)"""
add("decode_messages", BUS, """SELECT seq, stream, 'sig-' || seq AS signal_id, event_type AS rule_id,
 user_id AS matched_count FROM bus WHERE NOT broken""")
REPLIES = f"""{CASES},
rp AS (SELECT DISTINCT cno, 'case-' || cno AS case_key FROM ce),
vd AS (SELECT case_key, cno, cno % 5 <> 3 AS readable,
 CASE WHEN cno % 5 <> 3 AND cno % 3 <> 0 THEN 'critical' END AS priority,
 CASE WHEN cno % 5 <> 3 THEN CASE WHEN cno % 2 = 0 THEN 'scanning' ELSE 'malware_detected' END END AS event_type,
 CASE WHEN cno % 5 <> 3 THEN '用户 ' || cno || CASE WHEN cno % 6 = 0 THEN ' 已被攻陷' ELSE ' 需要关注' END END AS summary,
 CASE WHEN cno % 5 <> 3 THEN '核查 ' || cno || '; 封禁' END AS actions FROM rp WHERE cno % 5 <> 4)"""
add("verdict_json", REPLIES, "SELECT case_key, readable, priority, event_type, summary, actions FROM vd")

# --- filters ---------------------------------------------------------------------------------
add("query_events", PARSED, f"""SELECT id, strftime(sec, {SECOND}) AS ts, src_ip, log_type FROM ev
 WHERE process = 'sshd' AND log_type = 'ssh_accepted' AND sec >= TIMESTAMP '2024-01-05' ORDER BY sec DESC, id DESC LIMIT 50""")
add("query_alerts", ALERTS, """SELECT timestamp, rule_id, agent_name, agent_ip, full_log FROM al
 WHERE timestamp >= '2024-01-03T00:00:00' AND timestamp <= '2024-01-20T00:00:00' AND rule_id = '5710'
 ORDER BY timestamp, id LIMIT 20""")
add("fresh_signals", f"""{SIGNALS},
odd AS (SELECT signal_id, t, CASE WHEN matched_count % 5 = 0 THEN 'not-a-time' WHEN matched_count % 7 = 0 THEN NULL ELSE event_time END AS event_time FROM sig)""",
    f"""SELECT signal_id, event_time FROM odd WHERE event_time IS NULL OR event_time = 'not-a-time'
 OR {NOW} - t <= INTERVAL 5 MINUTE""")
add("retention_filter", PARSED, f"SELECT id, strftime(sec, {SECOND}) AS ts FROM ev WHERE sec >= {NOW} - to_days(7)")
add("registry_retention", f"{PARSED}, {REG.strip()}", """SELECT node_id, id FROM ev LEFT JOIN
 (SELECT node_id AS n, max(retention_days) AS days FROM reg WHERE source_name = 'auth_log' GROUP BY 1) r ON ev.node_id = r.n
 WHERE days IS NULL OR sec >= TIMESTAMP '2024-01-31' - to_days(days)""")
add("query_requests", REQUESTS, """SELECT query_id, case_id, node_id, signal_id, source, f_ip AS src_ip, f_proc AS process,
 CAST(NULL AS VARCHAR) AS rule_id, lim AS "limit" FROM req""")
add("severity_level", "", """SELECT o_orderkey, lower(split_part(o_orderpriority, '-', 2)) AS word,
 CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'critical' THEN 11 WHEN 'high' THEN 8 WHEN 'medium' THEN 5
 WHEN 'low' THEN 2 ELSE 5 END AS level FROM orders""")
add("signals_build", SIGNALS, "SELECT * EXCLUDE (t) FROM sig")

# --- joins -----------------------------------------------------------------------------------
add("rule_matches", MATCH, "SELECT node_id, id, rule_id, group_key FROM mt")
add("rule_matches_large_catalog", MATCH, "SELECT node_id, id, rule_id, group_key FROM mt")
add("retrieve_evidence", RETRIEVED, "SELECT query_id, node_id, CAST(rank AS INTEGER) AS rank, id FROM got")
add("rule_group_columns", MATCH, """SELECT node_id, rule_id, coalesce(CASE rule_id WHEN 'LOCAL_SSH_BRUTE_FORCE' THEN hostname
 WHEN 'LOCAL_SSH_SCAN' THEN log_type WHEN 'LOCAL_SU_FAILURES' THEN CAST(pid AS VARCHAR) WHEN 'LOCAL_SSH_ACCEPTED' THEN hostname END,
 'global') AS group_key, count(*) AS matched_count FROM mt GROUP BY ALL""")
add("retrieve_everything", f"""{PARSED},
ask AS (SELECT 'qry-' || s_suppkey AS query_id, 'node-' || s_suppkey % 3 AS node_id,
 CASE WHEN s_suppkey % 4 > 0 THEN '10.0.' || s_suppkey // 256 || '.' || s_suppkey % 256 END AS f_ip,
 CASE WHEN s_suppkey % 2 = 0 THEN 'sshd' END AS f_proc,
 CASE WHEN s_suppkey % 4 = 0 THEN 'ssh_scan' END AS f_type FROM supplier)""",
    """SELECT query_id, id
 FROM ask JOIN ev ON ask.node_id = ev.node_id AND (f_ip IS NULL OR f_ip = src_ip) AND (f_proc IS NULL OR f_proc = process)
 AND (f_type IS NULL OR f_type = log_type) WHERE sec >= TIMESTAMP '2024-01-10'""")
add("retrieve_mixed", f"""{PARSED},
ask AS (SELECT 'qry-' || s_suppkey AS query_id, 'node-' || s_suppkey % 3 AS node_id,
 CASE WHEN s_suppkey % 3 = 1 THEN '10.0.0.' || s_suppkey % 256 END AS f_ip, CASE WHEN s_suppkey % 2 = 0 THEN 'su' END AS f_proc,
 CASE WHEN s_suppkey % 5 < 4 THEN 'user' || s_suppkey % 100 END AS f_user,
 CASE s_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 3 WHEN 2 THEN 500 END AS most FROM supplier)""",
    """SELECT query_id, id, CASE WHEN most IS NOT NULL THEN
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY sec DESC, id DESC) AS INTEGER) END AS rank
 FROM ask JOIN ev ON ask.node_id = ev.node_id AND (f_ip IS NULL OR f_ip = src_ip) AND (f_proc IS NULL OR f_proc = process)
 AND (f_user IS NULL OR f_user = dst_user)
 QUALIFY most IS NULL OR row_number() OVER (PARTITION BY query_id ORDER BY sec DESC, id DESC) <= most""")
REFS = f"""{CASES},
rf AS (SELECT 'case-' || cno AS case_key, event_id AS ord, CASE WHEN event_id % 73 = 0 THEN 'ev-ghost-' || event_id
 WHEN event_id % 11 = 0 OR event_id % 47 = 0 THEN '' ELSE 'ev-' || event_id END AS evidence_id FROM cr),
dang AS (SELECT * FROM rf WHERE evidence_id <> '' AND NOT EXISTS
 (SELECT 1 FROM ce WHERE ce.case_key = rf.case_key AND ce.evidence_id = rf.evidence_id))"""
add("dangling_refs", REFS, "SELECT case_key, evidence_id FROM dang")
add("verify_ref_parts", f"""{REFS},
dn AS (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY ord, evidence_id) AS position FROM dang)""",
    """SELECT case_key, (position - 1) // 3 + 1 AS part, count(*) AS n,
 '''' || string_agg(evidence_id, ''', ''' ORDER BY position) || '''' AS listed FROM dn GROUP BY ALL""")
_CHAIN = """SELECT s.signal_id, s.raw_ref AS signal_ref, r.query_id, e.evidence_id, e.lineage_id, e.raw_ref
 FROM sig s LEFT JOIN req r USING (signal_id) LEFT JOIN evd e ON e.query_id = r.query_id"""
add("lineage_chain", EVIDENCE, _CHAIN)
add("lineage_live", EVIDENCE, _CHAIN)
_KIND = case_of("rule_id", fixed.TRIAGE_EVENT_TYPE, "'unknown'")
_ADVICE = {k: "; ".join(v) for k, v in fixed.ACTIONS.items()}
add("lookup_enrich", CASES, f"""SELECT ord, {_KIND} AS event_type, {case_of('rule_id', fixed.TRIAGE_PRIORITY)} AS priority,
 {case_of('rule_id', fixed.LOG_TYPE_SEVERITY, '3')} AS log_severity, {case_of(_KIND, _ADVICE)} AS actions FROM ce""")

# --- detection -------------------------------------------------------------------------------
SNAP = f"""{MATCH},
sn AS (SELECT node_id, rule_id, group_key, count(*) AS matched_count FROM mt WHERE sec >= {NOW} - to_seconds(win)
 GROUP BY node_id, rule_id, group_key, need HAVING count(*) >= need)"""
add("threshold_snapshot", SNAP, "SELECT * FROM sn WHERE group_key <> 'global'")
add("threshold_global", SNAP, "SELECT * FROM sn WHERE group_key = 'global'")
add("threshold_sliding", HITS, f"SELECT node_id, rule_id, group_key, n, window_count, strftime(t, {SECOND}) AS t FROM hit")
add("cooldown_fires", FIRES, f"SELECT node_id, rule_id, group_key, strftime(t, {SECOND}) AS t, window_count FROM fire")
add("stream_detect", FIRES, f"SELECT node_id, rule_id, group_key, strftime(t, {SECOND}) AS t, window_count FROM fire")
# a reload parts every rule's history in two
RELOADED = FIRES.replace("SELECT ev.*, rl.rule_id, need",
                         "SELECT ev.*, rl.rule_id || CASE WHEN sec < TIMESTAMP '2024-01-16' THEN '@0' ELSE '@1' END AS rule_id, need")
add("rule_reload", RELOADED, f"""SELECT node_id, split_part(rule_id, '@', 1) AS rule_id, group_key,
 strftime(t, {SECOND}) AS t, window_count FROM fire""")
add("rule_reload_live", RELOADED, f"""SELECT node_id, split_part(rule_id, '@', 1) AS rule_id, group_key,
 strftime(t, {SECOND}) AS t, window_count FROM fire""")
CATALOG = f"""{PARSED},
cm AS (SELECT ev.*, 'P' || p_partkey AS rule_id, CAST(1 + p_partkey % 4 AS INTEGER) AS need,
  CAST(7200 * (1 + p_partkey % 300) AS INTEGER) AS win,
  CASE WHEN p_partkey % 2 = 0 THEN coalesce(src_ip, 'global') ELSE 'global' END AS group_key
 FROM ev JOIN part ON ev.process = CASE p_partkey % 3 WHEN 0 THEN 'sudo' ELSE 'sshd' END
  AND (ev.message LIKE '%user' || p_partkey % 89 || ' from%' OR ev.message LIKE '%user=user' || p_partkey || '%'
   OR ev.message LIKE '%port ' || p_partkey || '%ssh2%'))"""
add("catalog_matches", CATALOG, "SELECT node_id, id, rule_id, group_key, need, win AS window_seconds FROM cm")
add("catalog_windows", f"""{CATALOG},
ci AS (SELECT node_id, rule_id, group_key, need, win, sec AS t, count(*) AS n FROM cm GROUP BY ALL),
cs AS (SELECT a.node_id, a.rule_id, a.group_key, a.need, a.t, CAST(sum(b.n) AS BIGINT) AS window_count
  FROM ci a JOIN ci b ON a.node_id = b.node_id AND a.rule_id = b.rule_id AND a.group_key = b.group_key
   AND b.t <= a.t AND b.t >= a.t - to_seconds(a.win) GROUP BY ALL)""",
    f"SELECT node_id, rule_id, group_key, strftime(t, {SECOND}) AS t, window_count FROM cs WHERE window_count >= need")
add("state_cleanup", FIRES, "SELECT rule_id, count(*) AS fires, CAST(0 AS BIGINT) AS state_rows FROM fire GROUP BY rule_id")
add("detect_stats", FIRES, """SELECT h.rule_id, f.n AS signals_fired, h.n - f.n AS signals_suppressed
 FROM (SELECT rule_id, count(*) AS n FROM hit GROUP BY 1) h JOIN (SELECT rule_id, count(*) AS n FROM fire GROUP BY 1) f USING (rule_id)""")
add("signal_group_stats", MATCH, f"""SELECT node_id, rule_id, group_key, count(*) AS matched_count,
 strftime(min(sec), {SECOND}) AS first_time, strftime(max(sec), {SECOND}) AS last_time FROM mt GROUP BY ALL""")
add("stream_threshold", MATCH, f"""SELECT node_id, rule_id, group_key,
 strftime(make_timestamp(epoch_us(sec) // 259200000000 * 259200000000), {SECOND}) AS window_start, count(*) AS matched_count
 FROM mt GROUP BY node_id, rule_id, group_key, need, window_start HAVING count(*) >= need""")

# --- evidence --------------------------------------------------------------------------------
_EVD = """evidence_id, query_id, node_id, source, raw_ref, lineage_id, hash, timestamp, hostname, process, pid,
 src_ip, src_port, dst_user, log_type, message, raw_line"""
add("evidence_auth", EVIDENCE, f"SELECT {_EVD} FROM evd")
_AHASH = h16("timestamp", "rule_id", "rule_level", "rule_text", "agent_name", "agent_ip", "full_log")
ALEV = f"""{ALERTS},
ag AS (SELECT *, 'qry-' || node_id || '-' || rule_id AS query_id, {_AHASH} AS hash FROM al),
gw AS (SELECT 'ev-' || {h16('query_id', 'node_id', 'id')} AS evidence_id, query_id, node_id || '/wazuh_alerts#' || timestamp AS raw_ref,
 query_id || ':' || hash AS lineage_id, hash, timestamp, 'wazuh_alerts' AS source, rule_id, rule_text AS description,
 coalesce(agent_ip, '0.0.0.0') AS src_ip, agent_name AS hostname, rule_level AS severity, full_log AS raw_log FROM ag)"""
add("evidence_alerts", f"""{ALEV},
top AS (SELECT * FROM ag QUALIFY row_number() OVER (PARTITION BY node_id, rule_id ORDER BY timestamp, id) <= 20)""",
    f"""SELECT 'ev-' || {h16('query_id', 'node_id', 'id')} AS evidence_id, query_id, node_id, node_id || '/wazuh-alerts#' || timestamp AS raw_ref,
 query_id || ':' || hash AS lineage_id, hash, timestamp, rule_id, agent_name, coalesce(agent_ip, '') AS src_ip,
 count(*) OVER (PARTITION BY query_id) AS rows_returned FROM top""")
add("evidence_gateway", ALEV, "SELECT * FROM gw")
add("tamper_check", EVIDENCE, "SELECT evidence_id, query_id FROM evd WHERE pid % 6 = 0")
SUMMARY = f"""{EVIDENCE},
qs AS (SELECT r.query_id, r.node_id, r.source, r.signal_id, count(e.evidence_id) AS evidence_count
 FROM req r LEFT JOIN evd e ON e.query_id = r.query_id GROUP BY ALL)"""
add("query_summary", SUMMARY, "SELECT query_id, node_id, source, evidence_count FROM qs")
_LOGSEV = case_of("log_type", fixed.LOG_TYPE_SEVERITY, "3")
NORM = f"""
na AS (SELECT timestamp || '+0000' AS timestamp, {_LOGSEV} AS severity, log_type AS rule_id, message AS description,
 CASE WHEN src_ip = '' THEN '0.0.0.0' ELSE src_ip END AS src_ip, hostname, evidence_id, 'auth_log' AS source, raw_line AS raw_log,
 raw_ref, lineage_id, query_id, signal_id FROM evd)"""
NALERT = """
nw AS (SELECT regexp_replace(timestamp, ':(..)$', '\\1') AS timestamp, severity, rule_id, description, src_ip, hostname, evidence_id,
 'wazuh-alerts' AS source, raw_log, raw_ref, lineage_id, query_id FROM gw)"""
add("normalize_auth", f"{EVIDENCE},{NORM}", "SELECT * EXCLUDE (signal_id) FROM na")
add("normalize_by_signal", f"{EVIDENCE},{NORM}", """SELECT evidence_id, s.rule_id, na.severity FROM na JOIN sig s USING (signal_id)""")
add("normalize_alerts", f"{ALEV},{NALERT}", "SELECT * FROM nw")
add("normalized_union", f"{EVIDENCE},{NORM},{ALEV[len(LINES) + 1:]},{NALERT}", """SELECT source, rule_id, severity, src_ip, count(*) AS n FROM
 (SELECT source, rule_id, severity, src_ip FROM na UNION ALL SELECT source, rule_id, severity, src_ip FROM nw) GROUP BY ALL""")

# --- readiness -------------------------------------------------------------------------------
_REQ = " + ".join(f"CASE WHEN coalesce({f}, '') = '' THEN 1 ELSE 0 END" for f in fixed.REQUIRED_FIELDS)
_GOOD = " + ".join(f"CASE WHEN coalesce(CAST({f} AS VARCHAR), '') NOT IN ('', 'unknown') THEN 1 ELSE 0 END"
                   for f in fixed.REQUIRED_FIELDS + fixed.RECOMMENDED_FIELDS)
READY = f"""{CASES},
fc AS (SELECT case_key, count(*) AS n, CAST(sum({_REQ}) AS BIGINT) AS missing, CAST(sum({_GOOD}) AS BIGINT) AS good,
 count(*) FILTER (coalesce(evidence_id, '') <> '') AS valid_count FROM ce GROUP BY 1),
od AS (SELECT case_key, us, lag(us) OVER (PARTITION BY case_key ORDER BY ord) AS prev FROM ce WHERE us IS NOT NULL),
tm AS (SELECT case_key, CAST(count(*) AS BIGINT) AS n_ts, coalesce(bool_or(us < prev), false) AS unordered,
 (max(us) - min(us)) / 1e6 AS span FROM od GROUP BY 1),
du AS (SELECT case_key, count(evidence_id) <> count(DISTINCT evidence_id) AS duplicated FROM ce
 WHERE evidence_id IS NOT NULL GROUP BY 1),
ms AS (SELECT case_key, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing, coalesce(good, 0) AS good,
 coalesce(valid_count, 0) AS valid_count, coalesce(n_ts, 0) AS n_ts, coalesce(unordered, false) AS unordered, span,
 coalesce(duplicated, false) AS duplicated
 FROM allc LEFT JOIN fc USING (case_key) LEFT JOIN tm USING (case_key) LEFT JOIN du USING (case_key)),
rc AS (SELECT *,
 CASE WHEN n = 0 THEN 50 ELSE CAST(floor((1::DOUBLE - (1::DOUBLE - missing / (n * 6)::DOUBLE)) * 40) AS INTEGER) END AS cov_lost,
 CASE WHEN n = 0 THEN '无证据数据' WHEN missing > 0 THEN '字段覆盖度不足：' || missing || '/' || n * 6 || ' 个必需字段缺失' END AS cov_issue,
 n > 0 AND good / (n * 10)::DOUBLE < 0.5 AS low,
 n_ts < 2 AS few, n_ts >= 2 AND unordered AS back, n_ts >= 2 AND span < 30 AS short FROM ms),
ri AS (SELECT *, CASE WHEN low THEN 15 ELSE 0 END AS int_lost,
 CASE WHEN low THEN '字段完整性不足：非空值比例 ' || CAST(round_even(good / (n * 10)::DOUBLE * 100, 0) AS BIGINT) || '%' END AS int_issue,
 CASE WHEN few THEN '时间戳不足 2 条（当前 ' || n_ts || ' 条），无法评估时序一致性' END AS few_issue,
 CASE WHEN back THEN '时间戳存在乱序' END AS back_issue,
 CASE WHEN short THEN '时间跨度不足 30 秒（当前 ' || CAST(round_even(span, 0) AS BIGINT) || ' 秒）' END AS short_issue,
 CASE WHEN duplicated THEN 'evidence_id 存在重复，影响溯源完整性' END AS dup_issue FROM rc),
rs AS (SELECT *, greatest(100 - cov_lost - int_lost - few::INT * 10 - back::INT * 10 - short::INT * 10 - duplicated::INT * 10, 0) AS score,
 concat_ws('; ', cov_issue, int_issue, few_issue, back_issue, short_issue, dup_issue) AS issues FROM ri),
rd AS (SELECT *, CASE WHEN score >= 80 THEN '完整可用' WHEN score >= 60 THEN '基本可用' WHEN score >= 40 THEN '数据不足' ELSE '严重不足' END AS level,
 CASE WHEN score >= 80 THEN 'analyze; report; persist' WHEN score >= 60 THEN 'analyze; report' WHEN score >= 40 THEN 'analyze' ELSE '' END AS allowed,
 CASE WHEN score >= 80 THEN '' WHEN score >= 60 THEN 'persist' WHEN score >= 40 THEN 'report; persist' ELSE 'analyze; report; persist' END AS blocked FROM rs)"""
add("readiness_coverage", READY, "SELECT case_key, n AS evidence_count, missing, cov_lost AS deduction, cov_issue AS issue FROM rc")
add("readiness_integrity", READY, "SELECT case_key, good, int_lost AS deduction, int_issue AS issue FROM ri WHERE n > 0")
add("readiness_temporal", READY, "SELECT case_key, n_ts, unordered, CAST(floor(span * 1000) AS BIGINT) AS span_ms FROM tm")
add("readiness_uniqueness", READY, "SELECT case_key, duplicated FROM du")
add("readiness_level", READY, "SELECT case_key, score, level, allowed, blocked FROM rd")
add("readiness_report", READY, """SELECT case_key, score, level, n AS evidence_count, valid_count, issues,
 CASE WHEN n > 0 AND missing > 0 THEN 'failed' ELSE 'passed' END AS field_coverage,
 CASE WHEN low THEN 'failed' ELSE 'passed' END AS field_integrity,
 CASE WHEN few OR back OR short THEN 'failed' ELSE 'passed' END AS temporal_consistency,
 CASE WHEN duplicated THEN 'failed' ELSE 'passed' END AS uniqueness FROM rd""")
add("readiness_gate", READY, "SELECT case_key, score FROM rd WHERE score >= 80")

# --- triage ----------------------------------------------------------------------------------
_PRIO = case_of("rule_id", fixed.TRIAGE_PRIORITY)
_RANK = case_of(_PRIO, fixed.PRIORITY_RANK)
_PHASE = "CASE " + " ".join(f"WHEN sev <= {top} THEN {q(p)}" for top, p in fixed.PHASE_BANDS) + (
    f" ELSE {case_of('rule_id', fixed.PHASE_BY_RULE, q(fixed.PHASE_DEFAULT))} END")
TRIAGE = f"""
rh AS (SELECT case_key, CASE WHEN rule_id = '' THEN 'unknown' ELSE rule_id END AS rule_id, count(*) AS cnt, min(ord) AS first_ord FROM ce GROUP BY ALL),
br0 AS (SELECT case_key, rule_id, row_number() OVER (PARTITION BY case_key ORDER BY {_RANK} DESC, cnt DESC, first_ord) AS rn
 FROM rh WHERE {_PRIO} IS NOT NULL),
br AS (SELECT t.case_key, t.total, b.rule_id AS best_rule FROM (SELECT case_key, CAST(sum(cnt) AS BIGINT) AS total FROM rh GROUP BY 1) t
 LEFT JOIN (SELECT * FROM br0 WHERE rn = 1) b USING (case_key)),
tr AS (SELECT case_key, coalesce(total, 0) AS total, best_rule, {case_of('best_rule', fixed.TRIAGE_EVENT_TYPE, "'unknown'")} AS event_type,
 coalesce({case_of('best_rule', fixed.TRIAGE_PRIORITY)}, CASE WHEN coalesce(total, 0) >= 5 THEN 'medium' ELSE 'low' END) AS priority,
 CASE WHEN best_rule IS NULL THEN 'low' WHEN total >= 5 THEN 'high' WHEN total >= 3 THEN 'medium' ELSE 'low' END AS confidence
 FROM allc LEFT JOIN br USING (case_key)),
ta AS (SELECT *, CASE WHEN best_rule IS NOT NULL THEN '检测到 ' || total || ' 条告警，主要类型: ' || event_type || '（规则ID: ' || best_rule || '）'
 WHEN total > 0 THEN '检测到 ' || total || ' 条未分类告警' ELSE '无证据，无法分诊' END AS summary FROM tr),
ph AS (SELECT case_key, ord, {_PHASE} AS kill_chain_phase,
 CASE WHEN description = '' THEN '规则 ' || coalesce(rule_id, '') || ' 触发的告警' ELSE description END AS description
 FROM (SELECT *, coalesce(severity, 0) AS sev FROM ce)),
kc AS (SELECT case_key, kill_chain_phase, count(*) AS evidence_count, min(ord) AS first_ord, arg_min(description, ord) AS description FROM ph GROUP BY ALL),
pg AS (SELECT case_key, '攻击链进展: ' || string_agg(kill_chain_phase, ', ' ORDER BY first_ord) AS progress FROM kc GROUP BY 1),
rn AS (SELECT case_key, count(*) AS ref_count FROM ce WHERE coalesce(evidence_id, '') <> '' GROUP BY 1),
an AS (SELECT case_key, event_type, priority, confidence, summary,
 summary || '攻击链状态: ' || coalesce(progress, '无证据，无法分析攻击链') AS conclusion,
 {case_of('event_type', _ADVICE)} AS actions, coalesce(ref_count, 0) AS ref_count
 FROM ta LEFT JOIN pg USING (case_key) LEFT JOIN rn USING (case_key))"""
add("rule_histogram", f"{CASES},{TRIAGE}", "SELECT * FROM rh")
add("triage_best_rule", f"{CASES},{TRIAGE}", "SELECT * FROM br")
add("triage_confidence", f"{CASES},{TRIAGE}", "SELECT case_key, total, event_type, priority, confidence, summary FROM ta")
add("kill_chain", f"{CASES},{TRIAGE}", "SELECT * FROM kc")
add("kill_chain_members", f"{CASES},{TRIAGE}", "SELECT case_key, ord, kill_chain_phase FROM ph")
add("kill_chain_progress", f"{CASES},{TRIAGE}", "SELECT * FROM pg")
add("actions", f"{CASES},{TRIAGE}", f"SELECT case_key, event_type, {case_of('event_type', _ADVICE)} AS actions FROM ta")
add("analysis", f"{CASES},{TRIAGE}", "SELECT * FROM an")
add("analysis_defaults", f"{CASES},{TRIAGE}", """SELECT case_key, coalesce(e.event_type, 'unknown') AS event_type,
 coalesce(e.priority, 'medium') AS priority, coalesce(e.confidence, '低') AS confidence, coalesce(e.summary, '研判异常') AS summary,
 coalesce(e.conclusion, '自动研判失败，需人工介入') AS conclusion, coalesce(e.actions, '人工核查') AS actions,
 coalesce(e.ref_count, 0) AS ref_count FROM allc LEFT JOIN (SELECT an.* FROM an JOIN (SELECT DISTINCT case_key FROM ce) USING (case_key)) e USING (case_key)""")
add("evidence_digest", f"""{CASES},
dg AS (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY ord) AS rn FROM ce)""",
    """SELECT case_key, string_agg('[' || coalesce(evidence_id, 'None') || '] time=' || coalesce(timestamp, 'None') || ' rule=' || coalesce(rule_id, 'None')
 || ' severity=' || coalesce(CAST(severity AS VARCHAR), 'None') || ' src_ip=' || coalesce(src_ip, 'None') || ' host=' || coalesce(hostname, 'None')
 || ' desc=' || coalesce(description, 'None'), chr(10) ORDER BY rn) AS digest FROM dg WHERE rn <= 20 GROUP BY 1""")
MERGED = f"""{REPLIES},{TRIAGE},
vm AS (SELECT ta.case_key,
 CASE WHEN readable THEN v.event_type ELSE ta.event_type END AS event_type,
 CASE WHEN readable THEN coalesce(v.priority, 'medium') ELSE ta.priority END AS priority,
 CASE WHEN readable THEN 'high' ELSE ta.confidence END AS confidence,
 CASE WHEN readable THEN v.summary ELSE ta.summary END AS summary,
 CASE WHEN readable THEN '攻击链分析完成' ELSE coalesce(progress, '无证据，无法分析攻击链') END AS status,
 CASE WHEN readable THEN v.actions ELSE {case_of('ta.event_type', _ADVICE)} END AS actions,
 coalesce(ref_count, 0) AS ref_count
 FROM ta LEFT JOIN vd v USING (case_key) LEFT JOIN pg USING (case_key) LEFT JOIN rn USING (case_key)),
va AS (SELECT case_key, event_type, priority, confidence, summary, summary || '攻击链状态: ' || status AS conclusion, actions, ref_count FROM vm)"""
add("verdict_merge", MERGED, "SELECT * FROM va")

# --- verification ----------------------------------------------------------------------------
_WORDS = ", ".join(
    f"CASE WHEN contains(conclusion, {q(p)}) THEN {q(f'结论包含绝对化表述: 「{p}」，风险过高，需要更多证据支撑')} END"
    for p in fixed.FORBIDDEN_PHRASES)
_CHECKS = f"""
xr AS (SELECT case_key, '研判引用了不存在的 evidence_id: [''' || string_agg(evidence_id, ''', ''' ORDER BY ord, evidence_id) || ''']' AS ref_issue
 FROM dang GROUP BY 1),
xw AS (SELECT case_key, arg_min(CASE WHEN raw_ref = '' THEN '证据 ' || coalesce(evidence_id, 'None') || ' 缺少 raw_ref'
 ELSE '证据 ' || coalesce(evidence_id, 'None') || ' 的 raw_ref 格式无效: ' || raw_ref END, ord) AS raw_issue
 FROM ce WHERE raw_ref = '' OR (NOT contains(raw_ref, '#') AND NOT contains(raw_ref, '/')) GROUP BY 1),
xq AS (SELECT case_key, '证据来自多个查询: {{''' || string_agg(DISTINCT query_id, ''', ''' ORDER BY query_id) || '''}}' AS query_issue
 FROM ce WHERE query_id <> '' GROUP BY 1 HAVING count(DISTINCT query_id) > 1),
xl AS (SELECT case_key, min(ord) AS bad_ord, arg_min(CASE WHEN lineage_id IS NULL THEN '证据 ' || coalesce(evidence_id, 'None') || ' 缺少 lineage_id'
 ELSE '证据 ' || coalesce(evidence_id, 'None') || ' 的 lineage_id 格式无效: ' || lineage_id END, ord) AS lineage_issue
 FROM ce WHERE lineage_id IS NULL OR NOT contains(lineage_id, ':') GROUP BY 1)"""
add("verify_evidence_ref", f"{REFS},{_CHECKS}", "SELECT * FROM xr")
add("verify_raw_ref", f"{REFS},{_CHECKS}", "SELECT * FROM xw")
add("verify_query_id", f"{REFS},{_CHECKS}", "SELECT * FROM xq")
add("verify_lineage_issue", f"{REFS},{_CHECKS}", "SELECT case_key, lineage_issue FROM xl")
add("verify_lineage", f"{REFS},{_CHECKS}", """SELECT case_key, coalesce(evidence_id, 'None') AS evidence_id,
 arg_max(CASE WHEN lineage_id IS NULL THEN 'missing' WHEN NOT contains(lineage_id, ':') THEN 'invalid_format' ELSE 'valid' END, ord) AS status
 FROM ce LEFT JOIN xl USING (case_key) WHERE bad_ord IS NULL OR ord <= bad_ord GROUP BY 1, 2""")
_CUT = READY[len(CASES) + 1:]
_VERDICT = f"""
vc AS (SELECT va.*, rd.n AS evidence_count, valid_count, score, level, rd.issues AS readiness_issues,
 concat_ws('; ', {_WORDS}, CASE WHEN rd.n < 3 AND length(conclusion) > 10 THEN '证据仅 ' || rd.n || ' 条，但结论过于详细，置信度存疑' END,
 CASE WHEN score < 60 AND rd.n >= 3 THEN '数据就绪度 ' || score || ' 分低于 60，结论需谨慎' END) AS con_issue
 FROM va JOIN rd USING (case_key)),
vo AS (SELECT vc.*, ref_issue, raw_issue, query_issue, lineage_issue,
 concat_ws('; ', ref_issue, raw_issue, query_issue, lineage_issue, nullif(con_issue, '')) AS issues
 FROM vc LEFT JOIN xr USING (case_key) LEFT JOIN xw USING (case_key) LEFT JOIN xq USING (case_key) LEFT JOIN xl USING (case_key)),
vf AS (SELECT *, issues = '' AS verified, CASE WHEN issues <> '' THEN '低' WHEN evidence_count >= 5 THEN '高' ELSE '中' END AS final_confidence,
 CASE WHEN issues = '' THEN conclusion ELSE {q(fixed.UNVERIFIED_CONCLUSION)} END AS final_conclusion FROM vo)"""
REVIEW = f"""{MERGED},{_CUT},{REFS[len(CASES) + 1:]},{_CHECKS},{_VERDICT}"""
add("verify_conclusion", REVIEW, "SELECT case_key, con_issue AS issues FROM vc")


def _flag(col: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN 'passed' ELSE 'failed' END"


add("verify_overall", REVIEW, f"""SELECT case_key, verified, issues, concat_ws(',', {_flag('ref_issue')}, {_flag('raw_issue')},
 {_flag('query_issue')}, {_flag('lineage_issue')}, {_flag("nullif(con_issue, '')")}) AS checks, final_confidence, final_conclusion FROM vf""")
add("case_review", REVIEW, """SELECT case_key, evidence_count, valid_count, score, level, readiness_issues, event_type, priority, confidence,
 summary, conclusion, actions, ref_count, verified, issues, final_confidence, final_conclusion FROM vf""")
_ENTRY = """'
【证据 ' || position || '】
- 时间：' || coalesce(timestamp, '未知') || '
- 规则ID：' || coalesce(rule_id, '未知') || '
- 描述：' || coalesce(description, '未知') || '
- 源IP：' || coalesce(src_ip, '未知') || '
- 主机：' || coalesce(hostname, '未知') || '
'"""
NUMBERED = "nb AS (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY ord) AS position FROM ce)"
add("case_report_sections", f"{CASES},{NUMBERED}", f"SELECT case_key, position, {_ENTRY} AS entry FROM nb")


def _report(block: int) -> str:
    """The parts of every case's report."""
    return f"""SELECT case_key, 0::BIGINT AS part, '
# 安全研判报告
报告时间：20240201_000000

## 1. 数据就绪度评估
- 就绪度评分：' || score || ' 分
- 评估等级：' || level || '
- 有效证据数：' || valid_count || '

## 2. 安全证据（标准化）
' AS text FROM vf
UNION ALL SELECT case_key, (position - 1) // {block} + 1 AS part, string_agg({_ENTRY}, '' ORDER BY position) FROM nb GROUP BY 1, 2
UNION ALL SELECT case_key, CAST(ceil(evidence_count / {block}.0) + 1 AS BIGINT), '
## 3. AI 研判结果
- 研判结论：' || conclusion || '
- 置信度：' || confidence || '

## 4. 处置建议
' || '- ' || replace(actions, '; ', chr(10) || '- ') || '

## 5. 复核结果（防AI幻觉）
- 复核状态：**' || CASE WHEN verified THEN '通过' ELSE '未通过' END || '**
- 发现问题：' || CASE WHEN issues = '' THEN '[]' ELSE '[' || array_to_string(list_transform(string_split(issues, '; '),
   lambda x: CASE WHEN contains(x, '''') THEN '"' || x || '"' ELSE '''' || x || '''' END), ', ') || ']' END || '
- 最终结论：' || final_conclusion || '
- 最终置信度：' || final_confidence || '

## 6. 总结
本报告基于数据编织架构，通过边缘按需取证、标准化映射、AI研判与复核验证，形成完整可信的安全事件分析结果。
' FROM vf"""


add("case_report", f"{REVIEW},{NUMBERED}", _report(1000))

# --- monitoring ------------------------------------------------------------------------------
MONITOR = f"""{SUMMARY},
mq AS (SELECT qs.*, sig.t FROM qs JOIN sig USING (signal_id)),
kinds(event_type, component, side) AS (VALUES ('signal.sent', 'DetectionEngine', 'client'), ('signal.received', 'SignalListener', 'server'),
 ('query.sent', 'SignalListener', 'server'), ('query.received', 'DuckDBSidecar', 'client'), ('query.executed', 'DuckDBSidecar', 'client'),
 ('result.sent', 'DuckDBSidecar', 'client'), ('result.received', 'QueryResultListener', 'server'), ('evidence.saved', 'QueryResultListener', 'server')),
mo AS (SELECT event_type, component, side, s.node_id, s.t, s.signal_id AS subject,
  '{{"signal_id":"' || s.signal_id || '","rule_id":"' || s.rule_id || '"}}' AS payload FROM kinds, sig s WHERE event_type LIKE 'signal%'
 UNION ALL SELECT event_type, component, side, node_id, t, query_id, CASE WHEN event_type IN ('query.sent', 'query.received')
   THEN '{{"query_id":"' || query_id || '","signal_id":"' || signal_id || '"}}'
  WHEN event_type IN ('query.executed', 'result.sent') THEN '{{"query_id":"' || query_id || '","evidence_count":' || evidence_count || '}}'
  ELSE '{{"query_id":"' || query_id || '","evidence_count":' || evidence_count || '}}' END FROM kinds, mq WHERE event_type NOT LIKE 'signal%'),
me AS (SELECT 'evt-' || {h16('event_type', 'subject')} AS event_id, event_type, side AS source, component,
 CASE WHEN side = 'client' THEN node_id ELSE '' END AS node_id, node_id AS subject_node, strftime(t, '%H:%M:%S') AS timestamp, payload, t FROM mo)"""
add("monitor_events", MONITOR, "SELECT * EXCLUDE (t) FROM me")
add("monitor_counts", MONITOR, """SELECT coalesce(source, '*') AS source, coalesce(event_type, '*') AS event_type, count(*) AS events
 FROM me GROUP BY ROLLUP (source, event_type)""")
add("monitor_node_counts", MONITOR, "SELECT subject_node, count(*) AS events FROM me GROUP BY 1")
add("monitor_latest", MONITOR, "SELECT event_id, event_type, timestamp FROM me ORDER BY t DESC, event_id DESC LIMIT 50")
add("monitor_funnel", MONITOR, """SELECT s.node_id, s.signals, q.queries, q.answered, q.evidence_rows, q.verdicts,
 q.queries - q.answered AS unanswered, q.answered - q.verdicts AS unverified
 FROM (SELECT node_id, count(*) AS signals FROM sig GROUP BY 1) s JOIN (SELECT node_id, count(*) AS queries,
 count(*) FILTER (evidence_count > 0) AS answered, CAST(sum(evidence_count) AS BIGINT) AS evidence_rows,
 count(*) FILTER (evidence_count >= 3) AS verdicts FROM qs GROUP BY 1) q USING (node_id)""")
add("query_latency", "", """WITH l AS (SELECT 'qry-' || event_id AS query_id, 'node-' || user_id % 3 AS node_id, ts,
 CAST(floor(value * 10) AS BIGINT) AS ms, event_id % 12 <> 0 AS ok FROM events)
SELECT node_id, count(*) AS queries, count(*) FILTER (NOT ok) AS failed, CAST(sum(ms) // count(*) AS BIGINT) AS avg_ms,
 max(ms) AS max_ms, arg_max(query_id, {'t': ts, 'q': query_id}) AS last_query_id FROM l GROUP BY 1""")
add("recent_cases", "", """SELECT 'case-' || o_orderkey AS case_key, 'node-1' AS node_id, 'scanning' AS event_type,
 CAST(o_orderdate AS VARCHAR) AS "at" FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 3 = 1
 ORDER BY "at" DESC, case_key DESC LIMIT 10""")

# --- message tables and streams --------------------------------------------------------------
add("dead_letter", BUS, """SELECT seq, stream, CASE WHEN attempts >= 3 THEN attempts ELSE attempts + 1 END AS attempts,
 CASE WHEN attempts >= 3 THEN 'dead' ELSE 'retry' END AS fate FROM bus WHERE broken""")
add("message_fields", BUS, """SELECT seq, stream, attempts, CASE WHEN NOT broken THEN 'sig-' || seq END AS signal_id,
 CASE WHEN NOT broken THEN CAST(user_id AS BIGINT) END AS matched_count, CASE WHEN NOT broken THEN true END AS extra,
 CAST(NULL AS INTEGER) AS rule_id FROM bus""")
add("monitor_payloads", MONITOR, """SELECT source, event_type, count(*) AS events,
 CAST(sum(CAST(nullif(regexp_extract(payload, '"evidence_count":([0-9]+)', 1), '') AS BIGINT)) AS BIGINT) AS evidence_rows,
 count(*) FILTER (contains(payload, '"signal_id":')) AS with_signal FROM me GROUP BY ALL""")
add("stream_decode", BUS, """SELECT seq, stream, CAST(CASE WHEN broken AND attempts < 3 THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
 CASE WHEN NOT broken THEN 'good' WHEN attempts >= 3 THEN 'dead' ELSE 'retry' END AS fate FROM bus""")
add("stream_retention", f"""{BUS},
yg AS (SELECT *, sum(strlen(payload)) OVER (PARTITION BY stream ORDER BY published_at DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS run
 FROM bus WHERE published_at >= TIMESTAMP '2024-01-20' - to_days(15))""", "SELECT stream, seq FROM yg WHERE run <= 50000")
add("stream_inventory", BUS, """SELECT stream, count(*) AS messages, CAST(sum(strlen(payload)) AS BIGINT) AS bytes,
 count(DISTINCT user_id) AS consumers FROM bus GROUP BY 1""")
add("stream_fresh", SIGNALS, f"SELECT signal_id, event_time FROM sig WHERE {NOW} - t <= INTERVAL 5 MINUTE")
add("stream_dedup", BUS, "SELECT DISTINCT 'sig-' || seq // 3 AS signal_id FROM bus")

# signal_case_review: every answered signal is a case of well-formed auth evidence
_SCR = f"""{EVIDENCE},
cs AS (SELECT query_id AS case_key, count(*) AS n, count(DISTINCT timestamp) AS nt,
 epoch(max(CAST(timestamp AS TIMESTAMP)) - min(CAST(timestamp AS TIMESTAMP))) AS span FROM evd GROUP BY 1),
sc AS (SELECT *, 100 - CASE WHEN n < 2 THEN 10 ELSE 0 END - CASE WHEN n >= 2 AND nt > 1 THEN 10 ELSE 0 END
 - CASE WHEN n >= 2 AND span < 30 THEN 10 ELSE 0 END AS score FROM cs)"""
add("signal_case_review", _SCR, """SELECT case_key, score, 'unknown' AS event_type, CASE WHEN n >= 5 THEN 'medium' ELSE 'low' END AS priority,
 n >= 3 AS verified, CASE WHEN n >= 5 THEN '高' WHEN n >= 3 THEN '中' ELSE '低' END AS final_confidence, n AS evidence_count FROM sc""")

# hunt_report: the whole review of the cases that answered signals make
HUNT = f"""{EVIDENCE},{NORM},
ce AS (SELECT na.*, evd.rank AS ord, na.query_id AS case_key, epoch_us(CAST(evd.timestamp AS TIMESTAMP)) AS us
 FROM na JOIN evd USING (evidence_id, query_id)),
allc AS (SELECT DISTINCT case_key FROM ce),{_CUT},{TRIAGE},
va AS (SELECT case_key, event_type, priority, confidence, summary, conclusion, actions, ref_count FROM an),
dang AS (SELECT case_key, evidence_id, ord FROM ce WHERE false),{_CHECKS},{_VERDICT},{NUMBERED}"""
add("hunt_report", HUNT, _report(7))


def _content(name: str, rows: str, columns: str, day: str) -> str:
    """Rows of a stored table per day, with the sum of a hash of their columns."""
    text = ", ".join(f"coalesce(CAST({c.strip()} AS VARCHAR), '~')" for c in columns.split(","))
    return f"""SELECT {q(name)} AS name, {day} AS dt, count(*) AS n,
 CAST(sum(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::BIGINT) AS BIGINT) AS content FROM {rows} GROUP BY ALL"""


add("result_tables", f"""{HUNT},
ct AS (SELECT case_key, max(substr(timestamp, 1, 10)) AS dt FROM ce GROUP BY 1), rt AS ({_report(1000)})""", " UNION ALL ".join([
    _content("signals", "sig", "signal_id, node_id, rule_id, rule_level, rule_desc, severity, category, src_ip, event_time, raw_ref, matched_count",
             "substr(event_time, 1, 10)"),
    _content("evidence", "ce", "evidence_id, case_key, query_id, timestamp, rule_id, severity, description, hostname, src_ip", "substr(timestamp, 1, 10)"),
    _content("readiness", "vf JOIN ct USING (case_key)", "case_key, score, level", "dt"),
    _content("analysis", "vf JOIN ct USING (case_key)", "case_key, event_type, priority, conclusion", "dt"),
    _content("verification", "vf JOIN ct USING (case_key)", "case_key, verified, final_confidence", "dt"),
    _content("reports", "rt JOIN ct USING (case_key)", "case_key, part, text", "dt")]))
_WINDOW = "timestamp BETWEEN '2024-01-05T00:00:00.000000+00:00' AND '2024-01-20T00:00:00.000000+00:00'"
add("gateway_query", f"""{ALERTS},
gq AS (SELECT *, 'qry-1' AS query_id, {_AHASH} AS hash FROM al
 WHERE node_id = 'node-1' AND rule_id = '5710' AND {_WINDOW} ORDER BY timestamp, id LIMIT 30)""",
    f"""SELECT 'ev-' || {h16('query_id', 'node_id', 'id')} AS evidence_id, query_id, node_id || '/wazuh_alerts#' || timestamp AS raw_ref,
 query_id || ':' || hash AS lineage_id, hash, timestamp, 'wazuh_alerts' AS source, rule_id, rule_text AS description,
 coalesce(agent_ip, '0.0.0.0') AS src_ip, agent_name AS hostname, rule_level AS severity, full_log AS raw_log FROM gq
UNION ALL (SELECT NULL, 'qry-2', NULL, NULL, NULL, timestamp, NULL, NULL, NULL, NULL, agent_name, NULL, full_log FROM al
 WHERE node_id = 'node-2' AND rule_id = '5503' AND {_WINDOW} ORDER BY timestamp, id LIMIT 25)""")
