"""SQL fragments that describe the derived inputs; valid in Spark and DuckDB alike.

They only say what the raw material looks like (line templates, defects, replies). What the engine
makes of it is computed by the operators on one side and by ``oracles.py`` on the other.
"""

MESSAGE = """
CASE event_type
 WHEN 'error' THEN CASE
   WHEN k = 0 THEN 'Failed password for invalid user ' || usr || ' from ' || ip || ' port ' || port || ' ssh2'
   WHEN k = 1 THEN 'error: PAM: Authentication failure for ' || usr || ' from ' || ip
   WHEN k = 2 THEN 'pam_unix(sshd:auth): authentication failure; rhost=' || ip || ' user=' || usr
   ELSE 'Failed password for ' || usr || ' from ' || ip || ' port ' || port || ' ssh2' END
 WHEN 'click' THEN CASE
   WHEN k IN (0, 4, 8) THEN 'Did not receive identification string from ' || ip || ' port ' || port
   WHEN k IN (1, 5, 9) THEN 'Connection closed by authenticating user ' || usr || ' ' || ip || ' port ' || port || ' [preauth]'
   WHEN k = 3 THEN 'Received disconnect from ' || ip || ' port ' || port || ':11: bye [preauth]'
   WHEN k = 7 THEN 'Connection closed by invalid user x ' || ip || ' port ' || port
   WHEN k = 11 THEN 'Server listening on 0.0.0.0 port 22.'
   ELSE 'Connection closed by ' || ip || ' port ' || port END
 WHEN 'view' THEN CASE
   WHEN k % 2 = 0 THEN 'Accepted publickey for ' || usr || ' from ' || ip || ' port ' || port || ' ssh2: RSA SHA256:abc123'
   ELSE 'Accepted password for ' || usr || ' from ' || ip || ' port ' || port || ' ssh2' END
 WHEN 'signup' THEN CASE
   WHEN k = 0 THEN usr || ' : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/bash'
   WHEN k = 1 THEN usr || ' : user NOT in sudoers'
   WHEN k = 2 THEN 'pam_unix(sudo:auth): authentication failure; ruser=eve rhost=  user=' || usr
   ELSE 'pam_unix(sudo:auth): authentication failure; logname= uid=0 euid=0 tty=/dev/pts/0 ruser= rhost=  user=' || usr END
 ELSE CASE
   WHEN k = 0 THEN '(to root) ' || usr || ' on pts/1'
   WHEN k = 1 THEN 'pam_unix(su:session): session opened'
   WHEN k = 2 THEN 'pam_unix(login:auth): authentication failure; user=' || usr
   ELSE 'FAILED SU (to ' || usr || ') for nobody on /dev/pts/0' END
END"""

PROCESS = """
CASE WHEN d = 5 THEN 'systemd-logind'
 WHEN event_type IN ('error', 'click', 'view') THEN 'sshd'
 WHEN event_type = 'signup' THEN 'sudo'
 WHEN k = 2 THEN 'login' ELSE 'su' END"""

# d: 5 wrong process shape, 7 unknown month, 11 impossible day, 13 pid too large, 17 no pid
STAMP = """
CASE WHEN d = 7 THEN 'Mai 12 ' || clock WHEN d = 11 THEN 'Feb 30 ' || clock
 WHEN d = 23 THEN month || ' ' || day2 || ' ' || clock
 ELSE month || ' ' || lpad(day1, 2, ' ') || ' ' || clock END"""

PID_TEXT = "CASE WHEN d = 13 THEN '[99999999999]' WHEN d = 17 THEN '' ELSE '[' || pid || ']' END"

RAW_LINE = "stamp || ' ' || host || ' ' || proc || pid_text || ': ' || message"

# alerts
ALERT_RULE = """
CASE event_type WHEN 'error' THEN '5503' WHEN 'click' THEN '5716' WHEN 'view' THEN '5402'
 WHEN 'signup' THEN '5403' ELSE '5710' END"""
ALERT_LEVEL = "CASE event_type WHEN 'view' THEN 3 WHEN 'purchase' THEN 10 ELSE 5 END"
ALERT_TEXT = """
CASE event_type WHEN 'error' THEN 'login rejected for ' || usr WHEN 'click' THEN 'remote side hung up early'
 WHEN 'view' THEN 'administrator session opened' WHEN 'signup' THEN 'administrator session refused'
 ELSE 'name is not known on ' || host END"""

# case evidence: rows with deliberate defects
CASE_TIME = """
CASE WHEN event_id % 13 = 0 THEN 'not-a-time' WHEN event_id % 17 = 0 THEN NULL
 WHEN event_id % 6 = 0 THEN iso || 'Z' WHEN event_id % 6 = 1 THEN iso || '+0000'
 WHEN event_id % 6 = 2 THEN plain WHEN event_id % 6 = 3 THEN slashed
 WHEN event_id % 6 = 4 THEN iso || '.250000Z' ELSE iso END"""
CASE_RULE = """
CASE event_id % 16 WHEN 0 THEN 'LOCAL_SSH_BRUTE_FORCE' WHEN 1 THEN 'LOCAL_SSH_SCAN'
 WHEN 2 THEN 'LOCAL_SUDO_FAILURES' WHEN 3 THEN 'LOCAL_SU_FAILURES' WHEN 4 THEN 'LOCAL_SSH_ACCEPTED'
 WHEN 5 THEN '5503' WHEN 6 THEN '5710' WHEN 7 THEN '5501' WHEN 8 THEN '5712' WHEN 9 THEN '5763'
 WHEN 10 THEN '5715' WHEN 11 THEN '5502' WHEN 12 THEN '' ELSE 'ssh_failed_password' END"""
CASE_SEVERITY = "CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(event_id % 18 AS INT) END"

REPLY_BODY = """
'{' || CASE WHEN cno % 3 = 0 THEN '' ELSE '"priority": "critical", ' END
 || '"event_type": "' || CASE WHEN cno % 2 = 0 THEN 'scanning' ELSE 'malware_detected' END || '", '
 || '"summary": "用户 ' || cno || CASE WHEN cno % 6 = 0 THEN ' 已被攻陷' ELSE ' 需要关注' END || '", '
 || '"confidence": "high", "suggested_actions": ["核查 ' || cno || '", "封禁"]}'"""
REPLY = f"""
CASE cno % 5 WHEN 0 THEN '分析如下 ```json' || nl || body || nl || '``` 完'
 WHEN 1 THEN '说明 ```' || nl || body || nl || '``` 完' WHEN 2 THEN body
 WHEN 3 THEN '无法给出 ' || body ELSE NULL END"""

# source registry entries, one JSON document per supplier
REGISTRY_DOC = """
CASE sk % 5
 WHEN 0 THEN '{"node_id": "node-' || node_no || '", "sources": [{"source_name": "auth_log", "local_path": "/logs/' || sk || '/auth.log", "format": "syslog", "retention_days": 7}, {"source_name": "wazuh_alerts", "local_path": "/logs/' || sk || '/alerts.json", "format": "json", "retention_days": 30}]}'
 WHEN 1 THEN '{"node_id": "node-' || node_no || '", "source_name": "auth_log", "source_type": "syslog", "local_path": "/logs/' || sk || '/auth.log", "format": "syslog", "retention_days": 14}'
 WHEN 2 THEN '{"node_id": "node-' || node_no || '", "source_name": "wazuh_alerts", "local_path": "", "format": "json"}'
 WHEN 3 THEN '{"node_id": "node-' || node_no || '", "source_name": "nginx_access", "local_path": "/logs/' || sk || '/access.json", "format": "json", "query_endpoint": "local"}'
 ELSE '{"node_id": "node-' || node_no || '", "sources": []}' END"""

# rule documents, one per part
RULE_DOC = """
'{"id": "R' || pk || '", "name": "rule ' || pk || '"'
 || CASE WHEN pk % 4 = 0 THEN '' ELSE ', "severity": "high"' END
 || CASE WHEN pk % 5 = 0 THEN '' ELSE ', "category": "scan"' END
 || ', "match": {' || CASE WHEN pk % 7 = 0 THEN '' ELSE '"process": "sshd", ' END
 || '"patterns": [' || CASE WHEN pk % 11 = 0 THEN '' ELSE '"size ' || psize || '"' END || ']}'
 || CASE WHEN pk % 3 = 0 THEN '' ELSE ', "threshold": {"count": ' || psize || ', "window_seconds": 60, "group_by": "src_ip"}' END
 || CASE WHEN pk % 2 = 0 THEN '' ELSE ', "cooldown_seconds": 0, "signal": {"priority": 1, "event_type": "x", "suggested_logs": ["a", "b"]}' END
 || '}'"""

# a rule per part, for catalogs of many rules
PART_RULE = """'{"id":"P' || p_partkey || '","match":{"process":"' || CASE p_partkey % 3 WHEN 0 THEN 'sudo' ELSE 'sshd' END ||
 '","patterns":["user' || p_partkey % 89 || ' from","user=user' || p_partkey || '","port ' || p_partkey || '%ssh2"]},"threshold":{"count":' ||
 (1 + p_partkey % 4) || ',"window_seconds":' || 7200 * (1 + p_partkey % 300) || CASE WHEN p_partkey % 2 = 0 THEN ',"group_by":"src_ip"' ELSE '' END ||
 '},"cooldown_seconds":0}'"""
