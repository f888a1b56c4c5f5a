"""Values that every result depends on, kept together so they can be checked at a glance.

Everything in this module is a fixed value: patterns, word lists, lookup tables, thresholds and
message texts. No logic lives here.
"""

# --- fixed values: line patterns -------------------------------------------------------------
# (?dU) makes Java's "." stop only at \n and its classes Unicode-aware.
SYSLOG_HEADER = (
    r"(?dU)^(\w{3})\s+(\d+)\s+(\d+):(\d+):(\d+)\s+(\S+)\s+(\w+)(?:\[(\d+)\])?:\s+(.*)$"
)
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

SSH_FAILED_PASSWORD = r"Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)"
SSH_ACCEPTED = r"Accepted (?:password|publickey) for (\S+) from (\S+) port (\d+)"
SSH_AUTH_FAILURE = r"(?:error: PAM: )?[Aa]uthentication failure"
SSH_NO_IDENT = r"Did not receive identification string from (\S+) port (\d+)"
SSH_CLOSED = r"Connection closed by (?:authenticating user (\S+) )?(\S+) port (\d+)"
SSH_PREAUTH = r"(?:error: )?Received disconnect from (\S+) port (\d+):.*\[preauth\]"
SUDO_USER = r"user=(\S+)"
SUDO_COMMAND = r"TTY=(\S+).*USER=(\S+).*COMMAND=(.*)"
SU_FAILED = r"FAILED SU \(to (\S+)\)"
SU_SUCCESS = r"\(to (\S+)\) (\S+) on"

# --- fixed values: sentinels and limits ------------------------------------------------------
NO_IP = "0.0.0.0"
GLOBAL_GROUP = "global"
REQUEST_LIMIT = 20
EVENT_QUERY_LIMIT = 50
STALE_AFTER_SECONDS = 300
RETENTION_SECONDS = 3600
MAX_DELIVERIES = 3
STREAM_MAX_AGE_SECONDS = 24 * 3600
STREAM_MAX_BYTES = 500 * 1024 * 1024

# --- fixed values: severity of rules and of parsed log types ---------------------------------
SEVERITY_LEVEL = {"critical": 11, "high": 8, "medium": 5, "low": 2}
SEVERITY_LEVEL_DEFAULT = 5

LOG_TYPE_SEVERITY = {
    "ssh_failed_password": 5,
    "ssh_auth_failure": 5,
    "ssh_scan": 3,
    "ssh_accepted": 1,
    "ssh_connection_closed": 3,
    "ssh_preauth_disconnect": 3,
    "sudo_auth_failure": 5,
    "su_failed": 5,
}
LOG_TYPE_SEVERITY_DEFAULT = 3

# --- fixed values: triage --------------------------------------------------------------------
# rule -> (event type, priority)
TRIAGE = {
    "LOCAL_SSH_BRUTE_FORCE": ("brute_force", "high"),
    "LOCAL_SSH_SCAN": ("reconnaissance", "medium"),
    "LOCAL_SUDO_FAILURES": ("privilege_escalation", "high"),
    "LOCAL_SU_FAILURES": ("privilege_escalation", "medium"),
    "LOCAL_SSH_ACCEPTED": ("unknown", "low"),
    "5503": ("brute_force", "high"),
    "5710": ("scanning", "medium"),
    "5501": ("malware_detected", "critical"),
    "5712": ("reconnaissance", "medium"),
    "5763": ("privilege_escalation", "critical"),
    "5715": ("lateral_movement", "high"),
    "5502": ("data_exfiltration", "critical"),
}
TRIAGE_EVENT_TYPE = {rule: event for rule, (event, _) in TRIAGE.items()}
TRIAGE_PRIORITY = {rule: priority for rule, (_, priority) in TRIAGE.items()}
PRIORITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

PHASE_RECON = "侦查(Reconnaissance)"
PHASE_WEAPON = "武器化(Weaponization)"
PHASE_EXPLOIT = "利用(Exploitation)"
PHASE_C2 = "命令与控制(C2)"
PHASE_ACTIONS = "目标行动(Actions on Objectives)"
# (highest severity of the band, phase)
PHASE_BANDS = [
    (3, PHASE_RECON),
    (6, PHASE_WEAPON),
    (9, PHASE_EXPLOIT),
    (12, PHASE_C2),
    (15, PHASE_ACTIONS),
]
PHASE_BY_RULE = {
    "LOCAL_SSH_BRUTE_FORCE": PHASE_EXPLOIT,
    "LOCAL_SSH_SCAN": PHASE_RECON,
    "LOCAL_SUDO_FAILURES": PHASE_ACTIONS,
    "LOCAL_SU_FAILURES": PHASE_ACTIONS,
    "LOCAL_SSH_ACCEPTED": PHASE_EXPLOIT,
    "5503": PHASE_EXPLOIT,
    "5710": PHASE_RECON,
    "5501": PHASE_ACTIONS,
}
PHASE_DEFAULT = PHASE_RECON

ACTIONS = {
    "brute_force": ["锁定异常源IP地址", "启用多因素认证(MFA)", "限制登录频率（如 5次/分钟）", "审计相关用户账号"],
    "scanning": ["添加WAF规则拦截扫描IP", "封禁扫描来源IP段", "启用入侵检测规则"],
    "malware_detected": ["立即隔离受影响主机", "全盘扫描检测恶意软件", "上报应急响应团队", "检查横向移动迹象"],
    "reconnaissance": ["加强网络监控", "加固公开服务", "审计访问日志"],
    "privilege_escalation": ["立即审查权限变更", "重置管理员密码", "审计所有特权账号"],
    "lateral_movement": ["隔离受影响网段", "检查所有横向连接", "启动应急响应流程"],
    "data_exfiltration": ["立即阻断外连流量", "检查所有数据传输", "启动数据泄露应急响应"],
    "unknown": ["持续监控告警趋势", "收集更多上下文信息", "更新规则库"],
}

# --- fixed values: readiness -----------------------------------------------------------------
REQUIRED_FIELDS = ["evidence_id", "timestamp", "source", "src_ip", "rule_id", "description"]
RECOMMENDED_FIELDS = ["severity", "hostname", "raw_log", "evidence_id"]
# (lowest score, level, allowed, blocked)
READINESS_LEVELS = [
    (80, "完整可用", ["analyze", "report", "persist"], []),
    (60, "基本可用", ["analyze", "report"], ["persist"]),
    (40, "数据不足", ["analyze"], ["report", "persist"]),
    (0, "严重不足", [], ["analyze", "report", "persist"]),
]

# --- fixed values: verification --------------------------------------------------------------
FORBIDDEN_PHRASES = [
    "完全控制",
    "已被攻陷",
    "数据泄露",
    "rootkit",
    "APT攻击",
    "供应链攻击",
    "国家级攻击者",
    "已成功入侵",
    "完全沦陷",
    "内部威胁确认",
]
UNVERIFIED_CONCLUSION = "证据有限或校验未通过，结论谨慎使用"

# --- fixed values: monitoring ----------------------------------------------------------------
CLIENT_COMPONENTS = ["SignalWatcher", "DuckDBSidecar", "DetectionEngine"]

# --- fixed values: the shipped rule catalog --------------------------------------------------
DEFAULT_RULES = [
    {
        "id": "LOCAL_SSH_BRUTE_FORCE",
        "name": "SSH Brute Force Attack",
        "severity": "high",
        "category": "brute_force",
        "match": {"process": "sshd", "patterns": ["Failed password", "authentication failure"]},
        "threshold": {"count": 5, "window_seconds": 300, "group_by": "src_ip"},
        "cooldown_seconds": 30,
        "signal": {"priority": 5, "event_type": "brute_force", "suggested_logs": ["auth_log"]},
    },
    {
        "id": "LOCAL_SSH_SCAN",
        "name": "SSH Scan Detection",
        "severity": "medium",
        "category": "reconnaissance",
        "match": {
            "process": "sshd",
            "patterns": ["Did not receive identification string", "Connection closed by"],
        },
        "threshold": {"count": 3, "window_seconds": 120, "group_by": "src_ip"},
        "cooldown_seconds": 30,
        "signal": {"priority": 4, "event_type": "reconnaissance", "suggested_logs": ["auth_log"]},
    },
    {
        "id": "LOCAL_SUDO_FAILURES",
        "name": "Sudo Authentication Failures",
        "severity": "medium",
        "category": "privilege_escalation",
        "match": {"process": "sudo", "patterns": ["authentication failure"]},
        "threshold": {"count": 3, "window_seconds": 120, "group_by": "dst_user"},
        "cooldown_seconds": 30,
        "signal": {"priority": 4, "event_type": "privilege_escalation", "suggested_logs": ["auth_log"]},
    },
    {
        "id": "LOCAL_SU_FAILURES",
        "name": "Su Authentication Failures",
        "severity": "medium",
        "category": "privilege_escalation",
        "match": {"process": "su", "patterns": ["FAILED SU"]},
        "threshold": {"count": 3, "window_seconds": 120, "group_by": "dst_user"},
        "cooldown_seconds": 30,
        "signal": {"priority": 4, "event_type": "privilege_escalation", "suggested_logs": ["auth_log"]},
    },
    {
        "id": "LOCAL_SSH_ACCEPTED",
        "name": "SSH Successful Login",
        "severity": "low",
        "category": "normal",
        "match": {"process": "sshd", "patterns": ["Accepted password", "Accepted publickey"]},
        "threshold": {"count": 1, "window_seconds": 1},
        "cooldown_seconds": 0,
        "signal": {"priority": 2, "event_type": "normal", "suggested_logs": ["auth_log"]},
    },
]

# --- fixed values: wording of verification issues --------------------------------------------
UNKNOWN_REFS = "研判引用了不存在的 evidence_id: ["
SEVERAL_QUERIES = "证据来自多个查询: {"
ONE_EVIDENCE = "证据 "
RAW_REF_MISSING, RAW_REF_INVALID = " 缺少 raw_ref", " 的 raw_ref 格式无效: "
LINEAGE_MISSING, LINEAGE_INVALID = " 缺少 lineage_id", " 的 lineage_id 格式无效: "
FORBIDDEN_WORDING = "结论包含绝对化表述: 「{}」，风险过高，需要更多证据支撑"
THIN_EVIDENCE = ("证据仅 ", " 条，但结论过于详细，置信度存疑")
LOW_READINESS = ("数据就绪度 ", " 分低于 60，结论需谨慎")
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM, CONFIDENCE_LOW = "高", "中", "低"

# --- fixed values: wording of triage ---------------------------------------------------------
SUMMARY_TYPED = ("检测到 ", " 条告警，主要类型: ", "（规则ID: ", "）")
SUMMARY_UNTYPED = ("检测到 ", " 条未分类告警")
SUMMARY_EMPTY = "无证据，无法分诊"
PHASE_DESCRIPTION = ("规则 ", " 触发的告警")
PROGRESS = "攻击链进展: "
REPLY_SUMMARY, REPLY_PROGRESS = "LLM 分析完成", "攻击链分析完成"
NO_PROGRESS, STATUS = "无证据，无法分析攻击链", "攻击链状态: "
FAILED_SUMMARY, FAILED_CONCLUSION, FAILED_ACTIONS = "研判异常", "自动研判失败，需人工介入", ["人工核查"]
