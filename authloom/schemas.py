"""Explicit schemas of every stage; nothing is inferred at read time."""

RULE = (
    "id string, name string, severity string, category string, description string, "
    "match struct<process:string,patterns:array<string>>, "
    "threshold struct<count:int,window_seconds:int,group_by:string>, cooldown_seconds int, "
    "signal struct<priority:int,event_type:string,suggested_logs:array<string>>"
)

ALERT = (
    "timestamp string, "
    "rule struct<level:int,description:string,id:string,firedtimes:int,mail:boolean,groups:array<string>>, "
    "agent struct<id:string,name:string,ip:string>, manager struct<name:string>, id string, "
    "full_log string, predecoder struct<program_name:string,timestamp:string,hostname:string>, "
    "decoder struct<name:string>, location string"
)

EVIDENCE = (
    "timestamp string, severity int, rule_id string, description string, src_ip string, "
    "hostname string, evidence_id string, source string, raw_log string, raw_ref string, "
    "lineage_id string, query_id string"
)
EVIDENCE_COLUMNS = [c.split()[0] for c in EVIDENCE.split(", ")]

REGISTRY = (
    "node_id string, source_name string, source_type string, local_path string, format string, "
    "query_engine string, query_endpoint string, retention_days int, "
    "sources array<struct<source_name:string,source_type:string,local_path:string,format:string,"
    "query_engine:string,query_endpoint:string,retention_days:int>>"
)

REPLY = (
    "priority string, event_type string, summary string, confidence string, "
    "suggested_actions array<string>, progress string"
)
