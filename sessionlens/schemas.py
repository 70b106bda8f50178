"""Fixed schemas of the tables: observations (silver), events (gold), rules, chains and packs."""

from __future__ import annotations

from pyspark.sql import types as T


OBSERVATIONS = """client string, source_id string, source_kind string, source_path string, source_path_hash string, source_instance string,
observation_id string, family string, stage string, native_id string, source_sequence long, child_ordinal int,
occurred_at timestamp, occurred_at_raw string, observed_at timestamp, session_id string, session_origin string, call_id string,
agent string, model string, provider string, ingestion_mode string, caps map<string,string>, role string, text string, text_parts array<string>,
tool_name string, tool_kind string, command string, arguments string, written_path string, file_path string, url string,
tool_result string, is_error boolean, exit_code long, reported_status string, partial boolean, extra map<string,string>"""

CONTRIBUTION = "struct<id:string,type:string,points:long,rationale:string>"
EVENTS = f"""timestamp string, event_time timestamp, observed_at timestamp, ingested_at timestamp, time_source string, time_confidence string,
time_override_reason string, schema_version string, event_id string, event_type string, severity string, risk_score long,
risk_contributions array<{CONTRIBUTION}>, client string, agent string, model string, provider string, session_id string, source_path_hash string,
tool_name string, rule_ids array<string>, categories array<string>, detection_classes array<string>, signal_types array<string>,
analytic_intents array<string>, atlas_tags array<string>, tags array<string>,
evidence array<struct<field:string,redacted_value:string,hash:string,rule_id:string>>,
timeline_anchors array<struct<entry_index:int,rule_ids:array<string>,categories:array<string>,evidence_fields:array<string>>>,
response struct<recommended_action:string,response_playbook:string,investigation_summary:string,escalation:string>,
informational boolean, confidence string, detection_reason string, mitre_attack_techniques array<string>, risk_entity_type string,
risk_entity_value string, process struct<parent:string,child:string,command_line:string,parent_inferred:boolean,host:string,user:string>,
source_counts map<string,long>, status string, scan_duration_ms long, rule_count long, emitted_count long, suppressed_count long, scanner_error_count long"""

RULES = """rule_id string, name string, status string, enabled boolean, category string, detection_class string, signal_type string,
analytic_intent string, severity string, score long, explanation string, tags array<string>, atlas_tags array<string>,
matchers array<struct<target:string,regex:string,exclusion_regex:string,scope:string>>, action_fields array<string>"""
CHAINS = """id string, score long, when_all_categories array<string>, when_all_rule_ids array<string>,
link struct<calls:int,order:string,minutes:int>, explanation string"""
PROCESS_RULES = """id string, title string, category string, severity string, score long, confidence string, parent string, child string,
mitre array<string>, command_line_any array<string>, command_line_none array<string>, path_any array<string>, path_none array<string>,
dedup_key string, enabled boolean"""
PROCESS_CORRELATIONS = """id string, category string, severity string, score long, window_seconds long, entity string,
steps array<struct<any_category:array<string>,any_rule_id:array<string>,any_child:array<string>>>"""
ALLOWLIST = """ord int, name string, clients array<string>, session_ids array<string>, tool_names array<string>, rule_ids array<string>,
categories array<string>, source_path_hashes array<string>"""

#: Fixed values of the model.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
EVENT_TYPES = ("detection", "session_risk_summary", "activity", "health", "mcp_inventory", "correlation", "process_chain", "inventory_error")
TARGETS = ("command", "arguments", "written_path", "file_path", "tool_name", "tool_kind", "url", "tool_result", "assistant_context", "user_context")
"""Rule targets, the columns that rules read."""


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
