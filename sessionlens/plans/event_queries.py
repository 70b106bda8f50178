"""Queries on events: correlation, suppression, summaries, timelines, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import activity
from sessionlens.operators import gold, predicates, process, scoring, sequences
from sessionlens.plans.inputs import DETECTION_SQL, detections, table
from sessionlens.plans.registry import query
from sessionlens.sinks import writers

JOINED = lambda c: F.array_join(c, ",")


@query(f"""WITH {DETECTION_SQL} SELECT event_id FROM d WHERE severity IN ('high', 'critical') AND client IN ('c0', 'c1') AND list_contains(rule_ids, 'rule.even') AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:01'""")
def export_filter(spark, sf_dir):
    return predicates.filter_events(detections(spark, sf_dir), severities=("HIGH", "critical"), clients=("c0", "c1"), rule_ids=("rule.even",), since="2024-01-05 00:00:00", until="2024-01-20 00:00:00").select("event_id")


@query(f"""WITH {DETECTION_SQL}, x AS (SELECT dimension, value FROM (SELECT 'event_type' AS dimension, 'detection' AS value FROM d UNION ALL SELECT 'severity', severity FROM d UNION ALL SELECT 'client', client FROM d UNION ALL SELECT 'rule_id', unnest(rule_ids) FROM d))
SELECT dimension, value, count(*) AS n FROM x GROUP BY 1, 2""")
def event_summary(spark, sf_dir):
    return gold.event_summary(detections(spark, sf_dir))


SUMMARY_SQL = f"""WITH {DETECTION_SQL},
u AS (SELECT DISTINCT client, session_id, unnest(rule_ids) AS id FROM d),
p AS (SELECT client, session_id, CAST(sum(length(id)) AS BIGINT) AS risk_score, string_agg(id || ':' || length(id), ',' ORDER BY id) AS parts FROM u GROUP BY 1, 2)
SELECT client, session_id, p.risk_score, p.parts, count(*) + 1 AS events, count(*) AS n_detection, count(*) FILTER (WHERE tool_name <> 'view') AS tool_calls, max(timestamp) AS timestamp,
  string_agg(DISTINCT category, ',' ORDER BY category) AS categories, 'activity,risk_summary,risky_action,session' AS tags,
  CASE WHEN p.risk_score >= 90 THEN 'critical' WHEN p.risk_score >= 70 THEN 'high' WHEN p.risk_score >= 50 THEN 'medium' WHEN p.risk_score >= 20 THEN 'low' ELSE 'informational' END AS severity
FROM d JOIN p USING (client, session_id) GROUP BY client, session_id, p.risk_score, p.parts"""


@query(SUMMARY_SQL)
def session_risk_summary(spark, sf_dir):
    """Detections whose rules each give as many points as their name is long, and one activity a session with the number of its calls."""
    d = detections(spark, sf_dir)
    parts = F.transform("rule_ids", lambda r: F.struct(r.alias("id"), F.lit("rule").alias("type"), F.length(r).cast("long").alias("points"), F.lit("").alias("rationale")))
    found = d.withColumns({"risk_contributions": parts, "risk_score": F.aggregate(parts, F.lit(0).cast("long"), lambda a, c: a + c["points"])})
    calls = d.groupBy("client", "source_path_hash", "session_id").agg(F.count_if(F.col("tool_name") != "view").alias("n"))
    shown = F.to_json(F.struct(F.col("n").alias("tool_call")))
    acts = calls.withColumns({"event_type": F.lit("activity"), "event_id": F.concat(F.lit("act"), "session_id"), "risk_score": F.lit(0), "evidence": F.array(F.struct(F.lit("record_counts").alias("field"), shown.alias("redacted_value"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("rule_id")))})
    s = gold.session_risk_summary(gold.as_events(found).unionByName(gold.as_events(acts)))
    shares = F.array_join(F.transform("risk_contributions", lambda c: F.concat(c["id"], F.lit(":"), c["points"])), ",")
    return s.select("client", "session_id", "risk_score", shares.alias("parts"), "events", "n_detection", "tool_calls", "timestamp", JOINED("categories").alias("categories"), JOINED("tags").alias("tags"), "severity")


@query(f"""WITH {DETECTION_SQL}, r AS (SELECT session_id, client, value, count(*) AS n FROM (SELECT session_id, client, unnest(rule_ids) AS value FROM d) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, client ORDER BY n DESC, value) AS rk FROM r),
t AS (SELECT session_id, client, string_agg(value, ',' ORDER BY rk) AS top_rules FROM k WHERE rk <= 3 GROUP BY 1, 2)
SELECT d.session_id, d.client, count(*) AS detections, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'informational' END AS max_severity, any_value(top_rules) AS top_rules
FROM d JOIN t ON d.session_id = t.session_id AND d.client = t.client GROUP BY 1, 2""")
def timeline_summary(spark, sf_dir):
    s = gold.timeline_summary(detections(spark, sf_dir))
    return s.select("session_id", "client", "detections", "max_severity", JOINED("top_rules").alias("top_rules"))


@query(f"""WITH {DETECTION_SQL}, r AS (SELECT client, 'a' || (CAST(session_id AS BIGINT) % 2) AS agent, rule_id, sec, session_id, risk_score, event_id FROM (SELECT *, unnest(rule_ids) AS rule_id FROM d) WHERE risk_score >= 70),
f AS (SELECT *, count(*) OVER w AS n, min(sec) OVER w AS start FROM r WINDOW w AS (PARTITION BY client, agent, rule_id ORDER BY sec RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW)),
b AS (SELECT client, agent, rule_id, start, sec AS fin FROM (SELECT *, row_number() OVER (PARTITION BY client, agent, rule_id ORDER BY n DESC, sec) AS rn FROM f) WHERE rn = 1),
i AS (SELECT r.client, r.agent, r.rule_id, string_agg(DISTINCT session_id, ',' ORDER BY session_id) AS session_ids, count(DISTINCT session_id) AS ns, min(sec) AS s, max(sec) AS e, max(risk_score) AS risk FROM r JOIN b ON r.client = b.client AND r.agent = b.agent AND r.rule_id = b.rule_id AND r.sec BETWEEN b.start AND b.fin GROUP BY 1, 2, 3)
SELECT client, agent, session_ids, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids, min(s) AS window_start, max(e) AS window_end, max(risk) AS risk_score FROM i WHERE ns >= 2 GROUP BY 1, 2, 3""")
def correlate_sessions(spark, sf_dir):
    shared = F.concat(F.lit("a"), F.col("session_id").cast("long") % 2)  # agents that several sessions share at every scale
    c = gold.in_order(sequences.correlate_sessions(detections(spark, sf_dir).withColumn("agent", shared), window=259_200))
    return c.select("client", "agent", JOINED("session_ids").alias("session_ids"), JOINED("rule_ids").alias("rule_ids"), F.col("window_start").cast("long").alias("window_start"), F.col("window_end").cast("long").alias("window_end"), "risk_score")


@query(f"""WITH {DETECTION_SQL}, n AS (SELECT *, CASE WHEN client = 'c0' AND tool_name IN ('click', 'view') THEN 'clicks' WHEN session_id = '7' THEN 'user' END AS name FROM d)
SELECT CASE WHEN eid % 13 <> 0 THEN event_id END AS event_id, session_id, CASE WHEN name IS NULL THEN severity ELSE 'informational' END AS severity, CASE WHEN name IS NULL THEN risk_score ELSE 0 END AS risk_score,
  CASE WHEN name IS NULL THEN 'own' ELSE 'own,suppressed,allowlist:' || name END AS tags, name AS shown FROM n""")
def allowlist(spark, sf_dir):
    entries = spark.createDataFrame([(1, "clicks", ["c0"], None, ["click", "view"], None, None, None), (2, "user", None, ["7"], None, None, None, None), (3, "empty", None, None, None, None, None, None)], "ord int, name string, clients array<string>, session_ids array<string>, tool_names array<string>, rule_ids array<string>, categories array<string>, source_path_hashes array<string>")
    none = F.array().cast("array<struct<field:string,redacted_value:string,hash:string,rule_id:string>>")
    d = detections(spark, sf_dir).withColumns({"tags": F.array(F.lit("own")), "evidence": none, "event_id": F.when(F.col("event_id").cast("long") % 13 != 0, F.col("event_id"))})
    return gold.allowlisted(d, entries).select("event_id", "session_id", "severity", "risk_score", JOINED("tags").alias("tags"), F.get("evidence", F.lit(0))["redacted_value"].alias("shown"))


@query(f"""WITH {DETECTION_SQL} SELECT event_id, CASE severity WHEN 'critical' THEN 'investigate_immediately' WHEN 'high' THEN 'investigate' WHEN 'medium' THEN 'review' ELSE 'monitor' END AS action, CASE WHEN category = 'mcp' THEN 'playbook-mcp-prompt-injection' ELSE 'playbook-network-egress' END AS playbook FROM d""")
def response_metadata(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("r", activity.response(F.col("severity"), F.col("rule_ids"), F.col("categories"), F.col("risk_score") >= 70))
    return d.select("event_id", F.col("r.recommended_action").alias("action"), F.col("r.response_playbook").alias("playbook"))


@query("""WITH e AS (SELECT event_id, ts, ts - (event_id % 10) * INTERVAL 1 MINUTE AS observed FROM events)
SELECT event_id, CAST(floor(epoch(CASE WHEN ts > observed + INTERVAL 5 MINUTE THEN observed ELSE ts END)) AS BIGINT) AS at, CASE WHEN ts > observed + INTERVAL 5 MINUTE THEN 'observed' ELSE 'source' END AS time_source, CASE WHEN ts > observed + INTERVAL 5 MINUTE THEN 'future_source_time' END AS reason FROM e""")
def event_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp")).withColumn("observed", F.timestamp_micros(F.unix_micros("t") - (F.col("event_id") % 10) * 60_000_000))
    e = e.withColumn("x", activity.event_time(F.col("t").cast("string"), F.col("observed")))
    return e.select("event_id", F.col("x.event_time").cast("long").alias("at"), F.col("x.time_source").alias("time_source"), F.col("x.time_override_reason").alias("reason"))


@query(f"""WITH {DETECTION_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool_name ORDER BY risk_score DESC, eid) AS rn FROM d) SELECT session_id, tool_name, event_id, risk_score FROM k WHERE rn = 1""")
def dedup_best(spark, sf_dir):
    d = detections(spark, sf_dir).select("session_id", F.col("tool_name").alias("dedup_key"), F.lpad("event_id", 12, "0").alias("rule_id"), "severity", F.col("risk_score").alias("score"), F.array(F.lit("T1059")).alias("mitre"))
    got = process.dedup_process(d, ["session_id"])
    return got.select("session_id", F.col("dedup_key").alias("tool_name"), F.col("rule_id").cast("long").cast("string").alias("event_id"), F.col("score").alias("risk_score"))


@query(f"""WITH {DETECTION_SQL}, x AS (SELECT *, CASE eid % 5 WHEN 0 THEN 'discovery' WHEN 1 THEN 'persistence' WHEN 2 THEN 'command_and_control' WHEN 3 THEN 'impact' ELSE 'execution' END AS cat FROM d),
w AS (SELECT *, CASE WHEN eid % 11 = 0 THEN NULL WHEN client = 'c1' AND cat IN ('discovery', 'persistence', 'execution') AND severity <> 'critical' THEN 'approved administrative user'
  WHEN agent = 'a2' AND cat IN ('discovery', 'execution') THEN 'known management server' WHEN cat = 'command_and_control' AND tool_name = 'view' THEN 'sanctioned remote management product' END AS risk_adjustment FROM x)
SELECT event_id, risk_adjustment, CASE WHEN risk_adjustment IS NULL THEN severity ELSE CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'informational' END END AS severity,
  CASE WHEN risk_adjustment IS NULL THEN risk_score ELSE CASE severity WHEN 'critical' THEN 55 WHEN 'high' THEN 40 WHEN 'medium' THEN 20 ELSE 0 END END AS score, risk_adjustment IS NOT NULL AND severity NOT IN ('critical', 'high', 'medium') AS informational FROM w""")
def demotion(spark, sf_dir):
    n = F.col("event_id").cast("long")
    kinds = ("discovery", "persistence", "command_and_control", "impact", "execution")
    d = detections(spark, sf_dir).select("event_id", "severity", F.col("risk_score").alias("score"), F.get(F.array(*[F.lit(k) for k in kinds]), (n % 5).cast("int")).alias("category"), (n % 11 == 0).alias("gated"), F.col("client").alias("user"), F.col("agent").alias("host"), F.lit("sh").alias("parent"), F.concat("tool_name", F.lit(".exe")).alias("child"))
    return process.demote(d, admins=("C1",), hosts=("A2",), tools=("View",)).select("event_id", "risk_adjustment", "severity", "score", "informational")


@query(f"""WITH {DETECTION_SQL}, l AS (SELECT risk_score, client = 'c1' AS bad FROM d)
SELECT count(*) FILTER (risk_score >= 70 AND bad) AS tp, count(*) FILTER (risk_score >= 70 AND NOT bad) AS fp, count(*) FILTER (risk_score < 70 AND NOT bad) AS tn, count(*) FILTER (risk_score < 70 AND bad) AS fn FROM l""")
def efficacy(spark, sf_dir):
    return gold.efficacy(detections(spark, sf_dir).withColumn("malicious", F.col("client") == "c1")).select("tp", "fp", "tn", "fn")


@query(f"""WITH {DETECTION_SQL}, l AS (SELECT risk_score AS s FROM d WHERE client <> 'c1')
SELECT round(avg(CAST(s > 0 AS DOUBLE)), 6) AS above_zero, round(avg(CAST(s >= 20 AS DOUBLE)), 6) AS low, round(avg(CAST(s >= 70 AS DOUBLE)), 6) AS high FROM l""")
def benign_ladder(spark, sf_dir):
    got = gold.benign_ladder(detections(spark, sf_dir).withColumn("malicious", F.col("client") == "c1"))
    return got.select(*[F.round(c, 6).alias(c) for c in ("above_zero", "low", "high")])


@query("""WITH m AS (SELECT DISTINCT user_id AS case_id, event_type AS rule_id FROM events WHERE value > 150), x AS (SELECT user_id AS case_id, event_type AS rule_id, bool_or(value > 200) AS want FROM events GROUP BY 1, 2)
SELECT x.rule_id, count(*) FILTER (want AND m.case_id IS NOT NULL) AS tp, count(*) FILTER (NOT want AND m.case_id IS NOT NULL) AS fp, count(*) FILTER (want AND m.case_id IS NULL) AS fn, count(*) FILTER (NOT want AND m.case_id IS NULL) AS tn
FROM x LEFT JOIN m USING (case_id, rule_id) GROUP BY 1""")
def rule_confusion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("rule_id"), "value")
    want = e.groupBy("case_id", "rule_id").agg(F.when(F.bool_or(F.col("value") > 200), "present").otherwise("absent").alias("expectation"))
    return gold.rule_confusion(e.where("value > 150"), want).select("rule_id", "tp", "fp", "fn", "tn")


@query(f"""WITH {DETECTION_SQL}, x AS (SELECT unnest(rule_ids) AS rule_id, client = 'c0' AS dropped, list_contains(rule_ids, 'rule.even') AS ev FROM d)
SELECT rule_id, count(*) AS filtered, count(*) FILTER (dropped) AS in_removed_detections FROM x WHERE dropped OR rule_id = 'rule.even' GROUP BY 1""")
def policy_effect(spark, sf_dir):
    d = detections(spark, sf_dir)
    after = d.where("client <> 'c0'").withColumn("rule_ids", F.array_remove("rule_ids", "rule.even"))
    return scoring.policy_effect(d, after)


@query(f"""WITH {DETECTION_SQL} SELECT count(*) AS candidates, count(*) FILTER (client = 'c0') AS suppressed, count(*) FILTER (client <> 'c0' AND eid % 5 = 0) AS deduplicated, count(*) FILTER (client <> 'c0' AND eid % 5 <> 0) AS emitted FROM d""")
def flow_counts(spark, sf_dir):
    d = detections(spark, sf_dir).withColumns({"suppressed": F.col("client") == "c0", "duplicate": F.col("event_id").cast("long") % 5 == 0})
    return scoring.flow_counts(d).select("candidates", "suppressed", "deduplicated", "emitted")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type = 'error' AS bad, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id), false) AS before FROM events) WHERE bad AND NOT before""")
def latches(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    return gold.latches(e, ["user_id"], "event_id").select("user_id", "event_id")


@query("""SELECT user_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'""")
def stale_hosts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("timestamp"))
    return gold.stale(e, F.lit("2024-01-30 13:00:00").cast("timestamp"), "1 hour", ("user_id",)).select("user_id", F.col("last").cast("long").alias("last"))


@query("""SELECT CAST(user_id AS VARCHAR) AS client, count(*) AS sources FROM events WHERE value < 100 GROUP BY 1 HAVING bool_and(value > 0.5)""")
def source_outages(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value < 100").select(F.col("user_id").cast("string").alias("client"), (F.col("value") > 0.5).alias("failed"))
    return gold.source_outages(e).select("client", "sources")


@query("""SELECT user_id AS run_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS emitted_count, count(*) FILTER (event_type = 'error') AS scanner_error_count, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'degraded' ELSE 'ok' END AS status FROM events GROUP BY 1""")
def health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("client"), F.lit("t").alias("source_kind"), F.floor("value").cast("long").alias("emitted"), F.lit(0).cast("long").alias("suppressed"), (F.col("event_type") == "error").alias("failed"), F.lit(1).cast("long").alias("ms"))
    return gold.health(runs).select("run_id", "emitted_count", "scanner_error_count", "status")


@query("""WITH r AS (SELECT user_id AS run_id, count(*) FILTER (event_type = 'error') AS scanner_error_count, CAST(sum(floor(value)) AS BIGINT) AS ms FROM events GROUP BY 1)
SELECT run_id, concat_ws(',', CASE WHEN scanner_error_count > 15 THEN 'scanner_errors' END, CASE WHEN ms > 3500 THEN 'scan_duration' END) AS alerts FROM r WHERE scanner_error_count > 15 OR ms > 3500""")
def threshold_alerts(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count_if(F.col("event_type") == "error").alias("scanner_error_count"), F.sum(F.floor("value")).cast("long").alias("scan_duration_ms"))
    return gold.threshold_alerts(h, 15, 3500).select("run_id", JOINED("alerts").alias("alerts"))


@query(f"""WITH {DETECTION_SQL}, o AS (SELECT DISTINCT client, session_id, severity, rule_ids FROM d WHERE ts < TIMESTAMP '2024-01-10 00:00:00'), n AS (SELECT DISTINCT client, session_id, severity, rule_ids FROM d WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
SELECT client, session_id, severity, list_aggregate(rule_ids, 'string_agg', ',') AS rule_ids FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def emission_dedup(spark, sf_dir):
    d = detections(spark, sf_dir)
    fields = ("client", "session_id", "severity", "rule_ids")
    old = F.col("event_time") < F.lit("2024-01-10 00:00:00").cast("timestamp")
    seen = gold.new_only(d.where(old), d.limit(0).select(F.lit("").alias("fingerprint")), fields)
    return gold.new_only(d.where(~old), seen, fields).select("client", "session_id", "severity", JOINED("rule_ids").alias("rule_ids"))


@query(f"""WITH {DETECTION_SQL}, b AS (SELECT *, sum(octet_length(encode(event_id))) OVER (PARTITION BY session_id ORDER BY eid ROWS UNBOUNDED PRECEDING) AS c FROM d)
SELECT session_id, tool_name AS rule_id, count(*) AS omitted FROM b WHERE c > 100 GROUP BY 1, 2""")
def evidence_budget(spark, sf_dir):
    d = detections(spark, sf_dir).select(F.lit("s").alias("source_instance"), "session_id", F.col("event_id").cast("long").alias("idx"), F.col("tool_name").alias("rule_id"), F.lit("f").alias("field"), F.col("event_id").alias("redacted_value"))
    return gold.evidence_budget(d, limit=100)[1].select("session_id", "rule_id", "omitted")


@query(f"""WITH {DETECTION_SQL}, x AS (SELECT event_id, risk_score, severity FROM d UNION ALL SELECT event_id, risk_score, severity FROM d WHERE eid % 1000 = 0)
SELECT coalesce(CASE WHEN n > 1 THEN 'duplicate_id' WHEN risk_score <> 5 THEN 'score_is_not_the_sum' END, 'valid') AS verdict, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM x) GROUP BY 1""")
def event_validation(spark, sf_dir):
    d = detections(spark, sf_dir)
    d = d.unionByName(d.where(F.col("event_id").cast("long") % 1000 == 0))
    part = F.array(F.struct(F.col("tool_name").alias("id"), F.lit("rule").alias("type"), F.lit(5).cast("long").alias("points"), F.lit("").alias("rationale")))
    return gold.validated(d.withColumn("risk_contributions", part)).groupBy(F.coalesce("invalid_reason", F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DETECTION_SQL} SELECT client, session_id, row_number() OVER (PARTITION BY session_id, client ORDER BY ts, event_id) AS line_no, timestamp || '  ' || rpad('detection', 20, ' ') || '  ' || rpad(severity, 13, ' ') || '  ' || lpad(CAST(risk_score AS VARCHAR), 4, ' ') || '  ' || list_aggregate(rule_ids, 'string_agg', ',') AS line FROM d""")
def timeline_text(spark, sf_dir):
    return gold.timeline_text(detections(spark, sf_dir)).select("client", "session_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH {DETECTION_SQL} SELECT event_id, '{{"index":{{"_index":"session-events","_id":"' || event_id || '"}}}}' AS action FROM d""")
def elastic_bulk(spark, sf_dir):
    v = writers.to_elastic_bulk(detections(spark, sf_dir).select("event_id", "severity"))
    return v.select(F.regexp_extract("value", r'"_id":"(\d+)"', 1).alias("event_id"), F.substring_index("value", "\n", 1).alias("action"))


@query(f"""WITH {DETECTION_SQL} SELECT '{{"event_id":"' || event_id || '","severity":"' || severity || '","risk_score":' || risk_score || ',"rule_ids":["' || list_aggregate(rule_ids, 'string_agg', '","') || '"]}}' AS value FROM d""")
def jsonl_lines(spark, sf_dir):
    return writers.to_jsonl(detections(spark, sf_dir).select("event_id", "severity", "risk_score", "rule_ids", F.lit(None).cast("string").alias("gone")))


@query(f"""WITH {DETECTION_SQL} SELECT event_id, sec FROM d""")
def hec_envelopes(spark, sf_dir):
    v = writers.to_hec(detections(spark, sf_dir).select("event_id", "timestamp", "event_time"), "h", "i")
    return v.select(F.get_json_object("value", "$.event.event_id").alias("event_id"), F.floor(F.get_json_object("value", "$.time").cast("double")).cast("long").alias("sec"))


@query("""WITH c AS (SELECT p_brand, p_type AS value, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 3""")
def top_three(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.array("p_type").alias("types"))
    return gold.top_values(p, "types", ["p_brand"])
