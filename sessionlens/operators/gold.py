"""Events and reports: assembly, allowlists, summaries, timelines, coverage, efficacy, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.activity import format_time, response, severity, severity_rank
from sessionlens.operators.scoring import sendable, sorted_set
from sessionlens.operators.sequences import call_links, timeline_index
from sessionlens.schemas import CONTRIBUTION, EVENT_TYPES, EVENTS, SEVERITIES, struct

NONE = "array<string>"
LABELS = ("rule_ids", "categories", "detection_classes", "signal_types", "analytic_intents", "atlas_tags")
EVIDENCE_BYTES = 1_048_576
"""Evidence kept of a session, in bytes."""


def as_events(df: DataFrame) -> DataFrame:
    """``df`` in the full event schema: columns that it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in struct(EVENTS)])


def event_id(kind: str, *parts) -> Column:
    """A hash of what the event is about, so that a retry gives the same id."""
    return F.concat(F.lit("evt:"), F.sha2(F.concat_ws("\u0001", F.lit(kind), *[F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for p in parts]), 256))


def detection_events(scores: DataFrame, rules: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Detection events from session scores; ``sessions`` may add client, agent, model, provider, event_time by a unique (source_instance, session_id).

    Labels of the rules are gathered from their table by rule id.
    """
    meta = sendable(rules.select("rule_id", "detection_class", "signal_type", "analytic_intent", "atlas_tags", "tags"))
    keys = ["source_instance", "session_id"]
    labels = scores.select(*keys, F.explode("rule_ids").alias("rule_id")).join(meta, "rule_id").groupBy(*keys).agg(
        sorted_set("detection_class").alias("detection_classes"), sorted_set("signal_type").alias("signal_types"), sorted_set("analytic_intent").alias("analytic_intents"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("atlas_tags", F.array().cast(NONE)))))).alias("atlas_tags"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast(NONE)))))).alias("tags"))
    df = scores.join(labels, keys, "left")
    if sessions is not None:
        unique = sessions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in sessions.columns if c not in keys]).where("_n = 1").drop("_n")
        df = df.join(unique, keys, "left")
    df = df.withColumns({"event_type": F.lit("detection"), "schema_version": F.lit("3.0"), "informational": F.lit(False), "response": response(F.col("severity"), F.col("rule_ids"), F.col("categories"), F.col("risk_score") >= 70)})
    df = df.withColumn("event_id", event_id("detection", "source_instance", "session_id", "rule_ids"))
    if "event_time" in df.columns:
        df = df.withColumn("timestamp", format_time(F.col("event_time")))
    return as_events(df)


def process_events(found: DataFrame) -> DataFrame:
    """Process-chain events, also those with a score of zero."""
    df = found.withColumns({
        "event_type": F.lit("process_chain"), "schema_version": F.lit("3.0"), "risk_score": F.col("score").cast("long"), "rule_ids": F.array("rule_id"), "categories": F.array("category"), "mitre_attack_techniques": F.col("mitre"),
        "process": F.struct("parent", "child", "command_line", "parent_inferred", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("user")), "response": response(F.col("severity"), F.array("rule_id"), F.array("category"), F.col("score") >= 70)})
    return as_events(df.withColumn("event_id", event_id("process_chain", "observation_id", "rule_id", "statement_no" if "statement_no" in found.columns else "rule_id")))


def activity_events(accounts: DataFrame, usage: DataFrame, keys=("source_instance", "session_id")) -> DataFrame:
    """One activity event for each session: record counts as evidence, up to ten sorted tool names as tags."""
    tools = usage.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set("tool_name")), 1, 10).alias("tags"), F.min_by("tool_name", "first_order").alias("tool_name"))
    kinds = [c for c in accounts.columns if c not in keys]
    counts = F.to_json(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))]))
    df = accounts.join(tools, list(keys), "left").withColumns({"event_type": F.lit("activity"), "schema_version": F.lit("3.0"), "severity": F.lit("informational"), "risk_score": F.lit(0).cast("long"), "informational": F.lit(True)})
    ev = F.array(F.struct(F.lit("record_counts").alias("field"), counts.alias("redacted_value"), F.sha2(counts, 256).alias("hash"), F.lit(None).cast("string").alias("rule_id")))
    return as_events(df.withColumns({"evidence": ev, "event_id": event_id("activity", *keys)}))


def mcp_events(inventory: DataFrame) -> DataFrame:
    """Inventory events of configured servers; a row with an error becomes an inventory_error event."""
    bad = F.col("error").isNotNull() if "error" in inventory.columns else F.lit(False)
    df = inventory.withColumns({"event_type": F.when(bad, "inventory_error").otherwise("mcp_inventory"), "schema_version": F.lit("3.0"), "severity": F.lit("informational"), "risk_score": F.lit(0).cast("long"), "informational": F.lit(True), "tool_name": F.col("server"), "tags": F.col("declared_tools")})
    return as_events(df.withColumn("event_id", event_id("mcp_inventory", "client", "server")))


def correlation_events(found: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Correlation events; evidence names each related detection."""
    ev = F.transform("related_event_ids", lambda e: F.struct(F.lit("related_event_id").alias("field"), e.alias("redacted_value"), F.sha2(e, 256).alias("hash"), F.lit(None).cast("string").alias("rule_id")))
    df = found.withColumns({"event_type": F.lit("correlation"), "schema_version": F.lit("3.0"), "severity": F.when(F.col("risk_score") >= 90, "critical").otherwise("high"), "event_time": F.col("window_end"), "timestamp": format_time(F.col("window_end")), "evidence": ev})
    return as_events(df.withColumn("event_id", event_id("correlation", "client", "agent", "model", "provider", "session_ids", "rule_ids")))


def in_order(correlations: DataFrame) -> DataFrame:
    """Correlations in their order of output: by start of the window, actor, then rules."""
    return correlations.orderBy("window_start", "client", "agent", "model", "provider", "rule_ids")


def all_events(activities: DataFrame, detections: DataFrame, summaries: DataFrame) -> DataFrame:
    """Activities, detections and session summaries as one table in the event schema; ``part`` keeps their order: 0, 1, 2."""
    parts = [as_events(df).withColumn("part", F.lit(n)) for n, df in enumerate((activities, detections, summaries))]
    return reduce(DataFrame.unionByName, parts)


def allowlisted(events: DataFrame, allowlist: DataFrame, most: int = 5000) -> DataFrame:
    """Detections that an allowlist entry names become informational: score 0, no contributions, anchors or response, tagged, with the entry as evidence.

    An entry names an event when each criterion it fills holds one of the event's values; an entry without criteria names none. The first by ``ord`` wins.
    The list is a dimension of at most ``most`` entries, checked before it is broadcast.
    """
    if allowlist.limit(most + 1).count() > most:
        raise ValueError(f"over {most} allowlist entries can't be broadcast")
    names = ("clients", "session_ids", "tool_names", "rule_ids", "categories", "source_path_hashes")
    a = allowlist.select("ord", F.col("name").alias("_name"), *[F.coalesce(c, F.array().cast(NONE)).alias(f"_{c}") for c in names])
    filled = reduce(lambda x, y: x + y, [F.size(f"_{c}") for c in names])
    values = {"clients": F.array("client"), "session_ids": F.array("session_id"), "tool_names": F.array("tool_name"), "rule_ids": F.col("rule_ids"), "categories": F.col("categories"), "source_path_hashes": F.array("source_path_hash")}
    meets = filled > 0
    for c in names:
        meets = meets & ((F.size(f"_{c}") == 0) | F.coalesce(F.arrays_overlap(f"_{c}", values[c]), F.lit(False)))
    # rows are told apart by a key of their own, so null and repeated event ids are judged row by row
    keyed = events.withColumn("_row", F.monotonically_increasing_id())
    hits = F.when(F.col("event_type") == "detection", F.struct("ord", "_name"))
    joined = keyed.join(F.broadcast(a), (F.col("event_type") == "detection") & meets, "left")
    first = joined.withColumn("_n", F.row_number().over(W.partitionBy("_row").orderBy(F.asc_nulls_last("ord")))).where("_n = 1")
    df = first.withColumn("_entry", hits["_name"])
    on = F.col("_entry").isNotNull()
    note = F.struct(F.lit("allowlist").alias("field"), F.col("_entry").alias("redacted_value"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("rule_id"))
    kind = {f.name: f.dataType for f in events.schema}
    change = {"severity": F.lit("informational"), "risk_score": F.lit(0).cast("long"), "informational": F.lit(True)}
    change |= {c: F.lit(None).cast(kind[c]) for c in ("risk_contributions", "timeline_anchors", "response") if c in kind}
    if "tags" in kind:
        change["tags"] = F.array_union(F.coalesce("tags", F.array().cast(NONE)), F.array(F.lit("suppressed"), F.concat(F.lit("allowlist:"), F.col("_entry"))))
    if "evidence" in kind:
        change["evidence"] = F.concat(F.coalesce("evidence", F.array().cast(kind["evidence"])), F.array(note))
    return df.withColumns({c: F.when(on, v).otherwise(F.col(c)) if c in kind else F.when(on, v) for c, v in change.items()}).drop("_row", "_n", "_entry", "ord", "_name", *[f"_{c}" for c in names])


SUMMARY_KEYS = ("client", "source_path_hash", "session_id")


def _summarised(events: DataFrame) -> DataFrame:
    """The events that a session's summary is made of: activities and detections, but not the scanner's own."""
    return events.where(F.col("event_type").isin("activity", "detection") & ~F.coalesce(F.col("session_id") == "scanner", F.lit(False)))


def summary_problems(events: DataFrame, keys=SUMMARY_KEYS) -> DataFrame:
    """(keys…, problem): sessions whose events don't add up, which get no summary.

    ``score_is_not_the_sum``: an event with contributions, or of schema 2.0, declares another score than their sum.
    ``conflicting_contribution``: two events give one (type, id) unlike points or rationale.
    """
    own = _summarised(events)
    parts = F.coalesce("risk_contributions", F.array().cast(f"array<{CONTRIBUTION}>"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, c: acc + c["points"])
    declared = (F.size(parts) > 0) | F.coalesce(F.col("schema_version") == "2.0", F.lit(False))
    wrong = own.where(declared & (F.coalesce("risk_score", F.lit(0)) != total)).select(*keys, F.lit("score_is_not_the_sum").alias("problem"))
    said = own.select(*keys, F.explode(parts).alias("c")).groupBy(*keys, "c.type", "c.id").agg(F.min(F.struct("c.points", "c.rationale")).alias("low"), F.max(F.struct("c.points", "c.rationale")).alias("high"))
    return wrong.unionByName(said.where(~F.col("low").eqNullSafe(F.col("high"))).select(*keys, F.lit("conflicting_contribution").alias("problem"))).distinct()


def session_risk_summary(events: DataFrame, keys=SUMMARY_KEYS) -> DataFrame:
    """One summary event's facts for each session: the union of its events' contributions and their sum, severity, last time, counts.

    A contribution counts once for a session, by type and id, however many events name it. Label sets and rule ids are those of
    detections; ``tool_calls`` is what the first activity's evidence counts. ``events`` and ``n_…`` count activities and
    detections. Sessions in :func:`summary_problems` are left out.
    """
    keys = list(keys)
    bad = summary_problems(events, keys).select(*keys).distinct()
    own = _summarised(events).withColumn("_key", F.struct(*keys))
    own = own.join(bad.select(F.struct(*keys).alias("_bad")), F.col("_key").eqNullSafe(F.col("_bad")), "left_anti")
    kind = dict(own.dtypes)
    detection, activity_ = F.col("event_type") == "detection", F.col("event_type") == "activity"
    order = F.struct("event_time", "event_id") if "event_time" in kind else F.struct("timestamp", "event_id")
    shown = F.get(F.filter("evidence", lambda e: e["field"] == "record_counts"), F.lit(0))["redacted_value"] if "evidence" in kind else F.lit(None).cast("string")
    calls = F.get_json_object(shown, "$.tool_call").try_cast("long")
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(detection, F.col(c)))))).alias(c) for c in LABELS if c in kind]
    last = [F.max(c).alias(c) for c in ("timestamp", "event_time") if c in kind]
    out = own.groupBy("_key").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(activity_).alias("n_activity"), F.count_if(detection).alias("n_detection"),
        F.min_by(calls, F.when(activity_ & calls.isNotNull(), order)).alias("tool_calls"), *last, *sets)
    parts = own.select("_key", F.explode("risk_contributions").alias("c")).groupBy("_key", "c.type", "c.id").agg(F.min(F.struct("c.points", "c.rationale")).alias("v"))
    parts = parts.groupBy("_key").agg(F.sum("v.points").alias("_sum"), F.array_sort(F.collect_list(F.struct("id", "type", "v.points", "v.rationale"))).alias("_parts"))
    both = out.join(parts.withColumnRenamed("_key", "_own"), F.col("_key").eqNullSafe(F.col("_own")), "left")
    score = F.coalesce("_sum", F.lit(0)).cast("long")
    tags = F.array_sort(F.array_compact(F.array(F.lit("risk_summary"), F.lit("session"), F.when(F.col("n_detection") > 0, "risky_action"), F.when(F.col("n_activity") > 0, "activity"))))
    return both.withColumns({"risk_score": score, "severity": severity(score), "risk_contributions": F.coalesce("_parts", F.array().cast(f"array<{CONTRIBUTION}>")), "tags": tags}).select(*[F.col("_key").getField(k).alias(k) for k in keys], *[c for c in both.columns if c not in ("_key", "_own", "_sum", "_parts")], "risk_score", "severity", "risk_contributions", "tags")


def event_summary(events: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by event type, severity, client and rule, in one long table."""
    rows = F.concat(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in ("event_type", "severity", "client")]),
        F.transform(F.array_distinct(F.coalesce("rule_ids", F.array().cast(NONE))), lambda r: F.struct(F.lit("rule_id").alias("dimension"), r.alias("value"))))
    return events.select(F.explode(rows).alias("r")).where("r.value is not null").groupBy("r.dimension", "r.value").agg(F.count(F.lit(1)).alias("n")).select("dimension", "value", "n")


def top_values(events: DataFrame, column: str, keys: list[str], n: int = 3) -> DataFrame:
    """The ``n`` most frequent values of an array column for each key, by count, then value."""
    counts = events.select(*keys, F.explode(column).alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)


def timeline_summary(events: DataFrame, keys=("session_id", "client")) -> DataFrame:
    """One row for each session: detections, highest severity, and its three most frequent rules and categories."""
    keys = list(keys)
    top = lambda c, name: top_values(events, c, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias(name))
    base = events.groupBy(*keys).agg(F.count_if(F.col("event_type") == "detection").alias("detections"), F.max_by("severity", severity_rank(F.col("severity"))).alias("max_severity"))
    return base.join(top("rule_ids", "top_rules"), keys, "left").join(top("categories", "top_categories"), keys, "left")


def observation_timeline(obs: DataFrame) -> DataFrame:
    """Content-free timeline of each session: index, time, kind, tool, call id and the place of the linked result."""
    from sessionlens.functions.activity import record_kind

    rows = timeline_index(obs)
    links = call_links(obs).select(F.col("call_observation").alias("observation_id"), F.col("result_observation").alias("linked_observation"))
    return rows.join(links, "observation_id", "left").select("source_instance", "session_id", "idx", "observation_id", "occurred_at", record_kind(F.col("family"), F.col("stage"), F.col("role")).alias("kind"), "tool_name", "call_id", "linked_observation")


def timeline_anchors(matches: DataFrame, obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Anchors of each session: one for each matched observation with its rules, categories and fields, in order."""
    at = timeline_index(obs).select("source_instance", "session_id", "observation_id", F.col("idx").alias("entry_index"))
    per = matches.join(sendable(rules.select("rule_id", "category")), "rule_id").join(at, ["source_instance", "session_id", "observation_id"]).groupBy("source_instance", "session_id", "entry_index").agg(sorted_set("rule_id").alias("rule_ids"), sorted_set("category").alias("categories"), sorted_set("field").alias("evidence_fields"))
    return per.groupBy("source_instance", "session_id").agg(F.array_sort(F.collect_list(F.struct("entry_index", "rule_ids", "categories", "evidence_fields"))).alias("timeline_anchors"))


def event_timeline(events: DataFrame) -> DataFrame:
    """Timeline of each (session, client) from events, unreadable times first, with its summary."""
    order = W.partitionBy("session_id", "client").orderBy(F.asc_nulls_first("event_time"), "event_id")
    rows = events.withColumn("idx", F.row_number().over(order) - 1)
    lines = rows.groupBy("session_id", "client").agg(F.array_sort(F.collect_list(F.struct("idx", "timestamp", "event_type", "severity", "rule_ids"))).alias("entries"))
    return lines.join(timeline_summary(events), ["session_id", "client"])


def timeline_text(events: DataFrame) -> DataFrame:
    """(session_id, client, line_no, line): the timeline as text."""
    order = W.partitionBy("session_id", "client").orderBy(F.asc_nulls_first("event_time"), "event_id")
    line = F.concat_ws("  ", F.coalesce("timestamp", F.lit("-")), F.rpad("event_type", 20, " "), F.rpad(F.coalesce("severity", F.lit("")), 13, " "), F.lpad(F.coalesce(F.col("risk_score").cast("string"), F.lit("0")), 4, " "), F.array_join("rule_ids", ","))
    return events.select("session_id", "client", F.row_number().over(order).alias("line_no"), F.rtrim(line).alias("line"))


def evidence_budget(rows: DataFrame, keys=("source_instance", "session_id"), limit: int = EVIDENCE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted): the earliest evidence up to ``limit`` bytes of each session, and how much of each rule was left out."""
    order = W.partitionBy(*keys).orderBy("idx", "rule_id", "field").rowsBetween(W.unboundedPreceding, 0)
    sized = rows.withColumn("_bytes", F.sum(F.octet_length("redacted_value")).over(order))
    return sized.where(F.col("_bytes") <= limit).drop("_bytes"), sized.where(F.col("_bytes") > limit).groupBy(*keys, "rule_id").agg(F.count(F.lit(1)).alias("omitted"))


def validated(events: DataFrame) -> DataFrame:
    """``events`` with valid and invalid_reason: unique ids, known types and severities, the score equal to its contributions' sum, rule-backed contributions listed."""
    total = F.aggregate(F.coalesce("risk_contributions", F.array().cast("array<struct<id:string,type:string,points:long,rationale:string>>")), F.lit(0).cast("long"), lambda a, c: a + c["points"])
    listed = F.forall(F.coalesce("risk_contributions", F.array().cast("array<struct<id:string,type:string,points:long,rationale:string>>")), lambda c: (c["type"] != "rule") | F.array_contains(F.coalesce("rule_ids", F.array().cast(NONE)), c["id"]))
    reason = (
        F.when(F.col("event_id").isNull(), "missing_id").when(F.count(F.lit(1)).over(W.partitionBy("event_id")) > 1, "duplicate_id").when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "unknown_type")
        .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "unknown_severity").when(F.col("risk_contributions").isNotNull() & (F.coalesce("risk_score", F.lit(0)) != total), "score_is_not_the_sum").when(~listed, "unlisted_rule"))
    return events.withColumn("invalid_reason", reason).withColumn("valid", F.col("invalid_reason").isNull())


def rule_catalogue(rules: DataFrame, chains: DataFrame) -> DataFrame:
    """One row for each rule or chain with its metadata and score."""
    r = rules.select(F.col("rule_id").alias("id"), F.lit("rule").alias("kind"), "category", "severity", "score", "explanation", F.coalesce("status", F.lit("stable")).alias("status"))
    c = chains.select("id", F.lit("chain").alias("kind"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("severity"), "score", "explanation", F.lit("stable").alias("status"))
    return r.unionByName(c)


def rule_coverage(rules: DataFrame, matches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of each rule: sessions and clients with a match, and matched sources that are labelled benign. ``sessions`` has session_id, client, benign."""
    hits = matches.select("rule_id", "session_id").distinct().join(sessions, "session_id")
    per = hits.groupBy("rule_id").agg(F.countDistinct("session_id").alias("sessions"), F.array_sort(F.collect_set("client")).alias("clients"), F.count_if("benign").alias("benign_sources"))
    return rules.select("rule_id").join(per, "rule_id", "left").na.fill(0, ["sessions", "benign_sources"])


def efficacy(scored: DataFrame, threshold: int = 70, score: str = "risk_score", label: str = "malicious") -> DataFrame:
    """One row: true and false positives and negatives at a threshold, precision and recall. Rows without a label don't count."""
    up = F.coalesce(F.col(score), F.lit(0)) >= threshold
    n = scored.where(F.col(label).isNotNull()).agg(F.count_if(up & F.col(label)).alias("tp"), F.count_if(up & ~F.col(label)).alias("fp"), F.count_if(~up & ~F.col(label)).alias("tn"), F.count_if(~up & F.col(label)).alias("fn"))
    return n.select("*", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def benign_ladder(scored: DataFrame, score: str = "risk_score", label: str = "malicious") -> DataFrame:
    """One row: share of benign cases above 0 and at each severity or more."""
    s = F.coalesce(F.col(score), F.lit(0))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return scored.where(~F.col(label)).agg(share(s > 0).alias("above_zero"), share(s >= 20).alias("low"), share(s >= 50).alias("medium"), share(s >= 70).alias("high"), share(s >= 90).alias("critical"))


def rule_confusion(matches: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per rule tp, fp, fn, tn and not scored, of expectations (case_id, rule_id, expectation) against matches (case_id, rule_id)."""
    seen = matches.select("case_id", "rule_id").distinct().withColumn("hit", F.lit(True))
    df = expectations.join(seen, ["case_id", "rule_id"], "full_outer").withColumns({"hit": F.coalesce("hit", F.lit(False)), "expectation": F.coalesce("expectation", F.lit("absent"))})
    want, no = F.col("expectation") == "present", F.col("expectation") == "absent"
    return df.groupBy("rule_id").agg(F.count_if(want & F.col("hit")).alias("tp"), F.count_if(no & F.col("hit")).alias("fp"), F.count_if(want & ~F.col("hit")).alias("fn"), F.count_if(no & ~F.col("hit")).alias("tn"), F.count_if(~want & ~no).alias("not_scored"))


def source_outages(results: DataFrame) -> DataFrame:
    """Clients of which every selected source failed."""
    return results.groupBy("client").agg(F.count(F.lit(1)).alias("sources"), F.bool_and("failed").alias("outage")).where("outage")


def threshold_alerts(health: DataFrame, most_errors: int = 10, most_ms: int = 60_000) -> DataFrame:
    """Runs with too many errors or too long a scan, and why."""
    why = F.array_compact(F.array(F.when(F.col("scanner_error_count") > most_errors, "scanner_errors"), F.when(F.col("scan_duration_ms") > most_ms, "scan_duration")))
    return health.withColumn("alerts", why).where(F.size("alerts") > 0)


def health(runs: DataFrame) -> DataFrame:
    """One row for each run: sources by client and kind, emitted, suppressed, errors, duration."""
    by = runs.groupBy("run_id", F.concat_ws(".", "client", "source_kind").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("source_counts"))
    total = runs.groupBy("run_id").agg(F.sum("emitted").alias("emitted_count"), F.sum("suppressed").alias("suppressed_count"), F.count_if("failed").alias("scanner_error_count"), F.sum("ms").alias("scan_duration_ms"))
    return by.join(total, "run_id").withColumn("status", F.when(F.col("scanner_error_count") > 0, "degraded").otherwise("ok"))


def investigate(events: DataFrame, obs: DataFrame) -> DataFrame:
    """For each event the content-free timeline of its session; ``reason`` says why there is none."""
    lines = observation_timeline(obs).join(obs.select("observation_id", "source_path_hash"), "observation_id").groupBy("source_path_hash", "session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "tool_name", "occurred_at"))).alias("timeline"))
    df = events.select("event_id", "source_path_hash", "session_id").join(lines, ["source_path_hash", "session_id"], "left")
    return df.withColumn("reason", F.when(F.col("session_id").isNull(), "event_has_no_session").when(F.col("source_path_hash").isNull(), "event_has_no_source").when(F.col("timeline").isNull(), "session_not_found"))


def action_records(findings: DataFrame) -> DataFrame:
    """Action findings with finding_id and delivery_key, hashes of what they say."""
    return findings.withColumns({
        "finding_id": F.concat(F.lit("fnd:"), F.sha2(F.concat_ws("\u0001", "source_instance", F.coalesce("session_id", F.lit("")), "observation_id"), 256)),
        "delivery_key": F.sha2(F.concat_ws("\u0001", "source_instance", "observation_id", F.array_join("rule_ids", ","), F.array_join("chain_ids", ","), F.col("points").cast("string")), 256)})


def new_only(events: DataFrame, seen: DataFrame, fields: tuple[str, ...] = ("client", "session_id", "event_type", "severity", "rule_ids", "detection_classes"), backfill: bool = False) -> DataFrame:
    """Events whose fingerprint over ``fields`` is not in ``seen`` (fingerprint), once each; ``backfill`` lets all through."""
    df = events.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*fields)), 256))
    return df if backfill else df.join(seen.select("fingerprint").distinct(), "fingerprint", "left_anti").dropDuplicates(["fingerprint"])


SUMMARY_FIELDS = ("client", "session_id", "event_type", "severity", "risk_score", "rule_ids")
"""What makes two session summaries the same: neither evidence nor time."""


def new_summaries(summaries: DataFrame, seen: DataFrame, backfill: bool = False) -> DataFrame:
    """Session summaries that say something new: unlike any in ``seen`` in SUMMARY_FIELDS, whatever their evidence and time."""
    return new_only(summaries, seen, SUMMARY_FIELDS, backfill)


def latches(states: DataFrame, keys: list[str], order: str, bad: str = "bad") -> DataFrame:
    """Rows that enter a bad state; the next good row re-arms the latch."""
    before = F.lag(bad).over(W.partitionBy(*keys).orderBy(order))
    return states.withColumn("_before", F.coalesce(before, F.lit(False))).where(F.col(bad) & ~F.col("_before")).drop("_before")


def stale(health_rows: DataFrame, now: Column, interval: str = "5 minutes", keys=("host",)) -> DataFrame:
    """Keys whose last health row is older than ``interval``: they need a heartbeat."""
    return health_rows.groupBy(*keys).agg(F.max("timestamp").alias("last")).where(now - F.expr(f"interval {interval}") > F.col("last"))
