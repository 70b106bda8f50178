"""Session and action scores: distinct rules, chains, ledgers, severities, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.activity import BANDS, severity, severity_rank

SESSION = ["source_instance", "session_id"]
#: The bundled chain of a download that is run, with its steps, and what it adds to an action.
LINKED_CHAIN, LINKED_STEPS, LINKED_SCORE = "chain.download_then_execute", ["download", "execution"], 50
OUTCOMES = ("error", "match", "not_evaluated", "no_match", "not_applicable")
"""Detector outcomes of a session, strongest first."""


def session_key() -> Column:
    """A session's id, or the observation's own id where it has none: then it is a session of its own."""
    return F.coalesce("session_id", "observation_id")


def sorted_set(col) -> Column:
    return F.array_sort(F.collect_set(col))


def sendable(rules: DataFrame, most: int = 5000) -> DataFrame:
    """A table of rules with a hint to broadcast it, if it has no more than ``most`` rows; beyond that it is joined by shuffle."""
    return F.broadcast(rules) if rules.limit(most + 1).count() <= most else rules


def score_table(rules: DataFrame) -> DataFrame:
    return sendable(rules.select("rule_id", "category", F.col("score").alias("points"), "severity"))


def chain_table(chains: DataFrame, most: int = 2000) -> DataFrame:
    """``chains``, after a check that they are few enough to be broadcast."""
    if chains.limit(most + 1).count() > most:
        raise ValueError(f"over {most} chains can't be broadcast")
    return chains


def chain_met(rule_ids: Column, categories: Column) -> Column:
    """True if the rules and categories of a group hold all that a chain asks for, which is something."""
    none = F.array().cast("array<string>")
    cats, rules = F.coalesce("when_all_categories", none), F.coalesce("when_all_rule_ids", none)
    return (F.size(F.array_except(cats, categories)) == 0) & (F.size(F.array_except(rules, rule_ids)) == 0) & (F.size(cats) + F.size(rules) > 0)


def apply_chains(hits: DataFrame, chains: DataFrame, keys: list[str] = SESSION, most_chains: int = 2000) -> DataFrame:
    """(keys…, chain_id, points): chains whose categories and rules all occur in a group. ``hits`` has rule_id and category.

    Chains are a dimension of at most ``most_chains`` rows, which is checked before it is broadcast.
    """
    have = hits.groupBy(*keys).agg(F.collect_set("rule_id").alias("_rules"), F.collect_set("category").alias("_cats"))
    listed = F.broadcast(chain_table(chains, most_chains))
    return have.join(listed, chain_met(F.col("_rules"), F.col("_cats"))).select(*keys, F.col("id").alias("chain_id"), F.col("score").alias("points"))


def risk_ledger(contributions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ledger, conflicts) of rows (keys…, type, id, points): each (type, id) counts once for a key; unlike points conflict.

    Sums are checked: under ANSI an overflow is an error.
    """
    per = contributions.groupBy(*keys, "type", "id").agg(F.min("points").alias("points"), F.max("points").alias("_most"))
    conflicts = per.where("points <> _most").select(*keys, "type", "id")
    ledger = per.where("points = _most").groupBy(*keys).agg(
        F.sum("points").alias("risk_score"), F.array_sort(F.collect_list(F.struct("type", "id", "points"))).alias("risk_contributions"))
    return ledger, conflicts


def score_sessions(matches: DataFrame, rules: DataFrame, chains: DataFrame | None = None, keys: list[str] = SESSION, armed: DataFrame | None = None, linked: tuple[str, ...] = (), bands: tuple = BANDS) -> DataFrame:
    """One row for each group: rule_ids, categories, chain_ids, risk_score and severity.

    A rule counts once however many observations match it. Chains named in ``linked`` count only in groups that ``armed`` lists.
    Rules and matches meet on rule_id after matches are distinct, so the join carries one row for a rule and group.
    """
    hits = matches.select(*keys, "rule_id").distinct().join(score_table(rules), "rule_id")
    out = hits.groupBy(*keys).agg(F.sum("points").alias("risk_score"), sorted_set("rule_id").alias("rule_ids"), sorted_set("category").alias("categories"))
    if chains is None:
        out = out.withColumn("chain_ids", F.array().cast("array<string>"))
    else:
        # chains are tested on the group's own row, so the matches are read and shuffled once
        if linked and armed is not None:
            out = out.join(armed.select(*keys).distinct().withColumn("_armed", F.lit(True)), keys, "left")
        else:
            out = out.withColumn("_armed", F.lit(False))
        counts = ~F.col("_chain").isin(*linked) | F.coalesce("_armed", F.lit(False)) if linked else F.lit(True)
        listed = chain_table(chains).select(F.col("id").alias("_chain"), F.col("score").alias("_points"), "when_all_categories", "when_all_rule_ids")
        met = chain_met(F.col("rule_ids"), F.col("categories")) & counts
        out = out.join(F.broadcast(listed), met, "left").groupBy(*keys).agg(
            (F.first("risk_score") + F.coalesce(F.sum("_points"), F.lit(0))).alias("risk_score"), F.first("rule_ids").alias("rule_ids"), F.first("categories").alias("categories"), sorted_set("_chain").alias("chain_ids"))
    return out.withColumn("severity", severity(F.col("risk_score"), bands))


def detector_outcomes(results: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys…, detector_id, status, reason): the strongest outcome and the counts of each, and of each reason."""
    rank = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("status"))
    reasons = results.where("reason is not null").groupBy(*keys, "detector_id", "reason").count().groupBy(*keys, "detector_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reasons"))
    counts = results.groupBy(*keys, "detector_id").agg(F.min_by("status", rank).alias("outcome"), *[F.count_if(F.col("status") == o).alias(f"n_{o}") for o in OUTCOMES])
    return counts.join(reasons, [*keys, "detector_id"], "left")


def visibility(obs: DataFrame, outcomes: DataFrame | None = None, keys: list[str] = SESSION) -> DataFrame:
    """(keys…, limits): why a session may hide something: unverified source, no session id, missing times or capabilities, unevaluated detectors."""
    lacks = lambda name: F.bool_or(F.coalesce(F.try_element_at(F.col("caps"), F.lit(name)) != "supported", F.lit(True)))
    flags = obs.groupBy(*keys).agg(
        F.bool_or(F.col("source_instance").isNull()).alias("unverified_source"), F.bool_or(F.col("session_id").isNull()).alias("missing_session"), F.bool_or(F.col("occurred_at").isNull()).alias("missing_time"),
        lacks("tool_call").alias("no_tool_call"), lacks("tool_execution").alias("no_tool_execution"), lacks("user_context").alias("no_user_context"))
    names = ["unverified_source", "missing_session", "missing_time", "no_tool_call", "no_tool_execution", "no_user_context"]
    if outcomes is not None:
        flags = flags.join(outcomes.groupBy(*keys).agg(F.bool_or(F.col("n_not_evaluated") > 0).alias("not_evaluated")), keys, "left")
        names.append("not_evaluated")
    return flags.select(*keys, F.array_compact(F.array(*[F.when(F.col(n), n) for n in names])).alias("limits"))


def same_action_chains(matches: DataFrame, chains: DataFrame) -> DataFrame:
    """Chains of rule ids that all match one observation."""
    only = chains.where((F.size(F.coalesce("when_all_rule_ids", F.array().cast("array<string>"))) > 0) & F.col("link").isNull())
    return apply_chains(matches.select("source_instance", "session_id", "observation_id", "rule_id", F.lit("").alias("category")).distinct(), only, ["source_instance", "session_id", "observation_id"])


def linked_score(chain: tuple, bundled: tuple | None, chosen: int | None = None) -> int:
    """What a chain of a download and its run is worth on an action: what the caller chose, LINKED_SCORE if it is as bundled, else its own score."""
    if chosen is not None:
        return chosen
    return LINKED_SCORE if bundled is not None and tuple(chain[:4]) == tuple(bundled[:4]) else chain[1]


def linked_actions(links: DataFrame, chain_rows, bundled_rows=None, chosen: int | None = None, piped: DataFrame | None = None) -> DataFrame:
    """(source_instance, session_id, observation_id, chain_id, points): runs of downloaded files that complete the chain of a download and its run.

    ``links`` is :func:`~sessionlens.operators.sequences.download_execute`; ``piped`` may add observations that run what they fetch.
    The chain counts only as it is meant: by these two categories and no rules. A run counts once, however many downloads lead to it.
    """
    keys = ["source_instance", "session_id"]
    ends = links.select(*keys, F.col("execution").alias("observation_id"))
    if piped is not None:
        ends = ends.unionByName(piped.select(*keys, "observation_id"))
    bundled = {c[0]: c for c in bundled_rows or chain_rows}
    chain = next((c for c in chain_rows if c[0] == LINKED_CHAIN and list(c[2] or ()) == LINKED_STEPS and not c[3]), None)
    if chain is None:
        return ends.limit(0).withColumns({"chain_id": F.lit(""), "points": F.lit(0).cast("long")})
    points = linked_score(chain, bundled.get(chain[0]), chosen)
    return ends.distinct().withColumns({"chain_id": F.lit(chain[0]), "points": F.lit(points).cast("long")})


def action_findings(matches: DataFrame, rules: DataFrame, chain_rows: DataFrame | None = None) -> DataFrame:
    """One row for each observation with a match or a chain that ends there: rules, chains, points, severity, kind and categories.

    ``chain_rows`` has source_instance, session_id, observation_id, chain_id and points. The kind is correlation if any chain is present.
    """
    keys = ["source_instance", "session_id", "observation_id"]
    hits = matches.select(*keys, "rule_id").distinct().join(score_table(rules), "rule_id")
    parts = hits.select(*keys, "rule_id", F.lit(None).cast("string").alias("chain_id"), "points", "severity", "category")
    if chain_rows is not None:
        parts = parts.unionByName(chain_rows.select(*keys, F.lit(None).cast("string").alias("rule_id"), "chain_id", "points", F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("category")).distinct())
    out = parts.groupBy(*keys).agg(
        F.sum("points").alias("points"), sorted_set("rule_id").alias("rule_ids"), sorted_set("chain_id").alias("chain_ids"), sorted_set("category").alias("categories"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("rule_severity"))
    return out.withColumns({"kind": F.when(F.size("chain_ids") > 0, "correlation").otherwise("atomic"), "severity": severity(F.col("points"))})


def replay_ids(obs: DataFrame) -> DataFrame:
    """``obs`` with ``replay_id``, a hash of what a record says, null where two records of a source say the same."""
    fields = F.to_json(F.struct("client", "family", "stage", "occurred_at_raw", "call_id", "role", "text", "tool_name", "command", "arguments", "tool_result"))
    key = F.concat(F.lit("replay:"), F.sha2(fields, 256))
    return obs.withColumn("_replay", key).withColumn("replay_id", F.when(F.count(F.lit(1)).over(W.partitionBy("source_instance", "_replay")) == 1, F.col("_replay"))).drop("_replay")


def policy_effect(before: DataFrame, after: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: detections that a policy removed whole, and each rule id that it removed with its number."""
    both = before.select(key, F.col("rule_ids").alias("_before")).join(after.select(key, F.col("rule_ids").alias("_after")), key, "left")
    gone = both.withColumn("_gone", F.array_except("_before", F.coalesce("_after", F.array().cast("array<string>"))))
    return gone.select(F.explode("_gone").alias("rule_id"), F.col("_after").isNull().alias("whole")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("filtered"), F.count_if("whole").alias("in_removed_detections"))


def flow_counts(candidates: DataFrame, suppressed: str = "suppressed", duplicate: str = "duplicate") -> DataFrame:
    """One row: candidates, distinct matched rules, suppressed, deduplicated and emitted detections."""
    return candidates.agg(
        F.count(F.lit(1)).alias("candidates"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("rule_ids")))).alias("matched_rule_ids"),
        F.count_if(F.col(suppressed)).alias("suppressed"), F.count_if(~F.col(suppressed) & F.col(duplicate)).alias("deduplicated"), F.count_if(~F.col(suppressed) & ~F.col(duplicate)).alias("emitted"))
