"""Text rules: compiling value forms, resolving tiers, matching observations, and evidence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionlens.functions import privacy
from sessionlens.operators import commands, spans
from sessionlens.operators.predicates import with_targets
from sessionlens.schemas import TARGETS


def java_regex(pattern: str, flags: str = "") -> str:
    """A rule's pattern in Java's dialect: Unicode classes and case, . stops at newlines only, $ is the end of the text."""
    on = "dUu" + "".join(f for f in "ims" if f in flags)
    if "m" not in flags:
        pattern = re.sub(r"(?<!\\)((?:\\\\)*)\$(?![^\[]*\])", r"\1\\z", pattern)
    return f"(?{on}){pattern}"


def compile_value(form: str, value: str, cased: bool = False) -> str:
    """One regex for a value form: equals, contains, startswith, endswith, or re with the flags i, m, s after a bar."""
    kind, _, flags = form.partition("|")
    if kind == "re":
        return java_regex(value, flags)
    body = "".join({"*": r"[\s\S]*", "?": r"[\s\S]"}.get(c, re.escape(c)) for c in value)
    shape = {"equals": r"\A%s\z", "contains": "%s", "startswith": r"\A%s", "endswith": r"%s\z"}[kind] % body
    return shape if cased else f"(?iu){shape}"


@dataclass(frozen=True)
class Matcher:
    target: str
    regex: str
    exclusion: str | None = None
    scope: str = "field"  # or segment, exclusion_segment, recorded_exclusion


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    score: int
    severity: str
    matchers: tuple
    name: str = ""
    status: str = "stable"
    enabled: bool = True
    detection_class: str = "threat_detection"
    signal_type: str = "atomic"
    analytic_intent: str = "alert"
    explanation: str = ""
    tags: tuple = ()
    atlas_tags: tuple = ()
    action_fields: tuple = field(default=())


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """Rules as a table in the RULES schema: they are data, a few hundred rows."""
    from sessionlens.schemas import RULES

    return spark.createDataFrame([
        (r.rule_id, r.name or r.rule_id, r.status, r.enabled, r.category, r.detection_class, r.signal_type, r.analytic_intent, r.severity, r.score, r.explanation, list(r.tags), list(r.atlas_tags), [(m.target, m.regex, m.exclusion, m.scope) for m in r.matchers], list(r.action_fields))
        for r in rules
    ], RULES)


def rules_of(table: DataFrame, most: int = 2000) -> list[Rule]:
    """Rules from their table, at most ``most``, to become literals of one expression."""
    rows = table.orderBy("rule_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules; use match_dynamic_rules")
    return [Rule(r["rule_id"], r["category"], r["score"], r["severity"], tuple(Matcher(m["target"], m["regex"], m["exclusion_regex"], m["scope"] or "field") for m in r["matchers"]), r["name"], r["status"], r["enabled"], r["detection_class"], r["signal_type"], r["analytic_intent"], r["explanation"], tuple(r["tags"] or ()), tuple(r["atlas_tags"] or ()), tuple(r["action_fields"] or ())) for r in rows]


def enabled_rules(table: DataFrame) -> DataFrame:
    """Rules that run: enabled, and neither deprecated nor unsupported."""
    return table.where(F.coalesce("enabled", F.lit(True)) & ~F.coalesce("status", F.lit("stable")).isin("deprecated", "unsupported"))


def apply_policy(table: DataFrame, categories: list[str] | None, disabled: DataFrame | None = None) -> DataFrame:
    """Rules of the enabled categories less the disabled names."""
    out = table if categories is None else table.where(F.col("category").isin(*categories))
    return out if disabled is None else out.join(disabled.select("name").distinct(), "name", "left_anti")


def resolve_rules(tiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules after overrides, and conflicts. ``tiers`` has ``tier`` (higher wins) and ``may_override`` beside the rule's columns.

    A higher tier replaces the rule of the same name and keeps the first tier's id. A tier that may only add conflicts when its name is taken.
    """
    w = W.partitionBy("name")
    ranked = tiers.withColumns({"_first_id": F.min_by("rule_id", "tier").over(w), "_rn": F.row_number().over(w.orderBy(F.desc("tier"), "rule_id")), "_low": F.min("tier").over(w)})
    conflicts = ranked.where(~F.col("may_override") & (F.col("tier") > F.col("_low"))).select("name", "tier", "rule_id")
    chosen = ranked.where((F.col("_rn") == 1)).withColumn("rule_id", F.col("_first_id")).drop("_first_id", "_rn", "_low")
    return chosen, conflicts


def native_notices(rules: DataFrame, bundled: DataFrame) -> DataFrame:
    """(rule_id, notice): bundled rules that a caller replaced by other matchers, which loses their refinements."""
    digest = lambda df: df.select("rule_id", F.sha2(F.to_json("matchers"), 256).alias("hash"))
    both = digest(rules).join(digest(bundled).withColumnRenamed("hash", "bundled_hash"), "rule_id")
    return both.where("hash <> bundled_hash").select("rule_id", F.lit("replaced_rule_loses_refinement").alias("notice"))


def _field_hit(m: Matcher) -> Column:
    """True, false or null: whether a matcher fires on its target."""
    f = F.col(m.target)
    clean = F.lit(True) if m.exclusion is None else ~f.rlike(m.exclusion)
    if m.scope == "segment" and m.target == "command":
        return F.exists(F.coalesce("segments", F.array(f)), lambda s: s.rlike(m.regex) & (F.lit(True) if m.exclusion is None else ~s.rlike(m.exclusion)))
    if m.scope in spans.SCOPES and (m.scope == "segment" or m.exclusion):
        # the segment that holds a match decides, whatever the field: see spans
        return F.when(f.isNotNull(), spans.counting_span(f, m.regex, m.exclusion, m.scope).isNotNull())
    if m.scope == "recorded_exclusion" and m.target == "command":
        return (f.rlike(m.regex) | F.coalesce(F.col("quote_free"), f).rlike(m.regex)) & clean
    return f.rlike(m.regex) & clean


def _needs_commands(rules: list[Rule]) -> bool:
    return any(m.scope in ("segment", "recorded_exclusion") and m.target == "command" for r in rules for m in r.matchers)


def with_hits(obs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``obs`` with ``hits``: structs of rule_id and field, for every rule and field that matches, in one projection.

    Patterns are literals, so each is compiled once for a task. A rule's own fields can be narrowed by ``action_fields``.
    """
    df = with_targets(obs)
    if _needs_commands(rules):
        df = commands.with_segments(df)
    hits = []
    for r in rules:
        for target in TARGETS:
            own = [m for m in r.matchers if m.target == target and (not r.action_fields or target in r.action_fields)]
            if own:
                test = own and _field_hit(own[0])
                for m in own[1:]:
                    test = test | _field_hit(m)
                hits.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(target).alias("field"))))
    return df.withColumn("hits", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<rule_id:string,field:string>>"))


def match_rules(obs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("source_instance", "session_id", "observation_id")) -> DataFrame:
    """One row for each (observation, rule, field) that matches, with the columns in ``keep`` and the field's value."""
    value = None
    for target in TARGETS:
        value = F.when(F.col("hit.field") == target, F.col(target)) if value is None else value.when(F.col("hit.field") == target, F.col(target))
    hit = with_hits(obs, rules).where(F.size("hits") > 0).withColumn("hit", F.explode("hits"))
    return hit.select(*keep, F.col("hit.rule_id").alias("rule_id"), F.col("hit.field").alias("field"), value.alias("value"))


def match_dynamic_rules(obs: DataFrame, table: DataFrame, most_rules: int = 5000) -> DataFrame:
    """Matches of rules that are only known as rows: a broadcast of at most ``most_rules`` rows, tested on each observation's fields.

    For patterns known to the driver :func:`match_rules` is cheaper.
    """
    if table.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"over {most_rules} rules can't be broadcast")
    own = F.coalesce("action_fields", F.array().cast("array<string>")) if "action_fields" in table.columns else F.array().cast("array<string>")
    m = table.select("rule_id", own.alias("own"), F.explode("matchers").alias("m")).where((F.size("own") == 0) | F.array_contains("own", F.col("m.target"))).select("rule_id", "m.target", "m.regex", "m.exclusion_regex")
    fields = with_targets(obs).select("source_instance", "session_id", "observation_id", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("value")) for t in TARGETS])).alias("f")).select("source_instance", "session_id", "observation_id", "f.*").where("value is not null")
    hit = fields.join(F.broadcast(m), (fields["target"] == m["target"]) & F.expr("value rlike regex") & ~F.coalesce(F.expr("value rlike exclusion_regex"), F.lit(False)))
    return hit.select("source_instance", "session_id", "observation_id", "rule_id", fields["target"].alias("field"), "value").distinct()


def evidence(matches: DataFrame) -> DataFrame:
    """``matches`` with an evidence struct: field, redacted value, hash of the raw value, rule id."""
    return matches.withColumn("evidence", F.struct(F.col("field"), privacy.sanitise(F.col("value")).alias("redacted_value"), F.sha2("value", 256).alias("hash"), F.col("rule_id")))


def excerpt(value: Column, pattern: str, before: int = 160, after: int = 240) -> Column:
    """Struct of text, start and end of the highlight in it (characters), cut_before and cut_after, around the first match.

    What stands before, in and after the match is redacted part by part before it is cut, so a cut never bares a secret.
    """
    hit = F.regexp_extract(value, f"({pattern})", 1)
    at = F.call_function("locate", hit, value)
    head, tail = F.substring(value, F.lit(1), at - 1), F.substring(value, at + F.length(hit), F.length(value))
    clean_head, clean_hit, clean_tail = privacy.redact(head), privacy.redact(hit), privacy.redact(tail)
    left, right = F.right(clean_head, F.lit(before)), F.left(clean_tail, F.lit(after))
    return F.when(value.rlike(pattern), F.struct(
        F.concat(left, clean_hit, right).alias("text"), F.length(left).alias("start"), (F.length(left) + F.length(clean_hit)).alias("end"),
        (F.length(clean_head) > before).alias("cut_before"), (F.length(clean_tail) > after).alias("cut_after"),
    ))


def preview_rules(obs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, hits, observations): what rules would match in a table, without events."""
    return match_rules(obs, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("observation_id").alias("observations"))
