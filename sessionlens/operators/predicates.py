"""Selectors and predicates in three-valued logic: true, false, and null for what can't be judged.

A predicate over a fact that the source doesn't show is null, and so are negations of it: SQL's own AND, OR and NOT
carry that through. Facts that are absent are false for positive operators, true for not_exists, and null for not_equals and not_in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.activity import path_class, url_host

#: Selector names that columns hold, with the capability that each needs.
COLUMNS = {
    "session.id": ("", "session_id"), "message.role": ("", "role"), "message.content": ("", "text"), "message.text": ("", "text"),
    "tool.name": ("tool_call", "tool_name"), "tool.arguments": ("tool_call", "arguments"), "tool.searchable_arguments": ("tool_call", "arguments"),
    "tool.result": ("tool_call", "tool_result"), "tool.searchable_result": ("tool_call", "tool_result"), "tool.reported_status": ("tool_call", "reported_status"),
    "tool.is_error": ("tool_call", "is_error"), "tool.exit_code": ("tool_call", "exit_code"), "command.text": ("", "command"), "resource.path": ("", "file_path"),
    "compat.v1.arguments": ("tool_call", "arguments"), "compat.v1.assistant_context": ("user_context", "assistant_context"), "compat.v1.command": ("tool_call", "command"),
    "compat.v1.file_path": ("tool_call", "file_path"), "compat.v1.tool_kind": ("tool_call", "tool_kind"), "compat.v1.tool_name": ("tool_call", "tool_name"),
    "compat.v1.tool_result": ("tool_call", "tool_result"), "compat.v1.url": ("tool_call", "url"), "compat.v1.user_context": ("user_context", "user_context"),
    "compat.v1.written_path": ("tool_call", "written_path"),
    "tool.call_id": ("tool_call", "call_id"), "tool.stage": ("tool_call", "stage"), "tool.arguments.text": ("tool_call", "arguments"), "tool.result.text": ("tool_call", "tool_result"),
    "tool.result.is_error": ("tool_call", "is_error"), "tool.result.exit_code": ("tool_call", "exit_code"),
}
#: Selector names whose facts stay in ``extra`` under the name itself, or are derived from other columns.
EXTRA = (
    "tool.arguments.keys", "resource.operation", "resource.path_class", "network.domain", "network.destination_class", "network.operation", "network.port", "network.protocol",
    "process.name", "process.pid", "process.instance_id", "process.privilege", "inference.provider", "inference.requested_model", "inference.resolved_model", "inference.streaming",
    "inference.stop_reason", "mcp.server.id", "mcp.server.transport", "mcp.server.location_class", "mcp.tool.name", "runtime.execution_mode", "runtime.isolation.state",
    "runtime.privilege", "runtime.workspace.class", "browser.surface", "browser.origin_class", "browser.navigation_id",
)
MOST_BRANCHES, MOST_DEPTH = 64, 8


def selectors() -> list[str]:
    return [*COLUMNS, *EXTRA]


def with_targets(obs: DataFrame) -> DataFrame:
    """``obs`` with the two context columns: text of assistant and of user messages."""
    said = lambda role: F.when((F.col("role") == role) & F.col("text").isNotNull(), F.col("text"))
    return obs.withColumns({"assistant_context": said("assistant"), "user_context": said("user")})


def selector(name: str) -> Column:
    """The fact's column. What ``extra`` doesn't hold is derived where a column allows it: argument keys, path classes and domains."""
    if name in COLUMNS:
        return F.col(COLUMNS[name][1])
    if name not in EXTRA:
        raise ValueError(f"no selector {name}")
    told = F.try_element_at(F.col("extra"), F.lit(name))
    if name == "tool.arguments.keys":
        return F.coalesce(told, F.array_join(F.array_sort(F.json_object_keys("arguments")), ","))
    if name == "resource.path_class":
        return F.coalesce(told, path_class(F.col("file_path")))
    if name == "network.domain":
        return F.coalesce(told, url_host(F.col("url")))
    return told


def visible(name: str) -> Column:
    """True if the source shows the fact: its capability is not known to be missing."""
    need = COLUMNS[name][0] if name in COLUMNS else "tool_call" if name.startswith("tool.") else ""
    return F.coalesce(F.try_element_at(F.col("caps"), F.lit(need)) == "supported", F.lit(False)) if need else F.lit(True)


CUT = "cut"
"""Key of ``extra`` that names, by commas, the columns whose values a reader has cut."""
CUTTABLE = ("text", "arguments", "tool_result", "command")


def cut_values(obs: DataFrame, most: int, columns: tuple[str, ...] = CUTTABLE) -> DataFrame:
    """``obs`` with the values of ``columns`` cut to ``most`` characters, those that were cut marked in ``extra`` and the row as partial.

    The marks travel with the observation, so that a predicate tells what a cut value lacks from what it may have lost.
    """
    over = {c: F.coalesce(F.length(c) > most, F.lit(False)) for c in columns}
    before = F.try_element_at(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.lit(CUT))
    names = F.array_compact(F.array(*[F.when(v, c) for c, v in over.items()]))
    every = F.array_join(F.array_sort(F.array_union(F.coalesce(F.split(before, ","), F.array().cast("array<string>")), names)), ",")
    extra = F.map_concat(F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: k != CUT), F.create_map(F.lit(CUT), every))
    marked = obs.withColumns({"_any": F.size(names) > 0, "_extra": extra})
    cut = {c: F.when(v, F.substring(c, 1, most)).otherwise(F.col(c)) for c, v in over.items()}
    return marked.withColumns({**cut, "partial": F.coalesce("partial", F.lit(False)) | F.col("_any"), "extra": F.when(F.col("_any"), F.col("_extra")).otherwise(F.col("extra"))}).drop("_any", "_extra")


def was_cut(name: str) -> Column:
    """Whether the reader has cut the value of the selector's column."""
    column = COLUMNS[name][1] if name in COLUMNS else {"tool.arguments.keys": "arguments"}.get(name, "")
    column = {"user_context": "text", "assistant_context": "text"}.get(column, column)
    if column not in CUTTABLE:
        return F.lit(False)
    return F.coalesce(F.array_contains(F.split(F.try_element_at(F.col("extra"), F.lit(CUT)), ","), column), F.lit(False))


def same_number(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two numbers, null where an integer would lose digits as a float or a float isn't finite."""
    x, y = a.try_cast("double"), b.try_cast("double")
    kept = lambda n, f: n.try_cast("long").isNull() | (f.try_cast("long") == n.try_cast("long"))
    exact = kept(a, x) & kept(b, y)
    finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
    return F.when(exact & finite, F.when(x < y, -1).when(x > y, 1).otherwise(0))


def glob_regex(glob: str) -> str:
    """Anchored Java pattern of a glob: * and ? stand for characters of one line, [...] for one of a class as a pattern writes it."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "[":
            end = glob.find("]", i)
            if end < 0:
                raise ValueError(f"no end of a class in {glob}")
            out.append("[" + glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        else:
            out.append({"*": "[^\\n]*", "?": "[^\\n]"}.get(c, "\\" + c if c in r".^$+{}()|\]" else c))
        i += 1
    return f"\\A{''.join(out)}\\z"


def op(name: str, fact: Column, value=None) -> Column:
    """One operator on a present fact; absence is settled by :func:`test`."""
    text = fact.cast("string")
    numeric = isinstance(value, int | float) and not isinstance(value, bool)
    order = same_number(fact, F.lit(value)) if numeric else None
    match name:
        case "equals":
            return (order == 0) if numeric else text == F.lit(value).cast("string")
        case "not_equals":
            return (order != 0) if numeric else text != F.lit(value).cast("string")
        case "contains":
            return text.contains(value)
        case "starts_with":
            return text.startswith(value)
        case "ends_with":
            return text.endswith(value)
        case "regex":
            return text.rlike(value)
        case "glob":
            return text.rlike(glob_regex(value))
        case "in":
            return text.isin(*value)
        case "not_in":
            return ~text.isin(*value)
        case "gt":
            return order > 0
        case "gte":
            return order >= 0
        case "lt":
            return order < 0
        case "lte":
            return order <= 0
    raise ValueError(f"no operator {name}")


def test(name: str, selector_name: str, value=None, partial: Column | None = None) -> Column:
    """Predicate on a selector, with the rules for absent, invisible and partial facts. ``partial`` is :func:`was_cut` if not given.

    A cut value may hold what it seems to lack: only what its beginning settles is true or false. That is a match of contains,
    starts_with, or an expression found in it; whether it equals or ends with something can't be told.
    """
    fact, shown = selector(selector_name), visible(selector_name)
    partial = was_cut(selector_name) if partial is None else F.coalesce(partial, F.lit(False))
    if name in ("exists", "not_exists"):
        out = fact.isNotNull() if name == "exists" else fact.isNull()
    else:
        absent = F.lit(None).cast("boolean") if name in ("not_equals", "not_in") else F.lit(False)
        held = op(name, fact, value)
        out = F.when(fact.isNull(), absent).otherwise(held)
        settled = F.coalesce(held, F.lit(False)) if name in ("contains", "starts_with", "regex") else F.lit(False)
        out = F.when(partial & fact.isNotNull() & ~settled, F.lit(None).cast("boolean")).otherwise(out)
    return F.when(shown, out)


def tree(node, depth: int = 1) -> Column:
    """The predicate of nested tuples: ("all", node, …), ("any", node, …), ("not", node), or a test (operator, selector, value).

    At most MOST_DEPTH levels of at most MOST_BRANCHES branches; more is an error of the detector, not of the data.
    """
    if depth > MOST_DEPTH:
        raise ValueError(f"over {MOST_DEPTH} levels")
    match node:
        case ("all", *parts):
            return all_of(*[tree(p, depth + 1) for p in parts])
        case ("any", *parts):
            return any_of(*[tree(p, depth + 1) for p in parts])
        case ("not", part):
            return not_(tree(part, depth + 1))
    return test(*node)


def tests_of(node) -> list[tuple]:
    """The tests of a tree, in order."""
    return [t for part in node[1:] for t in tests_of(part)] if node[0] in ("all", "any", "not") else [node]


def broken(spark, detector: Detector) -> str | None:
    """Why a detector can't run on any observation: an unknown selector or operator, a tree beyond its limits, a pattern that doesn't compile."""
    try:
        detector.predicate()
        for operator, _, *value in tests_of(detector.whole()):
            if operator in ("regex", "glob"):
                spark._jvm.java.util.regex.Pattern.compile(value[0] if operator == "regex" else glob_regex(value[0]))
    except Exception as e:
        return f"{type(e).__name__}: {str(e).splitlines()[0]}"[:200]
    return None


def all_of(*parts: Column) -> Column:
    if len(parts) > MOST_BRANCHES:
        raise ValueError(f"over {MOST_BRANCHES} branches")
    return reduce(lambda a, b: a & b, parts)


def any_of(*parts: Column) -> Column:
    if len(parts) > MOST_BRANCHES:
        raise ValueError(f"over {MOST_BRANCHES} branches")
    return reduce(lambda a, b: a | b, parts)


def not_(part: Column) -> Column:
    return ~part


def require(predicate: Column, provenance: Column | None = None, capability: str = "") -> Column:
    """``predicate`` where the fact has the wanted provenance and the source the capability; else null."""
    ok = F.lit(True) if provenance is None else provenance
    if capability:
        ok = ok & F.coalesce(F.try_element_at(F.col("caps"), F.lit(capability)) == "supported", F.lit(False))
    return F.when(ok, predicate)


def status(predicate: Column, applies: Column) -> Column:
    """match, no_match, not_evaluated or not_applicable."""
    return F.when(~F.coalesce(applies, F.lit(False)), "not_applicable").when(predicate, "match").when(~predicate, "no_match").otherwise("not_evaluated")


@dataclass(frozen=True)
class Detector:
    """A detector on single observations: families and stages that it reads, then tests as (operator, selector, value) or trees of them."""

    detector_id: str
    tests: tuple
    families: tuple = ()
    stages: tuple = ()
    mode: str = "all"

    def whole(self) -> tuple:
        return (self.mode, *self.tests)

    def predicate(self) -> Column:
        return tree(self.whole())

    def applies(self) -> Column:
        out = F.lit(True)
        if self.families:
            out = out & F.col("family").isin(*self.families)
        if self.stages:
            out = out & F.col("stage").isin(*self.stages)
        return out


REASONS = ("unavailable_visibility", "metadata_missing", "partial_value", "type_mismatch")
"""Why a detector could not be evaluated, strongest first."""


def detect(obs: DataFrame, detector: Detector) -> DataFrame:
    """(observation_id, detector_id, status, reason, fields): outcome on each observation and the selectors that matched.

    A detector that can't run at all has the outcome error on every observation that it applies to, and the job goes on.
    """
    why = broken(obs.sparkSession, detector)
    if why is not None:
        none = F.lit(None).cast("array<string>")
        return obs.select("observation_id", F.lit(detector.detector_id).alias("detector_id"), F.when(F.coalesce(detector.applies(), F.lit(False)), "error").otherwise("not_applicable").alias("status"), F.lit(why).alias("reason"), none.alias("fields"))
    df = with_targets(obs)
    tests = tests_of(detector.whole())
    what = status(detector.predicate(), detector.applies())
    some = lambda holds: reduce(lambda a, b: a | b, [holds(t[1]) for t in tests])
    hidden, missing, cut = some(lambda n: ~visible(n)), some(lambda n: selector(n).isNull()), some(was_cut)
    reason = F.when(what == "not_evaluated", F.when(hidden, REASONS[0]).when(missing, REASONS[1]).when(cut, REASONS[2]).otherwise(REASONS[3]))
    fields = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(test(*t), t[1]) for t in tests]))))
    return df.select("observation_id", F.lit(detector.detector_id).alias("detector_id"), what.alias("status"), reason.alias("reason"), F.when(what == "match", fields).alias("fields"))


def filter_events(events: DataFrame, severities=(), clients=(), sessions=(), rule_ids=(), since=None, until=None) -> DataFrame:
    """Events by severity in any case, client, session, any of some rules, and an inclusive time range that unreadable times never meet."""
    keep = F.lit(True)
    if severities:
        keep = keep & F.lower("severity").isin(*[s.lower() for s in severities])
    if clients:
        keep = keep & F.col("client").isin(*clients)
    if sessions:
        keep = keep & F.col("session_id").isin(*sessions)
    if rule_ids:
        keep = keep & F.arrays_overlap("rule_ids", F.array(*[F.lit(r) for r in rule_ids]))
    at = F.try_to_timestamp(F.col("timestamp"))
    if since:
        keep = keep & (at >= F.lit(since).cast("timestamp"))
    if until:
        keep = keep & (at <= F.lit(until).cast("timestamp"))
    return events.where(F.coalesce(keep, F.lit(False)))

