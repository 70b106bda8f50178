"""Process chains: parent and child pairs from commands, pack rules, dedup and demotion."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.activity import demoted, process_name, severity_rank, weaker

MOST_DEPTH = 3
#: Interpreters that take a command line, and the flags before it.
NESTED_INTERPRETERS = {
    "cmd": ("/c", "/k", "/r"),
    "powershell": ("-c", "-command", "-comman", "-comm", "-com"),
    "pwsh": ("-c", "-command"),
    "bash": ("-c",),
    "sh": ("-c",),
    "zsh": ("-c",),
    "wsl": ("-e", "--exec", "--"),
}
#: Programs that stand before the one that is meant.
TRANSPARENT_WRAPPERS = ("sudo", "doas", "env", "nohup", "time", "timeout", "start", "call", "exec", "nice", "stdbuf")
#: Programs of Windows alone, by which a parent shell is inferred.
WINDOWS_ONLY = tuple("""
arp atbroker bcdedit bitsadmin certutil cipher cmd cmstp copy cscript csc csvde diskshadow displayswitch dsget dsquery esentutl
fltmc forfiles fsutil gpupdate hostname icacls installutil ipconfig klist ldifde magnify makecab mmc mpcmdrun msbuild msdt mshta
msiexec narrator nbtstat net net1 netsh netstat nltest ntdsutil osk pathping pcalua powershell procdump psexec qprocess reg
regsvr32 route rundll32 sc schtasks sethc systeminfo tasklist taskkill tracert utilman vssadmin wbadmin wevtutil whoami wmic
wscript xcopy xwizard
""".split())
#: Shells, which are not inferred to be started by one.
OWN_SHELLS = ("cmd", "powershell", "pwsh", "bash", "sh", "zsh", "wsl")
_WORD = re.compile(r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'])+""")
_WORD_PART = re.compile(r""""([^"]*)"?|'([^']*)'?|([^"']+)""")


def statements(line: str) -> list[str]:
    """The statements of a command line of either system: split at unquoted separators, where backslashes and carets are plain characters.

    In a comment a quote that its line doesn't close opens nothing, but separators still separate: other shells run what follows.
    """
    out, start, i, comment, fresh = [], 0, 0, False, True
    while i < len(line):
        c = line[i]
        if c in "\"'":
            row_end = min((e for e in (line.find("\n", i), line.find("\r", i)) if e >= 0), default=len(line))
            if comment and line.find(c, i + 1, row_end) < 0:
                i += 1
                continue
            close = line.find(c, i + 1)
            i, fresh = len(line) if close < 0 else close + 1, False
            continue
        if c == "#" and fresh:
            comment = True
            i += 1
            continue
        redirects = c == "&" and (line[i + 1 : i + 2] == ">" or line[max(0, i - 1) : i] in ("<", ">"))
        if c in ";\n\r" or c == "|" or c == "&" and not redirects:
            length = 2 if c == "|" and line[i + 1 : i + 2] in ("|", "&") or c == "&" and line[i + 1 : i + 2] == "&" else 1
            out.append(line[start:i])
            comment = comment and c not in "\n\r"
            i, fresh = i + length, True
            start = i
            continue
        fresh = c.isspace()
        i += 1
    return [x.strip() for x in [*out, line[start:]] if x.strip()]


def words(statement: str) -> list[str]:
    """White-space tokens without their quotes, so that a quoted path is one token."""
    tokens = ("".join("".join(p) for p in _WORD_PART.findall(m.group())) for m in _WORD.finditer(statement))
    return [t for t in tokens if t]


def short_name(token: str) -> str:
    """Base name in lower case, without .exe; dots and dashes are underscores."""
    base = re.split(r"[\\/]", token.strip().strip("\"'").strip())[-1].strip().lower()
    return base.removesuffix(".exe").replace(".", "_").replace("-", "_")


def started(tokens: list[str]) -> str | None:
    """The program that a statement starts: the first token that is no assignment, wrapper or switch."""
    for t in tokens:
        assigns = "=" in t and "/" not in t and "\\" not in t
        switch = t.startswith("-") or t.startswith("/") and len(t) <= 3
        if not (assigns or switch or short_name(t) in TRANSPARENT_WRAPPERS):
            return t
    return None


def inferred_shell(name: str, statement: str) -> str:
    """The shell that must have started a program of Windows or in Windows' manner; empty if none can be told."""
    low = statement.lower()
    shaped = ".exe" in low or ":\\" in low or low.count("%") >= 2 and "http" not in low
    return "cmd" if name not in OWN_SHELLS and (name in WINDOWS_ONLY or shaped) else ""


def pairs_of(line: str, parent: str | None = None, depth: int = 0) -> list[tuple[int, str, str, str | None, str, bool]]:
    """(statement, parent, child, child's path, command line, inferred) of what each statement starts.

    An interpreter with a command line of its own is only a wrapper of what that starts, which is reported in its place, down to
    MOST_DEPTH; one whose command line can't be read, as an encoded one, is reported itself.
    """
    out = []
    for n, statement in enumerate(statements(line)):
        tokens = words(statement)
        child = started(tokens)
        name = short_name(child or "")
        if not name:
            continue
        flags = NESTED_INTERPRETERS.get(name, ())
        at = next((i for i, t in enumerate(tokens) if t.lower() in flags), None)
        inner = "" if at is None else " ".join(tokens[at + 1 :])
        if inner.strip():
            if depth < MOST_DEPTH:
                out += [(n, *rest) for _, *rest in pairs_of(inner, name, depth + 1)]
            continue
        path = child if "/" in child or "\\" in child else None
        out.append((n, inferred_shell(name, statement) if parent is None else parent, child, path, statement, parent is None))
    return out


def process_pairs(obs: DataFrame, column: str = "command") -> DataFrame:
    """(observation columns, statement_no, parent, child, child_path, command_line, parent_inferred) for every command of the table.

    The parent is empty where nothing tells it. Commands without a quote, separator, comment or interpreter still take the same path.
    """
    names = ["statement_no", "parent", "child", "child_path", "command_line", "parent_inferred"]

    @F.pandas_udf("array<struct<statement_no:int,parent:string,child:string,child_path:string,command_line:string,parent_inferred:boolean>>")
    def read(c: pd.Series) -> pd.Series:
        return c.map(lambda x: [] if x is None else [dict(zip(names, p, strict=True)) for p in pairs_of(x)])

    keep = [c for c in ("source_instance", "session_id", "observation_id", "occurred_at") if c in obs.columns]
    return obs.where(F.col(column).isNotNull()).select(*keep, F.explode(read(column)).alias("p")).select(*keep, "p.*")


def _any(patterns: Column, text: Column) -> Column:
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.call_function("rlike", text, F.concat(F.lit("(?i)"), p)))


def match_process_rules(pairs: DataFrame, rules: DataFrame, most_rules: int = 5000) -> DataFrame:
    """Pairs that a pack rule names and whose gates pass, with the rule's columns. Rules without a parent match any parent.

    The pack is a dimension of at most ``most_rules`` rows, checked and then broadcast on the child's name.
    A gate that needs text the pair doesn't have fails. An inferred parent costs a band of confidence.
    """
    on = rules.where(F.coalesce("enabled", F.lit(True)))
    if on.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"over {most_rules} rules can't be broadcast")
    p = pairs.withColumns({"_parent": process_name(F.col("parent")), "_child": process_name(F.col("child"))})
    r = on.select(*[F.col(c).alias(f"r_{c}") for c in on.columns])
    r = r.withColumns({"r_parent_key": process_name(F.col("r_parent")), "r_child_key": process_name(F.col("r_child"))})
    hit = p.join(F.broadcast(r), (F.col("_child") == F.col("r_child_key")) & (F.col("r_parent_key").isNull() | (F.col("_parent") == F.col("r_parent_key"))))
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    line = F.col("command_line")
    path = F.coalesce("child_path", "child") if "child_path" in pairs.columns else F.col("child")
    gates = (none(F.col("r_command_line_any")) | _any(F.col("r_command_line_any"), line)) & ~F.coalesce(_any(F.col("r_command_line_none"), line), F.lit(False)) & (none(F.col("r_path_any")) | _any(F.col("r_path_any"), path)) & ~F.coalesce(_any(F.col("r_path_none"), path), F.lit(False))
    out = hit.where(F.coalesce(gates, F.lit(False)))
    gated = ~none(F.col("r_command_line_any")) | ~none(F.col("r_path_any"))
    confidence = F.when(F.col("parent_inferred") & F.col("r_parent").isNotNull(), weaker(F.col("r_confidence"))).otherwise(F.col("r_confidence"))
    return out.select(*pairs.columns, F.col("r_id").alias("rule_id"), F.col("r_title").alias("title"), F.col("r_category").alias("category"), F.col("r_severity").alias("severity"), F.col("r_score").alias("score"), confidence.alias("confidence"), F.col("r_mitre").alias("mitre"), F.coalesce("r_dedup_key", "r_id").alias("dedup_key"), gated.alias("gated"))


def match_indicators(pairs: DataFrame, indicators: list[dict]) -> DataFrame:
    """Pairs that a standalone indicator names: {id, field: child, child_path or command_line, regex, exclude, score, severity, category}."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(F.col(i["field"]).rlike(i["regex"]) & (F.lit(True) if not i.get("exclude") else ~F.col(i["field"]).rlike(i["exclude"])), F.lit(False)), F.struct(F.lit(i["id"]).alias("rule_id"), F.lit(i["category"]).alias("category"), F.lit(i["severity"]).alias("severity"), F.lit(i["score"]).cast("long").alias("score"))) for i in indicators]))
    return pairs.select("*", F.explode(hits).alias("_hit")).select(*pairs.columns, "_hit.*")


def dedup_process(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best result of each key (score, then severity, then id) with the others' ids and all techniques."""
    w = W.partitionBy(*keys, "dedup_key")
    order = w.orderBy(F.desc("score"), F.desc(severity_rank(F.col("severity"))), "rule_id")
    df = found.withColumns({"_rn": F.row_number().over(order), "_ids": F.collect_set("rule_id").over(w), "_all": F.flatten(F.collect_list(F.coalesce("mitre", F.array().cast("array<string>"))).over(w))})
    return df.where("_rn = 1").withColumns({"secondary_rule_ids": F.array_sort(F.array_except("_ids", F.array("rule_id"))), "mitre": F.array_sort(F.array_distinct("_all"))}).drop("_rn", "_ids", "_all")


#: Categories in which an approved user, a management host and a sanctioned remote tool soften a result.
ADMIN_CATEGORIES = ("discovery", "execution", "persistence", "lateral_movement")
HOST_CATEGORIES = ("lateral_movement", "execution", "discovery")
TOOL_CATEGORY = "command_and_control"


def demote(found: DataFrame, admins=(), hosts=(), tools=()) -> DataFrame:
    """Results that their context explains lose a band of severity and its score: approved users, management hosts and sanctioned remote tools.

    Users and hosts count in the categories named above, tools in command and control as parent or child; critical results
    never fall for a user, and results of a gated rule, which saw the argument itself, for nothing. ``found`` has category,
    severity, score and gated; columns that it lacks count as null. Adds informational and risk_adjustment, the reason.
    """
    have = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string")
    named = lambda c, names: F.coalesce(F.lower(have(c)).isin(*[n.lower() for n in names]), F.lit(False)) if names else F.lit(False)
    products = [n.lower().removesuffix(".exe").translate(str.maketrans(".-", "__")) for n in tools]
    runs = lambda c: F.coalesce(process_name(have(c)).isin(*products), F.lit(False)) if products else F.lit(False)
    why = (
        F.when(F.coalesce("gated", F.lit(False)), None)
        .when(named("user", admins) & F.col("category").isin(*ADMIN_CATEGORIES) & (F.col("severity") != "critical"), "approved administrative user")
        .when(named("host", hosts) & F.col("category").isin(*HOST_CATEGORIES), "known management server")
        .when((F.col("category") == TOOL_CATEGORY) & (runs("parent") | runs("child")), "sanctioned remote management product")
    )
    below = demoted(F.col("severity"))
    df = found.withColumn("_why", why).withColumn("_below", below)
    on = F.col("_why").isNotNull()
    return df.withColumns({
        "severity": F.when(on, F.col("_below.severity")).otherwise(F.col("severity")), "score": F.when(on, F.col("_below.score")).otherwise(F.col("score")),
        "informational": on & (F.col("_below.score") == 0), "demoted": on, "risk_adjustment": F.col("_why"),
    }).drop("_why", "_below")
