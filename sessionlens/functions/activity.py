"""Facts read from texts and names: path classes, hosts, tool kinds, times, severities, responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path classes in order of precedence, each by what a lower-cased token contains, starts or ends with.
PATH_CLASSES = (
    ("secret_store", (".env", "id_rsa", "id_ed25519", ".aws/credentials", ".ssh/", "credentials", "token"), (), ()),
    ("temp", (), ("/tmp/", "tmp/", "/var/tmp/"), ()),
    ("home", (), ("~/", "/home/", "/users/", "c:/users/", "$home/"), ()),
    ("test", ("/test/", "/tests/"), ("test/", "tests/"), ("_test.rs", ".test.js", ".spec.ts")),
    ("documentation", ("/docs/",), ("docs/",), (".md", ".rst")),
    ("build_manifest", (), (), ("cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml")),
    ("config", (), (), (".yaml", ".yml", ".toml", ".json", ".ini", ".conf")),
    ("source", (), (), (".rs", ".py", ".js", ".ts", ".tsx", ".go", ".java", ".c", ".cpp", ".h")),
)
#: Native tool names by kind, argument keys by what they name.
FILE_WRITE_TOOLS = ("write", "write_file", "writefile", "create", "create_file", "edit", "edit_file", "multiedit", "multi_edit", "notebookedit", "replace")
FILE_READ_TOOLS = ("read", "read_file", "readfile", "view_file", "glob", "list", "grep")
SHELL_TOOLS = ("shell", "exec_command", "shell_command", "bash", "sh", "zsh", "fish", "pwsh", "powershell", "cmd.exe")
URL_KEYS = ("url", "uri", "href", "endpoint")
FILE_KEYS = ("file_path", "filePath", "path", "notebook_path", "absolute_path", "target_file", "file", "filename")
CONTENT_KEYS = ("content", "contents", "new_string", "newString", "new_str", "newText", "file_text", "new_source", "edits", "code_edit")
#: Playbooks by the first family that a rule id or a category names.
PLAYBOOKS = (
    ("playbook-mcp-prompt-injection", ("mcp",), ("mcp",)),
    ("playbook-credential-access", ("credential", "secret"), ("credential",)),
    ("playbook-network-egress", ("exfil",), ("network", "exfil")),
    ("playbook-persistence", ("persistence",), ("persistence",)),
)
DEFAULT_PLAYBOOK = "playbook-general-investigation"
BANDS = (("critical", 90), ("high", 70), ("medium", 50), ("low", 20))
"""Severity by the least score that reaches it."""
ACTIONS = {"critical": "investigate_immediately", "high": "investigate", "medium": "review"}


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _trimmed(token: Column) -> Column:
    return F.regexp_replace(token, "^[\"'`,;:)(\\[\\]{}]+|[\"'`,;:)(\\[\\]{}]+$", "")


def _path_like(token: Column) -> Column:
    return (token.contains("/") | token.contains(".")) & ~token.startswith("http://") & ~token.startswith("https://")


def _class_of(lower: Column) -> Column:
    out = None
    for name, has, starts, ends in PATH_CLASSES:
        tests = [lower.contains(x) for x in has] + [lower.startswith(x) for x in starts] + [lower.endswith(x) for x in ends]
        if name == "temp":
            tests.append((lower.startswith("/users/") | lower.startswith("c:/users/")) & lower.contains("/appdata/local/temp/"))
        out = F.when(any_of(tests), name) if out is None else out.when(any_of(tests), name)
    return out.otherwise("other")


def path_class(token: Column) -> Column:
    """Class of a token that looks like a path, else null."""
    return F.get(path_classes(token), F.lit(0))


def tokens(text: Column) -> Column:
    """White-space tokens of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def path_classes(text: Column) -> Column:
    """Classes of the path-like tokens in order. Tokens are trimmed once, and only path-like ones are classified."""
    return F.transform(F.transform(F.filter(F.transform(tokens(text), _trimmed), _path_like), F.lower), _class_of)


def url_host(token: Column) -> Column:
    """Lower-case host of an http or https token, without user info, port or path; else null."""
    trimmed = F.regexp_replace(token, "^[\"'`,;)(\\[\\]{}<>]+|[\"'`,;)(\\[\\]{}<>]+$", "")
    authority = F.regexp_extract(trimmed, "^https?://([^/?#:]*)", 1)
    host = F.lower(F.regexp_replace(F.trim(authority), "^.*@", ""))
    return F.when(host != "", host)


def network_hosts(text: Column) -> Column:
    return F.array_compact(F.transform(tokens(text), url_host))


def host_identity(host: Column) -> Column:
    """``sha256:`` and the hash of the host; an identity already hashed stays."""
    return F.when(host.rlike("^sha256:[0-9a-f]{64}$"), host).otherwise(F.concat(F.lit("sha256:"), F.sha2(F.lower(F.trim(host)), 256)))


def tool_kind(name: Column) -> Column:
    """Kind of a native tool by its name, in any letter case; null for others."""
    lower = F.lower(name)
    folded = F.translate(lower, "\u017f", "s")
    return F.when(lower.isin(*FILE_WRITE_TOOLS), "file_write").when(lower.isin(*FILE_READ_TOOLS), "file_read").when(folded.isin(*SHELL_TOOLS), "shell")


def tool_operation(name: Column) -> Column:
    """Kind of a tool for reports, by name: with web and delegating tools, and other for the rest."""
    lower = F.lower(name)
    return F.coalesce(tool_kind(name), F.when(lower.isin("webfetch", "web_fetch", "websearch", "web_search", "fetch"), "web").when(lower.isin("task", "agent", "delegate", "spawn_agent"), "delegate").when(name.isNotNull(), "other"))


def _arguments(arguments: Column) -> Column:
    return F.from_json(arguments, "map<string,string>")


def _named(arguments: Column, keys) -> Column:
    """Non-empty string values of the top-level arguments of these names, in key order."""
    picked = F.map_filter(_arguments(arguments), lambda k, v: k.isin(*keys) & (v != ""))
    return F.coalesce(F.transform(F.array_sort(F.map_entries(picked)), lambda e: e["value"]), F.array().cast("array<string>"))


def argument_urls(arguments: Column) -> Column:
    return _named(arguments, URL_KEYS)


def written_paths(name: Column, arguments: Column) -> Column:
    """File arguments of a call that writes: a file-writing tool, or any call whose arguments carry the content."""
    writes = F.coalesce(tool_kind(name) == "file_write", F.lit(False)) | F.coalesce(F.exists(F.map_keys(_arguments(arguments)), lambda k: k.isin(*CONTENT_KEYS)), F.lit(False))
    return F.when(writes, _named(arguments, FILE_KEYS)).otherwise(F.array().cast("array<string>"))


def severity(score: Column, bands=BANDS) -> Column:
    out = None
    for name, least in bands:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("informational")


def severity_rank(name: Column) -> Column:
    """0 for informational up to 4 for critical, in any letter case; null for other words."""
    at = F.array_position(F.array(*[F.lit(s) for s in ("informational", "low", "medium", "high", "critical")]), F.lower(name))
    return F.when(at > 0, at - 1)


def event_time(raw: Column, observed: Column) -> Column:
    """Struct of time, source, confidence and reason: the source's own time unless it is missing, unreadable or over 5 minutes ahead."""
    parsed = F.try_to_timestamp(raw)
    ahead = parsed > observed + F.expr("interval 5 minutes")
    pick = lambda own, missing, bad, late: F.when(raw.isNull(), missing).when(parsed.isNull(), bad).when(ahead, late).otherwise(own)
    return F.struct(
        F.when(parsed.isNull() | ahead, observed).otherwise(parsed).alias("event_time"),
        pick(F.lit("source"), F.lit("observed"), F.lit("observed"), F.lit("observed")).alias("time_source"),
        pick(F.lit("high"), F.lit("low"), F.lit("low"), F.lit("low")).alias("time_confidence"),
        pick(F.lit(None).cast("string"), F.lit("missing_source_time"), F.lit("unparseable_source_time"), F.lit("future_source_time")).alias("time_override_reason"),
    )


def format_time(ts: Column) -> Column:
    """RFC 3339 in UTC; sub-seconds always read .000."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def record_kind(family: Column, stage: Column, role: Column) -> Column:
    return (
        F.when((family == "message") & (role == "user"), "user").when((family == "message") & (role == "assistant"), "assistant")
        .when((family == "tool") & stage.isin("result", "completed", "failed"), "tool_result").when(family == "tool", "tool_call")
        .when(family == "session", "session_meta").otherwise("other")
    )


def response(level: Column, rule_ids: Column, categories: Column, review: Column) -> Column:
    """Recommended action, playbook, summary and escalation of a detection."""
    names = lambda arr, needles: F.exists(F.coalesce(arr, F.array().cast("array<string>")), lambda x: any_of([x.contains(n) for n in needles]))
    playbook = None
    for book, rules, cats in PLAYBOOKS:
        hit = names(rule_ids, rules) | names(categories, cats)
        playbook = F.when(hit, book) if playbook is None else playbook.when(hit, book)
    action = None
    for name, what in ACTIONS.items():
        action = F.when(level == name, what) if action is None else action.when(level == name, what)
    listed = lambda arr, none: F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.array_join(arr, ",")).otherwise(none)
    return F.struct(
        action.otherwise("monitor").alias("recommended_action"), playbook.otherwise(DEFAULT_PLAYBOOK).alias("response_playbook"),
        F.concat(level, F.lit(": matched "), listed(rule_ids, "no rule id"), F.lit(" in "), listed(categories, "uncategorized")).alias("investigation_summary"),
        F.when(review, "security_review_required").otherwise("routine_review").alias("escalation"),
    )


def process_name(path: Column) -> Column:
    """Base name in lower case without .exe, with dots and dashes as underscores."""
    return F.translate(F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)), r"\.exe$", ""), ".-", "__")


def technique(tag: Column) -> Column:
    """ATT&CK technique id in upper case, or null if it has another form."""
    found = F.upper(F.regexp_replace(F.trim(tag), r"^(?i)attack\.", ""))
    return F.when(found.rlike(r"^T\d{4}(\.\d{3})?$"), found)


def atlas_tag(tag: Column) -> Column:
    """ATLAS technique id (AML.T0055) of a tag such as atlas.aml.t0055, else null."""
    found = F.upper(F.regexp_replace(tag, r"^atlas\.", ""))
    return F.when(found.rlike(r"^AML\.T\d{4}(\.\d{3})?$"), found)


def well_formed_id(name: Column, most: int = 128) -> Column:
    """True for dotted lower-case ids such as secret.env.read."""
    return name.rlike(r"^[a-z][a-z0-9_]*(\.[a-z0-9_]+)+$") & (F.length(name) <= most)


def normalised_tool(name: Column) -> Column:
    return F.lower(F.trim(name))


def weaker(confidence: Column) -> Column:
    """One band less confident; low stays."""
    return F.when(confidence == "high", "medium").when(confidence == "medium", "low").otherwise(confidence)


#: The band below a severity, and its score.
BELOW = {"critical": ("high", 55), "high": ("medium", 40), "medium": ("low", 20)}


def demoted(level: Column) -> Column:
    """Struct of severity and score one band below; what is below medium becomes informational with a score of 0."""
    below = F.struct(F.lit("informational").alias("severity"), F.lit(0).cast("long").alias("score"))
    for name, (band, score) in BELOW.items():
        below = F.when(level == name, F.struct(F.lit(band).alias("severity"), F.lit(score).cast("long").alias("score"))).otherwise(below)
    return below
