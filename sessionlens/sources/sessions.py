"""Session stores to observations: readers, one normaliser for each client, quarantine and source checks.

Every normaliser takes lines (client, source_id, source_kind, source_path, ordinal, value) and returns observations in the
fixed schema with one more column, ``quarantine_code``, that is null for good rows; :func:`split_quarantine` parts them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.activity import argument_urls, tool_kind, url_host, written_paths
from sessionlens.operators.predicates import cut_values
from sessionlens.schemas import OBSERVATIONS, struct

MOST_RECORD = 8 * 1024 * 1024
"""Longest record that is parsed, in bytes; longer ones are quarantined."""
MS = "long"


def _bare(path: Column) -> Column:
    """A path without the local scheme, whatever its number of slashes."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_sessions(spark: SparkSession, path: str | dict[str, str], client: str | None = None, kind: str = "sessions") -> DataFrame:
    """Lines of all files below ``path`` with an ordinal that follows their order in the file.

    ``path`` is one client's folder, or the folders of many clients by name: they are read by one scan, and a file belongs to
    the client whose folder is the longest that holds it.

    The ordinal is the byte where the line's block starts plus the line's place in the block. A block has no more lines than
    bytes, so ordinals of later blocks are larger, and only a block's lines, never a whole file's, meet in a task.
    """
    roots = path if isinstance(path, dict) else {client: path}
    raw = spark.read.option("recursiveFileLookup", "true").text(sorted(set(roots.values()))).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    order = W.partitionBy("source_path", "_block").orderBy("_id")
    owner = F.lit(client)
    if isinstance(path, dict):
        owner = F.lit(None).cast("string")
        for name, root in sorted(path.items(), key=lambda r: len(r[1])):
            owner = F.when(_bare(F.col("source_path")).startswith(re.sub("^file:/+", "/", root).rstrip("/") + "/"), name).otherwise(owner)
    return raw.where(F.trim("value") != "").select(owner.alias("client"), F.col("source_path").alias("source_id"), F.lit(kind).alias("source_kind"), "source_path", (F.col("_block") + F.row_number().over(order) - 1).cast("long").alias("ordinal"), "value")


def read_whole_sessions(spark: SparkSession, path: str, client: str, kind: str = "sessions") -> DataFrame:
    """The same for many small files, read whole."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    lines = raw.select("source_path", F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "value"))
    return lines.where(F.trim("value") != "").select(F.lit(client).alias("client"), F.col("source_path").alias("source_id"), F.lit(kind).alias("source_kind"), "source_path", F.col("ordinal").cast("long").alias("ordinal"), "value")


def js(path: str, col: str = "value") -> Column:
    return F.get_json_object(F.col(col), path)


def checked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``bad``: why a record can't be read, else null."""
    envelope = F.trim("value").startswith("{") & F.try_parse_json(F.col("value")).isNotNull()
    return lines.withColumn("bad", F.when(F.octet_length("value") > MOST_RECORD, "record_too_long").when(~envelope, "not_an_object"))


def derived_facts(given: dict[str, Column], name: Column, arguments: Column) -> Column:
    """Facts that selectors read and no column holds, from what the record says: a map of their names, without those it doesn't say.

    An MCP server and tool come from a call named mcp__server__tool; provider and model name the inference; a native tool's kind is
    the operation on its resource; a call's url names host, port, protocol and class of the destination; a shell call
    names the process that it starts.
    """
    none = F.lit(None).cast("string")
    url, host = given["url"], url_host(given["url"])
    port = F.nullif(F.regexp_extract(url, r"^https?://[^/?#]*:(\d{1,5})(?=[/?#]|$)", 1), F.lit(""))
    local = host.rlike(r"^(localhost|127\.[0-9.]+|0\.0\.0\.0|\[?::1\]?)$")
    private = host.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|\.(local|internal|lan)$")
    mcp = lambda group: F.nullif(F.regexp_extract(name, r"^mcp__(.+?)__(.+)$", group), F.lit(""))
    kind = given["tool_kind"]
    facts = {
        "mcp.server.id": mcp(1), "mcp.tool.name": mcp(2),
        "inference.provider": given.get("provider", none), "inference.resolved_model": given.get("model", none),
        "resource.operation": F.when(kind == "file_read", "read").when(kind == "file_write", "write"),
        "network.domain": host, "network.protocol": F.regexp_extract(F.when(host.isNotNull(), F.lower(url)), "^(https?):", 1),
        "network.port": F.when(host.isNotNull(), F.coalesce(port, F.when(F.lower(url).startswith("https:"), "443").otherwise("80"))),
        "network.destination_class": F.when(local, "loopback").when(private, "private").when(host.isNotNull(), "public"),
        "process.name": F.nullif(F.regexp_extract(F.when(kind == "shell", given["command"]), r"^\s*(?:[A-Za-z_]\w*=\S*\s+)*(?:\S*/)?([\w.+-]+)", 1), F.lit("")),
        "tool.arguments.keys": F.array_join(F.array_sort(F.json_object_keys(arguments)), ","),
    }
    return F.map_filter(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def fill(df: DataFrame, **columns) -> DataFrame:
    """Observations with these columns; ids, hashes, times and tool facts are derived, what nobody gives is null."""
    given = dict(columns)
    call_args = given.get("arguments", F.lit(None).cast("string"))
    name = given.get("tool_name", F.lit(None).cast("string"))
    given.setdefault("tool_kind", tool_kind(name))
    given.setdefault("command", F.when(tool_kind(name) == "shell", F.coalesce(F.get_json_object(call_args, "$.command"), F.get_json_object(call_args, "$.cmd"))))
    given.setdefault("url", F.get(argument_urls(call_args), F.lit(0)))
    given.setdefault("written_path", F.get(written_paths(name, call_args), F.lit(0)))
    given.setdefault("file_path", F.coalesce(*[F.get_json_object(call_args, f"$.{k}") for k in ("file_path", "path", "filePath", "notebook_path", "absolute_path", "target_file", "file", "filename")]))
    given.setdefault("caps", F.create_map(*[x for k in ("tool_call", "tool_execution", "user_context") for x in (F.lit(k), F.lit("supported"))]))
    given.setdefault("extra", derived_facts(given, name, call_args))
    given.setdefault("source_sequence", F.col("ordinal"))
    given.setdefault("child_ordinal", F.lit(0))
    given.setdefault("ingestion_mode", F.lit("batch"))
    given.setdefault("session_origin", F.when(given["session_id"].isNotNull(), "native").otherwise("missing"))
    raw = given.get("occurred_at_raw", F.lit(None).cast("string"))
    out = df.withColumns({f"_o_{k}": v for k, v in given.items()})
    base = {"client": F.col("client"), "source_id": F.col("source_id"), "source_kind": F.col("source_kind"), "source_path": F.col("source_path"), "source_path_hash": F.sha2("source_path", 256), "source_instance": F.concat_ws(":", "client", "source_id"), "occurred_at": F.try_to_timestamp(raw), "observed_at": F.current_timestamp()}
    base["observation_id"] = F.concat(F.lit("obs:"), F.sha2(F.concat_ws("\u0001", "client", "source_id", F.col("_o_source_sequence").cast("string"), F.col("_o_child_ordinal").cast("string")), 256))
    cols = []
    for f in struct(OBSERVATIONS):
        value = F.col(f"_o_{f.name}") if f.name in given else base.get(f.name, F.lit(None))
        cols.append(value.cast(f.dataType).alias(f.name))
    bad = F.col("bad") if "bad" in df.columns else F.lit(None).cast("string")
    return out.select(*cols, bad.alias("quarantine_code"))


def carried(col: Column, order: str = "ordinal") -> Column:
    """The last value seen so far in the file."""
    return F.last(col, ignorenulls=True).over(W.partitionBy("client", "source_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0))


BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,arguments:string,tool_use_id:string,content:string,is_error:boolean>>"


def as_blocks(content: Column) -> Column:
    """The blocks of a message's content; a plain string is one text block."""
    text = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("thinking", "id", "name", "input", "arguments", "tool_use_id", "content")], F.lit(None).cast("boolean").alias("is_error")))
    return F.when(F.trim(content).startswith("["), F.from_json(content, BLOCKS)).when(content.isNotNull(), text.cast(BLOCKS))


def block_text(col: Column) -> Column:
    """Text of a result: a string as it is, an array of text parts joined by newlines."""
    parts = F.from_json(col, "array<struct<type:string,text:string>>")
    return F.when(F.trim(col).startswith("[{"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(col)


@dataclass(frozen=True)
class Client:
    """How one client's lines become observations, as expressions over ``value`` and the columns made before.

    ``steps`` make columns one after the other, ``carries`` are values that hold until the next in the file, ``keep`` picks the
    records, ``blocks`` lists what a record holds (none: the record itself), ``facts`` gives the observation's columns with the
    block as ``b``. ``c`` names the client's own columns.
    """

    name: str
    keep: Callable
    facts: Callable
    steps: tuple[Callable, ...] = ()
    carries: Callable | None = None
    blocks: Callable | None = None
    envelope: bool = True
    unreadable: Callable | None = field(default=None)


CLIENTS: dict[str, Client] = {}


def _client(**parts) -> Client:
    made = Client(**parts)
    CLIENTS[made.name] = made
    return made


def normalise(lines: DataFrame, clients: list[Client] | None = None, most_value: int | None = None) -> DataFrame:
    """Observations of lines of any of ``clients``, which the column ``client`` tells apart, in one pass over the lines.

    Each client's expressions are evaluated on its own lines only. All that is carried along a file comes from one window over
    (client, file). Lines of no known client are quarantined. Values of over ``most_value`` characters are cut and marked as cut.
    """
    clients = list(CLIENTS.values()) if clients is None else clients
    alone = len(clients) == 1
    own = {cl.name: F.lit(True) if alone else F.col("client") == cl.name for cl in clients}
    names = {cl.name: (lambda n, p=cl.name: F.col(f"_{p}_{n}")) for cl in clients}

    def chosen(values: dict[str, Column], kind: str | None = None) -> Column:
        out = F.lit(None)
        for name, value in values.items():
            value = value if kind is None else value.cast(kind)
            out = value if alone else F.when(own[name], value).otherwise(out)
        return out

    def made(df: DataFrame, columns: dict[str, dict[str, Column]], wrap: Callable = lambda x: x) -> DataFrame:
        return df.withColumns({f"_{name}_{k}": wrap(v if alone else F.when(own[name], v)) for name, given in columns.items() for k, v in given.items()})

    envelope = F.trim("value").startswith("{") & F.try_parse_json(F.col("value")).isNotNull()
    json = reduce(lambda x, y: x | y, [own[cl.name] for cl in clients if cl.envelope], F.lit(False))
    bad = F.when(F.octet_length("value") > MOST_RECORD, "record_too_long").when(json & ~envelope, "not_an_object")
    if not alone:
        bad = F.when(~F.coalesce(F.col("client").isin(*own), F.lit(False)), "unknown_client").otherwise(bad)
    df = lines.withColumn("bad", bad)
    for n in range(max(len(cl.steps) for cl in clients)):
        df = made(df, {cl.name: cl.steps[n](names[cl.name]) for cl in clients if n < len(cl.steps)})
    if any(cl.carries for cl in clients):
        df = made(df, {cl.name: cl.carries(names[cl.name]) for cl in clients if cl.carries}, carried)
    late = {cl.name: cl.unreadable(names[cl.name]) for cl in clients if cl.unreadable}
    if late:
        df = df.withColumn("bad", F.coalesce("bad", chosen(late, "string")))
    kept = reduce(lambda x, y: x | y, [own[cl.name] & F.coalesce(cl.keep(names[cl.name]), F.lit(False)) for cl in clients])
    df = df.where(F.col("bad").isNotNull() | kept)
    held = {cl.name: cl.blocks(names[cl.name]) for cl in clients if cl.blocks}
    df = df.select("*", F.posexplode_outer(F.when(F.col("bad").isNull(), chosen(held, BLOCKS))).alias("child", "b")) if held else df.withColumns({"child": F.lit(0), "b": F.lit(None).cast(BLOCKS[6:-1])})
    facts = {cl.name: cl.facts(names[cl.name]) for cl in clients}
    kinds = {f.name: f.dataType for f in struct(OBSERVATIONS)}
    every = [f for f in kinds if any(f in given for given in facts.values())]
    df = df.withColumns({f"_g_{f}": chosen({name: given[f] for name, given in facts.items() if f in given}, kinds[f].simpleString()) for f in every})
    out = fill(df, child_ordinal=F.coalesce("child", F.lit(0)), **{f: F.col(f"_g_{f}") for f in every})
    return out if most_value is None else cut_values(out, most_value)


def _claude_facts(c) -> dict:
    call, result = F.col("b.type") == "tool_use", F.col("b.type") == "tool_result"
    said = ~F.coalesce(call | result, F.lit(False))
    return dict(
        session_id=js("$.sessionId"), native_id=js("$.uuid"), occurred_at_raw=js("$.timestamp"), model=js("$.message.model"), agent=F.lit("claude"), provider=F.lit("anthropic"),
        family=F.when(call | result, "tool").otherwise("message"), stage=F.when(call, "requested").when(result, "result").otherwise("recorded"), role=F.when(said, F.coalesce(js("$.message.role"), c("type"))),
        text=F.when(said, F.coalesce("b.text", "b.thinking")), call_id=F.when(call, F.col("b.id")).when(result, F.col("b.tool_use_id")), tool_name=F.when(call, F.col("b.name")), arguments=F.when(call, F.col("b.input")),
        tool_result=F.when(result, block_text(F.col("b.content"))), is_error=F.when(result, F.coalesce("b.is_error", F.lit(False))))


#: Messages, tool calls and tool results from the blocks of user and assistant records.
CLAUDE = _client(
    name="claude", steps=(lambda c: {"type": js("$.type"), "content": js("$.message.content")},),
    keep=lambda c: c("type").isin("user", "assistant"), blocks=lambda c: as_blocks(c("content")), facts=_claude_facts)


def _codex_facts(c) -> dict:
    k, meta = c("kind"), c("type") == "session_meta"
    call, result = k.isin("tool_call", "function_call", "local_shell_call"), k.isin("function_call_output", "tool_result")
    said = k.isin("user_message", "assistant_message", "agent_message", "message")
    args = F.coalesce(js("$.payload.arguments"), F.when(js("$.payload.command").isNotNull(), F.to_json(F.struct(js("$.payload.command").alias("command")))))
    return dict(
        session_id=c("session"), occurred_at_raw=js("$.timestamp"), agent=F.coalesce(c("agent"), F.lit("codex")), model=c("model"), provider=c("provider"),
        family=F.when(meta, "session").when(call | result, "tool").when(said, "message").otherwise("other"), stage=F.when(call, "requested").when(result, "result").otherwise("recorded"),
        role=F.when(k == "user_message", "user").when(k.isin("assistant_message", "agent_message"), "assistant").when(k == "message", js("$.payload.role")), text=F.when(said, F.coalesce(js("$.payload.message"), block_text(js("$.payload.content")))),
        call_id=js("$.payload.call_id"), tool_name=F.when(call, F.coalesce(js("$.payload.name"), js("$.payload.tool_name"), F.lit("shell"))), arguments=F.when(call, args), tool_result=F.when(result, js("$.payload.output")))


def _codex_carries(c) -> dict:
    meta = c("type") == "session_meta"
    return {
        "session": F.when(meta, F.coalesce(js("$.session_id"), js("$.payload.id"))), "provider": F.when(meta, js("$.payload.model_provider")),
        "model": F.when(meta | (c("type") == "turn_context"), js("$.payload.model")), "agent": F.when(meta, js("$.payload.agent_nickname"))}


#: Messages, calls and outputs; session, provider and model come from the file's last session_meta line before each row.
CODEX = _client(
    name="codex", steps=(lambda c: {"type": js("$.type"), "kind": js("$.payload.type")},), carries=_codex_carries,
    keep=lambda c: c("type").isin("session_meta", "event_msg", "response_item"), facts=_codex_facts)


def _flat(name: str) -> Client:
    """Qwen's and OpenClaw's lines: one record is one observation."""
    def facts(c) -> dict:
        t = c("type")
        call, result = t == "tool_call", t == "tool_result"
        return dict(
            session_id=js("$.sessionId"), native_id=js("$.id"), occurred_at_raw=js("$.timestamp"), agent=F.coalesce(js("$.agent"), F.lit(name)), provider=js("$.provider"), model=js("$.model"),
            family=F.when(call | result, "tool").otherwise("message"), stage=F.when(call, "requested").when(result, "result").otherwise("recorded"), role=F.when(t.isin("user", "assistant"), t), text=F.when(t.isin("user", "assistant"), block_text(js("$.content"))),
            call_id=F.coalesce(js("$.callId"), js("$.call_id")), tool_name=F.when(call | result, F.coalesce(js("$.name"), js("$.tool"))), arguments=F.when(call, F.coalesce(js("$.input"), js("$.arguments"))), tool_result=F.when(result, F.coalesce(block_text(js("$.content")), js("$.output"))))

    return _client(name=name, steps=(lambda c: {"type": js("$.type")},), keep=lambda c: c("type").isin("user", "assistant", "tool_call", "tool_result"), facts=facts)


QWEN, OPENCLAW = _flat("qwen"), _flat("openclaw")


def _pi_tool(c) -> tuple[Column, Column]:
    return F.coalesce(c("role") == "bashExecution", F.lit(False)), F.coalesce(c("role").isin("toolResult", "tool"), F.lit(False))


def _pi_facts(c) -> dict:
    bash, result = _pi_tool(c)
    call = F.coalesce(F.col("b.type") == "toolCall", F.lit(False))
    tool = call | bash | result
    return dict(
        session_id=c("session"), native_id=js("$.id"), occurred_at_raw=js("$.timestamp"), agent=F.lit("pi"), provider=js("$.message.provider"), model=js("$.message.model"),
        family=F.when(c("type") == "session", "session").when(tool, "tool").otherwise("message"), stage=F.when(result, "result").when(call, "requested").when(bash, "completed").otherwise("recorded"), role=F.when(~tool, c("role")), text=F.when(~tool, F.coalesce("b.text", "b.thinking")),
        call_id=F.when(call, F.col("b.id")).when(result, js("$.message.toolCallId")), tool_name=F.when(call, F.col("b.name")).when(bash, "bash").when(result, js("$.message.toolName")), arguments=F.when(call, F.col("b.arguments")).when(bash, F.to_json(F.struct(js("$.message.command").alias("command")))),
        tool_result=F.when(result, block_text(js("$.message.content"))).when(bash, js("$.message.output")), is_error=F.when(result, js("$.message.isError").cast("boolean")), exit_code=F.when(bash, F.expr("try_cast(get_json_object(value, '$.message.exitCode') as bigint)")))


#: Messages with their blocks, tool results and bash executions; the session line names the session of its file.
PI = _client(
    name="pi", steps=(lambda c: {"type": js("$.type"), "role": js("$.message.role")},), carries=lambda c: {"session": F.when(c("type") == "session", js("$.id"))},
    keep=lambda c: c("type").isin("session", "message"), blocks=lambda c: as_blocks(F.when(~(_pi_tool(c)[0] | _pi_tool(c)[1]), js("$.message.content"))), facts=_pi_facts)

LOG_LINE = r"^(\S+)\s+\[(\w+)\]\s+(.*)$"
CALLS = "array<struct<type:string,id:string,call_id:string,name:string,arguments:string,status:string>>"


def _copilot_blocks(c) -> Column:
    none = lambda n: F.lit(None).cast("string").alias(n)
    return F.transform(F.filter(c("items"), lambda i: i["type"] == "function_call"), lambda i: F.struct(
        i["type"].alias("type"), none("text"), none("thinking"), i["id"].alias("id"), i["name"].alias("name"), none("input"), i["arguments"].alias("arguments"), i["call_id"].alias("tool_use_id"), i["status"].alias("content"), F.lit(None).cast("boolean").alias("is_error")))


def _copilot_facts(c) -> dict:
    call = F.col("b").isNotNull()
    return dict(
        session_id=c("session"), native_id=F.col("b.id"), occurred_at_raw=c("at"), agent=F.lit("copilot"), provider=F.lit("github"), family=F.when(call, "tool").otherwise("session"), stage=F.when(call, "requested").otherwise("recorded"),
        call_id=F.col("b.tool_use_id"), tool_name=F.col("b.name"), arguments=F.col("b.arguments"), reported_status=F.col("b.content"))


#: Calls that a process log accumulates, in the session whose workspace was last initialised; one log may hold several sessions.
COPILOT = _client(
    name="copilot", envelope=False,
    steps=(
        lambda c: {"at": F.regexp_extract("value", LOG_LINE, 1), "said": F.regexp_extract("value", LOG_LINE, 3)},
        lambda c: {"body": F.regexp_extract(c("said"), r"^Accumulated output items \(\d+\): (.*)$", 1)},
        lambda c: {"items": F.when(c("body") != "", F.from_json(c("body"), CALLS))}),
    carries=lambda c: {"session": F.nullif(F.regexp_extract(c("said"), r"^Workspace initialized: (\S+)", 1), F.lit(""))},
    unreadable=lambda c: F.when((c("body") != "") & c("items").isNull(), "unreadable_items"),
    keep=lambda c: c("said").startswith("Workspace initialized:") | (c("body") != ""), blocks=_copilot_blocks, facts=_copilot_facts)


def normalize_claude(lines: DataFrame) -> DataFrame:
    return normalise(lines, [CLAUDE])


def normalize_codex(lines: DataFrame) -> DataFrame:
    return normalise(lines, [CODEX])


def normalize_qwen(lines: DataFrame) -> DataFrame:
    return normalise(lines, [QWEN])


def normalize_openclaw(lines: DataFrame) -> DataFrame:
    return normalise(lines, [OPENCLAW])


def normalize_pi(lines: DataFrame) -> DataFrame:
    return normalise(lines, [PI])


def normalize_copilot(lines: DataFrame) -> DataFrame:
    return normalise(lines, [COPILOT])


def normalize_opencode(parts: DataFrame, messages: DataFrame, client: str = "opencode") -> DataFrame:
    """Tool and text parts with their message's session and model. Parts whose message is missing stay, without a session."""
    m = messages.select(F.col("id").alias("_mid"), "session_id", F.col("data").alias("mdata"))
    df = parts.drop("session_id").where(F.get_json_object("data", "$.type").isin("tool", "text")).join(m, F.col("message_id") == F.col("_mid"), "left")
    df = df.withColumns({"client": F.lit(client), "source_id": F.coalesce("session_id", F.lit("store")), "source_kind": F.lit("store"), "source_path": F.lit("store"), "ordinal": F.col("rowid"), "value": F.col("data"), "bad": F.when(F.try_parse_json(F.col("data")).isNull(), "not_an_object")})
    tool = js("$.type") == "tool"
    done = js("$.state.status").isin("completed", "error")
    return fill(
        df, session_id=F.col("session_id"), native_id=F.col("message_id"), occurred_at_raw=F.timestamp_millis(F.col("time_updated")).cast("string"), model=F.get_json_object("mdata", "$.modelID"), provider=F.get_json_object("mdata", "$.providerID"), agent=F.coalesce(F.get_json_object("mdata", "$.agent"), F.lit("opencode")),
        family=F.when(tool, "tool").otherwise("message"), stage=F.when(tool & done, "completed").when(tool, "requested").otherwise("recorded"), role=F.when(~tool, F.get_json_object("mdata", "$.role")), text=F.when(~tool, js("$.text")), call_id=F.when(tool, js("$.callID")), tool_name=F.when(tool, js("$.tool")), arguments=F.when(tool, js("$.state.input")), tool_result=F.when(tool, js("$.state.output")), is_error=F.when(tool & done, js("$.state.status") == "error"))


def read_incremental(parts: DataFrame, high_water: int | None, overlap_ms: int = 600_000, most: int | None = 25_000) -> tuple[DataFrame, int | None]:
    """(rows, next high water) of parts changed since ``high_water`` less the overlap. Over ``most`` parts is an error, never a silent cut."""
    df = parts if high_water is None else parts.where(F.col("time_updated") >= high_water - overlap_ms)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.max("time_updated").alias("top")).first()
    if most is not None and got["n"] > most:
        raise ValueError(f"{got['n']} parts since the high-water mark; the limit is {most}")
    top = got["top"] if high_water is None or (got["top"] or 0) > high_water else high_water
    return df.orderBy("time_updated", "rowid"), top


def newest_parts(parts: DataFrame, n: int) -> DataFrame:
    """The ``n`` parts that changed last, in order of change."""
    return parts.orderBy(F.desc("time_updated"), F.desc("rowid")).limit(n).orderBy("time_updated", "rowid")


def first_sources(obs: DataFrame, n: int, client: str | None = None) -> DataFrame:
    """The first ``n`` sources in order of id and path, of one client if it is named."""
    sources = obs.select("client", "source_id", "source_path").distinct()
    return (sources if client is None else sources.where(F.col("client") == client)).orderBy("source_id", "source_path").limit(n)


def split_quarantine(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, quarantine): bad records leave only their coordinates and a code."""
    bad = F.col("quarantine_code").isNotNull()
    return normalised.where(~bad).drop("quarantine_code"), normalised.where(bad).select("client", "source_id", "source_path_hash", "source_sequence", "quarantine_code")


def check_unique(obs: DataFrame) -> DataFrame:
    """Observation ids that a source repeats."""
    return obs.groupBy("source_instance", "observation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def source_inventory(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by client.kind, one row with the hash over all sorted source keys)."""
    sources = obs.select("client", "source_kind", "source_id").distinct()
    counts = sources.groupBy(F.concat_ws(".", "client", "source_kind").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    # Keys are hashed in buckets first, so no task holds them all.
    keyed = sources.select(F.sha2(F.concat_ws("\u0001", "client", "source_id"), 256).alias("k"))
    bucket = keyed.groupBy(F.substring("k", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("k")), "\n"), 256).alias("h"))
    return counts, bucket.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("inventory_hash"))


def source_changes(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sources added, removed and unchanged since the snapshot before, and whether this is the first one."""
    a, b = before.select(*keys).distinct().withColumn("_a", F.lit(True)), now.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full_outer")
    n = both.agg(F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(F.col("_b").isNull()).alias("removed"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("unchanged"))
    return n.withColumn("is_baseline", F.col("removed") + F.col("unchanged") == 0)
