"""Other inputs: event journals, captured inference payloads and their streamed deltas, MCP configurations, install signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators.gold import validated
from sessionlens.schemas import EVENTS, struct
from sessionlens.sources.sessions import block_text, fill, js


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSONL journal in the fixed schema, validated; lines that are no objects are invalid rows too."""
    schema = struct(EVENTS).add("_corrupt_record", "string")
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    out = validated(df)
    bad = F.col("_corrupt_record").isNotNull()
    return out.withColumns({"valid": ~bad & F.col("valid"), "invalid_reason": F.when(bad, "unreadable_line").otherwise(F.col("invalid_reason"))}).drop("_corrupt_record")


#: Where each profile keeps its messages, its answers and their tool calls.
PROFILES = ("openai_chat", "anthropic_messages", "openai_responses", "ollama")


def normalize_inference(payloads: DataFrame, profile: str) -> DataFrame:
    """Observations of request and response JSON: (client, source_id, source_kind, source_path, ordinal, session_id, at, request, response).

    One inference observation for each payload, one message for each request message and answer, one proposed tool call for each call.
    """
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile}")
    df = payloads.withColumn("value", F.col("response"))
    message = "struct<role:string,content:string,tool_call_id:string>"
    empty = F.array().cast("array<struct<family:string,stage:string,role:string,text:string,call_id:string,name:string,arguments:string>>")
    none = F.lit(None).cast("string")

    def facts(items, family, stage, role=None, text=None, call_id=None, name=None, arguments=None):
        pick = lambda f, x: none if f is None else f(x)
        made = F.transform(items, lambda x: F.struct(F.lit(family).alias("family"), F.lit(stage).alias("stage"), pick(role, x).alias("role"), pick(text, x).alias("text"), pick(call_id, x).alias("call_id"), pick(name, x).alias("name"), pick(arguments, x).alias("arguments")))
        return F.coalesce(made, empty)

    asked = F.from_json(F.coalesce(F.get_json_object("request", "$.messages"), F.get_json_object("request", "$.input")), f"array<{message}>")
    parts = [facts(F.array(F.struct(F.lit(1))), "inference", "completed"), facts(asked, "message", "recorded", role=lambda m: m["role"], text=lambda m: block_text(m["content"]))]
    tool = lambda items: facts(items, "tool", "proposed", call_id=lambda c: c["id"], name=lambda c: c["function"]["name"], arguments=lambda c: c["function"]["arguments"])
    calls = "array<struct<id:string,function:struct<name:string,arguments:string>>>"
    if profile == "openai_chat":
        choices = F.from_json(js("$.choices"), f"array<struct<index:int,message:struct<role:string,content:string,tool_calls:{calls}>>>")
        parts += [facts(choices, "message", "recorded", role=lambda c: c["message"]["role"], text=lambda c: c["message"]["content"]), tool(F.flatten(F.transform(choices, lambda c: F.coalesce(c["message"]["tool_calls"], F.array().cast(calls)))))]
    elif profile == "ollama":
        parts += [facts(F.when(js("$.message").isNotNull(), F.array(F.struct(js("$.message.role").alias("role"), js("$.message.content").alias("content")))), "message", "recorded", role=lambda m: m["role"], text=lambda m: m["content"]), tool(F.from_json(js("$.message.tool_calls"), calls))]
    else:
        block = "array<struct<type:string,text:string,id:string,call_id:string,name:string,input:string,arguments:string,role:string,content:string>>"
        blocks = F.from_json(js("$.content" if profile == "anthropic_messages" else "$.output"), block)
        said = F.filter(blocks, lambda b: b["type"].isin("text", "message"))
        called = F.filter(blocks, lambda b: b["type"].isin("tool_use", "function_call"))
        parts += [facts(said, "message", "recorded", role=lambda b: F.coalesce(b["role"], F.lit("assistant")), text=lambda b: F.coalesce(b["text"], block_text(b["content"]))), facts(called, "tool", "proposed", call_id=lambda b: F.coalesce(b["call_id"], b["id"]), name=lambda b: b["name"], arguments=lambda b: F.coalesce(b["input"], b["arguments"]))]
    df = df.withColumn("bad", F.when(F.try_parse_json(F.col("response")).isNull(), "unreadable_response")).select("*", F.posexplode(F.concat(*parts)).alias("child", "f"))
    return fill(df, session_id=F.col("session_id"), occurred_at_raw=F.col("at"), model=F.coalesce(js("$.model"), F.get_json_object("request", "$.model")), provider=F.lit(profile.split("_")[0]), native_id=js("$.id"), child_ordinal=F.col("child"), family=F.col("f.family"), stage=F.col("f.stage"), role=F.col("f.role"), text=F.col("f.text"), call_id=F.col("f.call_id"), tool_name=F.col("f.name"), arguments=F.col("f.arguments"), extra=F.create_map(F.lit("inference.finish_reason"), F.coalesce(js("$.choices[0].finish_reason"), js("$.stop_reason"), js("$.done_reason"))))


def assemble_deltas(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, conflicts) of chunks (response_id, seq, choice_index, tool_index, delta, finish_reason).

    Deltas join in order of seq. A response with two different deltas or finish reasons in one place is a conflict and gives no text.
    The text of a response whose deltas are all null is null.
    """
    keys = ["response_id", "choice_index", "tool_index"]
    # two different values show in their least and largest, so no set of values is built
    differ = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    same = chunks.groupBy(*keys, "seq").agg(differ("delta").alias("differ"), F.min("delta").alias("delta"), F.max("finish_reason").alias("finish_reason"))
    ends = chunks.where("finish_reason is not null").groupBy("response_id", "choice_index").agg(differ("finish_reason").alias("differ"))
    conflicts = same.where("differ").select("response_id").unionByName(ends.where("differ").select("response_id")).distinct()
    ok = same.join(conflicts, "response_id", "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "")
    texts = ok.groupBy(*keys).agg(F.when(F.count("delta") > 0, joined).alias("text"), F.max("finish_reason").alias("finish_reason"), F.count(F.lit(1)).alias("chunks"))
    return texts, conflicts


def mcp_inventory(configs: DataFrame) -> DataFrame:
    """(client, server, transport, command, package, url_host, declared_tools, env_keys) of JSON configs (client, text).

    Servers may stand under mcpServers, servers, mcp or mcp_servers. Values of environment variables are never kept.
    """
    server = "struct<type:string,transport:string,command:string,args:array<string>,url:string,tools:array<string>,env:map<string,string>>"
    found = F.coalesce(*[F.from_json(F.get_json_object("text", p), f"map<string,{server}>") for p in ("$.mcpServers", "$.servers", "$.mcp.servers", "$.mcp", "$.mcp_servers")])
    df = configs.select("client", F.explode(found).alias("server", "s"))
    package = F.get(F.filter(F.coalesce("s.args", F.array().cast("array<string>")), lambda a: a.rlike(r"^@?[a-z0-9][a-z0-9._-]*(/[a-z0-9._-]+)?(@[\w.^~-]+)?$") & ~a.startswith("-")), F.lit(0))
    return df.select(
        "client", "server", F.coalesce("s.transport", "s.type", F.when(F.col("s.url").isNotNull(), "http").otherwise("stdio")).alias("transport"), F.nullif(F.regexp_extract(F.coalesce("s.command", F.lit("")), r"([^/\\]*)$", 1), F.lit("")).alias("command"), package.alias("package"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("s.url", F.lit("")), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("")).alias("url_host"), F.array_sort(F.coalesce("s.tools", F.array().cast("array<string>"))).alias("declared_tools"), F.array_sort(F.map_keys(F.coalesce("s.env", F.create_map().cast("map<string,string>")))).alias("env_keys"))


def install_inventory(signals: DataFrame) -> DataFrame:
    """(host, agent, status) of signals (host, agent, kind, name, present).

    confirmed if an executable, package or extension is present, though a bare `copilot` executable doesn't confirm; partial on any signal, else absent.
    """
    strong = F.col("present") & F.col("kind").isin("executable", "package", "extension") & ~((F.col("kind") == "executable") & (F.col("name") == "copilot"))
    return signals.groupBy("host", "agent").agg(F.when(F.bool_or(strong), "confirmed").when(F.bool_or("present"), "partial").otherwise("absent").alias("status"))
