"""Activity accounting and baselines: counts by tool, path class and host; what is new against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.activity import host_identity, network_hosts, normalised_tool, path_classes, record_kind

KEY = ["client", "agent", "model", "provider"]
#: Points for each new value, and earlier tool calls that a baseline needs.
POINTS, LEAST_CALLS, MOST_TOKEN = 5, 5, 4096


def account(obs: DataFrame, keys=("source_instance", "session_id")) -> DataFrame:
    """Record counts by kind of each session."""
    kind = record_kind(F.col("family"), F.col("stage"), F.col("role"))
    return obs.withColumn("_kind", kind).groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("_kind") == k).alias(k) for k in ("user", "assistant", "tool_call", "tool_result", "session_meta", "other")])


def tool_usage(obs: DataFrame, keys=("source_instance", "session_id")) -> DataFrame:
    """Calls of each tool, the place and time of the first."""
    calls = obs.where((F.col("family") == "tool") & F.col("tool_name").isNotNull())
    return calls.groupBy(*keys, "tool_name").agg(F.count(F.lit(1)).alias("calls"), F.min("source_sequence").alias("first_order"), F.min_by("occurred_at", "source_sequence").alias("first_at"))


def attest(obs: DataFrame, keys=("source_instance", "session_id")) -> DataFrame:
    """Agent, model and provider of each session, null and ambiguous where values conflict."""
    names = ("agent", "model", "provider")
    per = obs.groupBy(*keys).agg(*[F.collect_set(n).alias(n) for n in names])
    return per.select(*keys, *[F.when(F.size(n) == 1, F.col(n)[0]).alias(n) for n in names], (F.size("agent") > 1).alias("ambiguous_agent"), ((F.size("model") > 1) | (F.size("provider") > 1) | (F.size("agent") > 1)).alias("ambiguous"))


def activity_contributions(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, dimension, value, n): tool calls, path classes and hosts that texts and calls name. Longer tokens than MOST_TOKEN are prose and count for nothing."""
    none = F.array().cast("array<string>")
    said = F.concat_ws(" ", "text", "command", "arguments", "file_path", "url")
    short = F.array_join(F.filter(F.split(said, r"\s+"), lambda t: F.length(t) <= MOST_TOKEN), " ")
    pair = lambda dim, values: F.transform(values, lambda v: F.struct(F.lit(dim).alias("dimension"), v.alias("value")))
    tool = F.when((F.col("family") == "tool") & F.col("tool_name").isNotNull(), F.array(normalised_tool(F.col("tool_name")))).otherwise(none)
    facts = F.concat(pair("tool", tool), pair("path_class", path_classes(short)), pair("network_host", F.transform(network_hosts(short), host_identity)))
    return obs.select(*keys, F.explode(facts).alias("f")).groupBy(*keys, F.col("f.dimension").alias("dimension"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def build_baseline(contributions: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return contributions.groupBy(*keys, "dimension", "value").agg(F.sum("n").alias("n"))


def merge_baselines(a: DataFrame, b: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return build_baseline(a.unionByName(b), keys)


def baseline_deviation(current: DataFrame, base: DataFrame, keys: list[str] = KEY, least_calls: int = LEAST_CALLS, points: int = POINTS) -> DataFrame:
    """(keys…, new_tools, new_path_classes, new_hosts, risk_modifier): values of ``current`` that ``base`` has never seen, ``points`` each.

    Only keys with a known model and provider and at least ``least_calls`` earlier tool calls are judged, and only deviations are returned.
    """
    judged = base.where("dimension = 'tool'").groupBy(*keys).agg(F.sum("n").alias("_calls")).where(F.col("_calls") >= least_calls).drop("_calls")
    for k in ("model", "provider"):
        if k in keys:
            judged = judged.where(F.col(k).isNotNull())

    def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"_{k}") for k in on]).distinct()
        cond = F.lit(True)
        for k in on:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return left.join(r, cond, how)

    new = null_safe(current.select(*keys, "dimension", "value").distinct(), base, [*keys, "dimension", "value"], "left_anti")
    new = null_safe(new, judged, list(keys), "left_semi")
    count = lambda dim: F.count_if(F.col("dimension") == dim)
    return new.groupBy(*keys).agg(count("tool").alias("new_tools"), count("path_class").alias("new_path_classes"), count("network_host").alias("new_hosts"), (F.count(F.lit(1)) * points).alias("risk_modifier"))


def mcp_usage(calls: DataFrame, servers: DataFrame, most_tools: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(usage, unattributed) of tool calls (session, client, tool_name, occurred_at) by configured servers with declared tools.

    A tool that several servers declare counts for each. ``servers`` is a dimension, broadcast if it declares at most ``most_tools`` tools, else joined by shuffle.
    """
    declared = servers.select("client", "server", F.explode("declared_tools").alias("_tool")).select("client", "server", normalised_tool(F.col("_tool")).alias("tool")).distinct()
    if declared.limit(most_tools + 1).count() <= most_tools:
        declared = F.broadcast(declared)
    keyed = calls.withColumn("tool", normalised_tool(F.col("tool_name")))
    per_tool = keyed.join(declared, ["client", "tool"]).groupBy("session_id", "client", "server", "tool").agg(F.count(F.lit(1)).alias("calls"), F.min("occurred_at").alias("first_at"))
    usage = per_tool.groupBy("session_id", "client", "server").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "calls")))).alias("tools"), F.sum("calls").alias("total"), F.min("first_at").alias("first_at"))
    known = declared.select("client", "tool").distinct()
    return usage, keyed.join(known, ["client", "tool"], "left_anti").groupBy("session_id", "client").agg(F.count(F.lit(1)).alias("unattributed"))
