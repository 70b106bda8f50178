"""Driver tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators.rules import Matcher, Rule
from sessionlens.schemas import OBSERVATIONS, struct

CAPS = ("tool_call", "tool_execution", "user_context")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(df: DataFrame, **columns) -> DataFrame:
    """Observations with these columns; all others are null."""
    caps = F.create_map(*[x for k in CAPS for x in (F.lit(k), F.lit("supported"))])
    given = {"caps": caps} | columns
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(OBSERVATIONS)])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as message observations of a session for each conversation."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    return observations(c, client=F.lit("conversations"), source_id=F.lit("table"), source_kind=F.lit("table"), source_path=F.lit("conversations"), source_path_hash=F.sha2(F.lit("conversations"), 256), source_instance=F.lit("conversations"), observation_id=key, family=F.lit("message"), stage=F.lit("recorded"), source_sequence=F.col("turn"), child_ordinal=F.lit(0), session_id=F.col("conv_id").cast("string"), role=F.col("role"), text=F.col("text"), agent=F.lit("chat"), model=F.concat(F.lit("m"), F.col("conv_id") % 3), provider=F.lit("p"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool observations of a session for each user: errors are results of calls, the rest are calls."""
    e = table(spark, sf_dir, "events")
    result = F.col("event_type") == "error"
    return observations(e, client=F.concat(F.lit("c"), F.col("user_id") % 3), source_id=F.lit("events"), source_kind=F.lit("table"), source_path=F.lit("events"), source_path_hash=F.sha2(F.lit("events"), 256), source_instance=F.lit("events"), observation_id=F.col("event_id").cast("string"), family=F.lit("tool"), stage=F.when(result, "result").otherwise("requested"), source_sequence=F.col("event_id"), child_ordinal=F.lit(0), occurred_at=F.col("ts").cast("timestamp"), session_id=F.col("user_id").cast("string"), tool_name=F.col("event_type"), arguments=F.col("props"), agent=F.concat(F.lit("a"), F.col("user_id") % 2), model=F.lit("m"), provider=F.lit("p"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: the value is the score, rules are the event type and, on even ids, a second one."""
    e = table(spark, sf_dir, "events")
    points = F.floor(F.col("value")).cast("long")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("event_time"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("detection").alias("event_type"),
        F.when(points >= 90, "critical").when(points >= 70, "high").when(points >= 50, "medium").when(points >= 20, "low").otherwise("informational").alias("severity"), points.alias("risk_score"),
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("client"), F.concat(F.lit("a"), F.col("user_id") % 7).alias("agent"), F.lit("m").alias("model"), F.lit("p").alias("provider"), F.col("user_id").cast("string").alias("session_id"), F.sha2(F.lit("events"), 256).alias("source_path_hash"), F.col("event_type").alias("tool_name"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.col("event_type"), F.lit("rule.even"))).otherwise(F.array("event_type")).alias("rule_ids"), F.array(F.when(F.col("event_type") == "error", "mcp").otherwise("network")).alias("categories"))


WORD_RULES = (
    Rule("word.the", "english", 20, "low", (Matcher("user_context", r"(^|[^a-z])the([^a-z]|$)"), Matcher("assistant_context", r"(^|[^a-z])the([^a-z]|$)"))),
    Rule("word.und", "german", 30, "medium", (Matcher("user_context", r"(^|[^a-z])und([^a-z]|$)", r"(^|[^a-z])nicht([^a-z]|$)"), Matcher("assistant_context", r"(^|[^a-z])und([^a-z]|$)", r"(^|[^a-z])nicht([^a-z]|$)"))),
    Rule("word.les", "french", 35, "medium", (Matcher("user_context", r"(^|[^a-z])les([^a-z]|$)"),)),
    Rule("word.para", "spanish", 45, "medium", (Matcher("assistant_context", r"(^|[^a-z])para([^a-z]|$)"),)),
    Rule("word.with", "english", 15, "low", (Matcher("assistant_context", r"(^|[^a-z])with([^a-z]|$)"),)),
)
CHAINS = "id string, score long, when_all_categories array<string>, when_all_rule_ids array<string>, link struct<calls:int,order:string,minutes:int>, explanation string"


def word_chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("chain.english", 40, None, ["word.the", "word.with"], None, "both words"), ("chain.mixed", 25, ["english", "german"], None, None, "two languages")], CHAINS)


#: The same for DuckDB: (session_id, observation_id, rule_id, field) of every match.
MATCH_SQL = r"""
t AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS session_id, conv_id || ':' || turn AS observation_id,
  CASE WHEN role = 'user' THEN text END AS u, CASE WHEN role = 'assistant' THEN text END AS a FROM conversations),
m AS (
  SELECT session_id, observation_id, 'word.the' AS rule_id, 'user_context' AS field, u AS value FROM t WHERE regexp_matches(u, '(^|[^a-z])the([^a-z]|$)')
  UNION ALL SELECT session_id, observation_id, 'word.the', 'assistant_context', a FROM t WHERE regexp_matches(a, '(^|[^a-z])the([^a-z]|$)')
  UNION ALL SELECT session_id, observation_id, 'word.und', 'user_context', u FROM t WHERE regexp_matches(u, '(^|[^a-z])und([^a-z]|$)') AND NOT regexp_matches(u, '(^|[^a-z])nicht([^a-z]|$)')
  UNION ALL SELECT session_id, observation_id, 'word.und', 'assistant_context', a FROM t WHERE regexp_matches(a, '(^|[^a-z])und([^a-z]|$)') AND NOT regexp_matches(a, '(^|[^a-z])nicht([^a-z]|$)')
  UNION ALL SELECT session_id, observation_id, 'word.les', 'user_context', u FROM t WHERE regexp_matches(u, '(^|[^a-z])les([^a-z]|$)')
  UNION ALL SELECT session_id, observation_id, 'word.para', 'assistant_context', a FROM t WHERE regexp_matches(a, '(^|[^a-z])para([^a-z]|$)')
  UNION ALL SELECT session_id, observation_id, 'word.with', 'assistant_context', a FROM t WHERE regexp_matches(a, '(^|[^a-z])with([^a-z]|$)')),
rules(rule_id, category, points, severity) AS (VALUES ('word.the', 'english', 20, 'low'), ('word.und', 'german', 30, 'medium'), ('word.les', 'french', 35, 'medium'), ('word.para', 'spanish', 45, 'medium'), ('word.with', 'english', 15, 'low'))
"""
DETECTION_SQL = """
d AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS eid, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CAST(floor(value) AS BIGINT) AS risk_score,
  'c' || (user_id % 3) AS client, 'a' || (user_id % 7) AS agent, CAST(user_id AS VARCHAR) AS session_id, event_type AS tool_name,
  CASE WHEN event_id % 2 = 0 THEN [event_type, 'rule.even'] ELSE [event_type] END AS rule_ids, CASE WHEN event_type = 'error' THEN 'mcp' ELSE 'network' END AS category,
  CASE WHEN floor(value) >= 90 THEN 'critical' WHEN floor(value) >= 70 THEN 'high' WHEN floor(value) >= 50 THEN 'medium' WHEN floor(value) >= 20 THEN 'low' ELSE 'informational' END AS severity
  FROM events)
"""
