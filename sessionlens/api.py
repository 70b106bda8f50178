"""One object with a method for each stage of the analysis, for callers who don't want to wire them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators import gold, rules, scoring, sequences
from sessionlens.operators.rules import Rule
from sessionlens.sources import sessions

@dataclass
class Config:
    bands: tuple = (("critical", 90), ("high", 70), ("medium", 50), ("low", 20))
    correlation_window: int = sequences.CORRELATION_WINDOW
    correlation_risk: int = sequences.CORRELATION_RISK
    repeat_window: int = sequences.REPEAT_WINDOW
    linked_chains: tuple = ()


@dataclass
class SessionAnalytics:
    spark: SparkSession
    rules: list[Rule] = field(default_factory=list)
    chains: DataFrame | None = None
    config: Config = field(default_factory=Config)

    def observations(self, path: str | dict[str, str], client: str | None = None, stores: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """(observations, quarantine) of one client's folder of session files, or of the folders of many clients by name, read by one scan.

        ``stores`` adds the parts and messages of a client that keeps tables instead of lines.
        """
        lines = sessions.read_sessions(self.spark, path, client)
        known = sessions.CLIENTS if isinstance(path, dict) else {client: sessions.CLIENTS[client]}
        got = sessions.normalise(lines, list(known.values()))
        if stores is not None:
            got = got.unionByName(sessions.normalize_opencode(*stores))
        return sessions.split_quarantine(got)

    def matches(self, obs: DataFrame) -> DataFrame:
        return rules.match_rules(obs, self.rules)

    def scores(self, matches: DataFrame) -> DataFrame:
        return scoring.score_sessions(matches, rules.rule_table(self.spark, self.rules), self.chains, linked=self.config.linked_chains, bands=self.config.bands)

    def unrepeated(self, found: DataFrame, keys: list[str], at: str = "event_time") -> DataFrame:
        """Findings without the repeats of a key within the configured window of their anchor."""
        return sequences.suppress_repeats(found, keys, at, self.config.repeat_window)

    def summaries(self, events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        """Session summaries of activities and detections; of those in ``seen`` (fingerprint) only what says something new."""
        got = gold.as_events(gold.session_risk_summary(events).withColumns({"event_type": F.lit("session_risk_summary"), "schema_version": F.lit("3.0")}))
        return got if seen is None else gold.new_summaries(got, seen)

    def detections(self, obs: DataFrame) -> DataFrame:
        """Detection events of scored sessions."""
        keys = ["source_instance", "session_id"]
        about = obs.groupBy(*keys).agg(F.max("client").alias("client"), F.max("agent").alias("agent"), F.max("model").alias("model"), F.max("provider").alias("provider"), F.max("source_path_hash").alias("source_path_hash"), F.max("occurred_at").alias("event_time"))
        return gold.detection_events(self.scores(self.matches(obs)), rules.rule_table(self.spark, self.rules), about)

    def correlations(self, events: DataFrame) -> DataFrame:
        return gold.correlation_events(sequences.correlate_sessions(events, self.config.correlation_window, self.config.correlation_risk))
