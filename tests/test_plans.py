"""Physical plans: what must be pushed down, and what must not shuffle or run Python."""

from pyspark.sql import functions as F

from sessionlens.functions import activity, privacy
from sessionlens.operators import gold, rules, scoring
from sessionlens.plans.inputs import WORD_RULES, conversations, detections, table, word_chains


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_is_one_projection(spark, sf_dir):
    p = plan(rules.match_rules(conversations(spark, sf_dir), list(WORD_RULES)))
    assert "Exchange" not in p and "Python" not in p and "Join" not in p
    assert "value" not in p.split("ReadSchema")[1][:200] and "text:string" in p


def test_scan_reads_only_what_is_used(spark, sf_dir):
    p = plan(gold.event_summary(detections(spark, sf_dir).where(F.col("event_id") == "5")))
    assert "props" not in p.split("ReadSchema")[1]
    p = plan(table(spark, sf_dir, "events").where("value > 50 and event_type = 'error'").select("event_id"))
    assert "GreaterThan(value,50.0)" in p and "EqualTo(event_type,error)" in p


def test_scores_shuffle_by_session_and_add_up_before(spark, sf_dir):
    m = rules.match_rules(conversations(spark, sf_dir), list(WORD_RULES))
    p = plan(scoring.score_sessions(m, rules.rule_table(spark, list(WORD_RULES))))
    assert "partial" in p and "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_text_functions_stay_in_the_jvm(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = plan(d.select(privacy.redact(F.col("text"), nested=False), activity.path_classes(F.col("text"))))
    assert "Python" not in p and "Exchange" not in p
    # texts with escapes or encoded characters, and only those, are scanned in Python, once for all contexts
    p = plan(d.select(privacy.sanitise_for(F.col("text"), ("evidence", "summary"))))
    assert p.count("ArrowEvalPython") == 1 and "Exchange" not in p


def test_scores_read_the_matches_once_and_sanitise_redacts_once(spark, sf_dir):
    m = rules.match_rules(conversations(spark, sf_dir), list(WORD_RULES))
    p = plan(scoring.score_sessions(m, rules.rule_table(spark, list(WORD_RULES)), word_chains(spark)))
    assert p.count("Location: ") == 1
    d = table(spark, sf_dir, "documents").select(privacy.sanitise(F.col("text")).alias("t"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 40


def test_deltas_are_dealt_over_no_fixed_number_of_tasks(spark, sf_dir):
    from sessionlens.plans import QUERIES

    p = plan(QUERIES["assembled_deltas"](spark, sf_dir))
    assert "REPARTITION_BY_NUM" not in p and "count(distinct" not in p and "Expand" not in p
