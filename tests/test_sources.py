"""Normalisers, feeds, sinks and streams on files written here."""

import json

from pyspark.sql import functions as F

from sessionlens.api import SessionAnalytics
from sessionlens.operators import sequences
from sessionlens.operators.rules import Matcher, Rule
from sessionlens.sinks import event_log, writers
from sessionlens.sources import feeds, sessions
from sessionlens.streaming import streams


def lines(spark, client, values):
    return spark.createDataFrame([(client, "f", "s", "/f", i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "client string, source_id string, source_kind string, source_path string, ordinal long, value string")


def facts(obs):
    return [(r["session_id"], r["family"], r["stage"], r["role"], r["text"], r["tool_name"], r["command"], r["tool_result"], r["call_id"]) for r in obs.orderBy("source_sequence", "child_ordinal").collect()]


def test_claude_files_to_detections(spark, tmp_path):
    rows = [
        {"type": "user", "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "sessionId": "s1", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "run"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "cat .env"}}]}},
        {"type": "user", "sessionId": "s1", "timestamp": "2026-01-01T00:00:02Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "A=1"}, {"type": "text", "text": "B=2"}], "is_error": False}]}},
        {"type": "summary", "x": 1}]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n[1]\n{broken\n")
    rule = Rule("secret.env", "secret_access", 35, "medium", (Matcher("command", r"\.env"),))
    lens = SessionAnalytics(spark, [rule])
    obs, bad = lens.observations(str(tmp_path), "claude")
    got = facts(obs)
    assert [g[1:4] for g in got] == [("message", "recorded", "user"), ("message", "recorded", "assistant"), ("tool", "requested", None), ("tool", "result", None)]
    assert got[2][5:7] == ("Bash", "cat .env") and got[3][7] == "A=1\nB=2" and got[3][8] == "c1"
    assert [r["quarantine_code"] for r in bad.collect()] == ["not_an_object"] * 2
    e = lens.detections(obs).collect()
    assert len(e) == 1 and e[0]["risk_score"] == 35 and e[0]["event_id"].startswith("evt:") and e[0]["model"] == "m1"
    assert sessions.check_unique(obs).count() == 0
    whole = sessions.normalize_claude(sessions.read_whole_sessions(spark, str(tmp_path), "claude"))
    assert whole.count() == 6


def test_codex_inherits_its_session(spark):
    got = facts(sessions.normalize_codex(lines(spark, "codex", [
        {"type": "session_meta", "session_id": "z", "payload": {"model_provider": "p"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}},
        {"type": "event_msg", "payload": {"type": "tool_call", "tool_name": "shell", "command": "ls"}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "ok"}}])))
    assert [g[0] for g in got] == ["z"] * 4 and got[1][3:5] == ("user", "hi") and got[2][6] == "ls" and got[3][7:] == ("ok", "c")


def test_qwen_openclaw_pi_copilot(spark):
    flat = [{"type": "user", "sessionId": "s", "content": "q"}, {"type": "tool_call", "sessionId": "s", "name": "bash", "input": {"command": "ls"}}, {"type": "tool_result", "sessionId": "s", "tool": "bash", "content": "out"}]
    for f in (sessions.normalize_qwen, sessions.normalize_openclaw):
        got = facts(f(lines(spark, "x", flat)))
        assert got[0][4] == "q" and got[1][6] == "ls" and got[2][7] == "out"
    got = facts(sessions.normalize_pi(lines(spark, "pi", [
        {"type": "session", "id": "p1"}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "t"}, {"type": "toolCall", "id": "c", "name": "bash", "arguments": {"command": "pwd"}}]}},
        {"type": "message", "message": {"role": "bashExecution", "command": "id", "output": "me", "exitCode": 0}}, {"type": "label"}])))
    assert [g[0] for g in got] == ["p1"] * 4 and got[2][6] == "pwd" and got[3][6:8] == ("id", "me")
    call = json.dumps([{"type": "function_call", "id": "i", "call_id": "c", "name": "bash", "arguments": json.dumps({"command": "ls"}), "status": "completed"}])
    got = facts(sessions.normalize_copilot(lines(spark, "copilot", ["2026-01-01T00:00:00Z [INFO] Workspace initialized: w1 (checkpoints: 0)", f"2026-01-01T00:00:01Z [INFO] Accumulated output items (1): {call}", "2026-01-01T00:00:02Z [INFO] Session completed.", "2026-01-01T00:00:03Z [INFO] Workspace initialized: w2 (checkpoints: 1)", f"2026-01-01T00:00:04Z [INFO] Accumulated output items (1): {call}"])))
    assert [(g[0], g[6]) for g in got if g[1] == "tool"] == [("w1", "ls"), ("w2", "ls")]


def test_opencode_and_incremental_read(spark):
    m = spark.createDataFrame([("m1", "s1", '{"role":"user"}')], "id string, session_id string, data string")
    p = spark.createDataFrame([(1, "m1", 1000, '{"type":"text","text":"a"}'), (2, "m1", 2000, '{"type":"tool","tool":"bash","callID":"c","state":{"status":"completed","input":{"command":"ls"},"output":"o"}}'), (3, "gone", 3000, '{"type":"text","text":"b"}'), (4, "m1", 1, '{"type":"step"}')], "rowid long, message_id string, time_updated long, data string")
    got = facts(sessions.normalize_opencode(p, m))
    assert [g[0] for g in got] == ["s1", "s1", None] and got[1][6:8] == ("ls", "o")
    rows, top = sessions.read_incremental(p, 2500, overlap_ms=600)
    assert [r["rowid"] for r in rows.collect()] == [2, 3] and top == 3000
    try:
        sessions.read_incremental(p, None, most=2)
        raise AssertionError
    except ValueError:
        pass


def test_inference_payloads_and_deltas(spark):
    req = json.dumps({"model": "m", "messages": [{"role": "user", "content": "hi"}]})
    res = {"openai_chat": {"id": "r", "choices": [{"index": 0, "message": {"role": "assistant", "content": "yo", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]}, "finish_reason": "stop"}]},
           "anthropic_messages": {"id": "r", "content": [{"type": "text", "text": "yo"}, {"type": "tool_use", "id": "c", "name": "f", "input": {"a": 1}}], "stop_reason": "x"},
           "openai_responses": {"id": "r", "output": [{"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "yo"}]}, {"type": "function_call", "call_id": "c", "name": "f", "arguments": "{}"}]},
           "ollama": {"message": {"role": "assistant", "content": "yo", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]}, "done_reason": "x"}}
    for profile, body in res.items():
        df = spark.createDataFrame([("cap", "f", "s", "/f", 0, "s1", "2026-01-01T00:00:00Z", req, json.dumps(body))], "client string, source_id string, source_kind string, source_path string, ordinal long, session_id string, at string, request string, response string")
        got = facts(feeds.normalize_inference(df, profile))
        assert [g[1] for g in got] == ["inference", "message", "message", "tool"] and got[1][4] == "hi" and got[2][4] == "yo" and got[3][5] == "f", profile
    c = spark.createDataFrame([("a", 1, 0, None, "lo", None), ("a", 0, 0, None, "hel", None), ("a", 2, 0, None, "", "stop"), ("b", 0, 0, None, "x", None), ("b", 0, 0, None, "y", None)], "response_id string, seq long, choice_index int, tool_index int, delta string, finish_reason string")
    texts, bad = feeds.assemble_deltas(c)
    assert [r["text"] for r in texts.collect()] == ["hello"] and [r[0] for r in bad.collect()] == ["b"]


def test_mcp_and_install(spark):
    cfg = json.dumps({"mcpServers": {"fs": {"command": "/usr/bin/npx", "args": ["-y", "@scope/server-fs"], "tools": ["read", "list"], "env": {"KEY": "secret"}}, "web": {"url": "https://u:p@Host.com:8/x"}}})
    got = {r["server"]: r for r in feeds.mcp_inventory(spark.createDataFrame([("claude", cfg), ("x", "{bad")], "client string, text string")).collect()}
    assert got["fs"]["command"] == "npx" and got["fs"]["package"] == "@scope/server-fs" and got["fs"]["env_keys"] == ["KEY"] and got["web"]["url_host"] == "host.com" and got["web"]["transport"] == "http"
    sig = spark.createDataFrame([("h", "a", "executable", "a", True), ("h", "copilot", "executable", "copilot", True), ("h", "z", "package", "z", False)], "host string, agent string, kind string, name string, present boolean")
    assert {r["agent"]: r["status"] for r in feeds.install_inventory(sig).collect()} == {"a": "confirmed", "copilot": "partial", "z": "absent"}


def test_journal_and_sinks(spark, tmp_path):
    from sessionlens.operators.gold import as_events

    e = as_events(spark.createDataFrame([("e1", "detection", "low", 5), ("e2", "detection", "low", 0)], "event_id string, event_type string, severity string, risk_score long"))
    writers.write_events_jsonl(e, str(tmp_path / "j"))
    with open(tmp_path / "j" / "bad.txt", "w") as f:
        f.write("{broken\n")
    back = {r["event_id"]: r["invalid_reason"] for r in feeds.read_events(spark, str(tmp_path / "j")).collect()}
    assert back == {"e1": None, "e2": None, None: "unreadable_line"}
    event_log.write_events_table(e, str(tmp_path / "t"))
    event_log.write_events_table(e, str(tmp_path / "t"))
    assert event_log.EventLog(spark, str(tmp_path / "t")).read().count() == 2
    assert list(writers.byte_batches(["aaa", "bbb", "c" * 20], 8)) == [["aaa", "bbb"], ["c" * 20]]
    out = tmp_path / "sent"
    out.mkdir()

    def sender(batch, folder=str(out)):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write("\n".join(batch))

    writers.deliver(writers.to_hec(e, "h", "i"), sender)
    assert sum(len(p.read_text().splitlines()) for p in out.iterdir()) == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [("k%d" % (i % 2), 1_000_000 + i * 1500) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, epoch long").withColumn("ts", F.timestamp_seconds("epoch")).orderBy("epoch").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))

    def run(frame, name):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(streams.suppress_stream(stream, ["k"]), "supp").where("not suppressed")
    want = sequences.suppress_repeats(df, ["k"])
    assert sorted((r["k"], r["epoch"]) for r in got.collect()) == sorted((r["k"], r["epoch"]) for r in want.collect())

    st = spark.createDataFrame([("s", "1", "a", 10_000, "o1"), ("s", "1", "b", 10_100, "o2"), ("s", "1", "b", 10_200, "o3"), ("s", "1", "a", 15_000, "o4"), ("s", "1", "b", 16_000, "o5")], "source_instance string, session_id string, step string, epoch long, observation_id string").withColumn("ts", F.timestamp_seconds("epoch"))
    st.coalesce(1).write.parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema(st.schema).parquet(str(tmp_path / "steps"))
    got = run(streams.sequence_stream(stream, "c", ["a", "b"], ["source_instance", "session_id"]), "seq")
    want = sequences.action_chains(st, "c", ["a", "b"])
    assert sorted((r["start_epoch"], r["end_epoch"]) for r in got.collect()) == sorted((r["start_epoch"], r["end_epoch"]) for r in want.collect()) == [(10_000, 10_100)]

    states = spark.createDataFrame([("h", False, 0), ("h", True, 1), ("h", True, 2), ("h", False, 3), ("h", True, 4)], "k string, bad boolean, epoch long")
    states.coalesce(1).write.parquet(str(tmp_path / "states"))
    got = run(streams.latch_stream(spark.readStream.schema(states.schema).parquet(str(tmp_path / "states")), ["k"]), "latch")
    assert sorted(r["epoch"] for r in got.collect()) == [1, 4]


def test_session_stream_scores_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"type": "user", "sessionId": "s", "message": {"role": "user", "content": "hi"}}) + "\n")
    seen = []
    q = streams.score_stream(streams.stream_sessions(spark, str(tmp_path / "in"), "claude"), sessions.normalize_claude, lambda d: d, lambda d, n: seen.extend(r["session_id"] for r in d.collect()), str(tmp_path / "ck"), {"availableNow": True})
    q.awaitTermination(120)
    assert seen == ["s"]


def test_all_clients_in_one_scan(spark, tmp_path):
    said = {"type": "user", "sessionId": "s1", "message": {"role": "user", "content": "hi"}}
    files = {
        "claude": [said], "qwen": [{"type": "user", "sessionId": "s2", "content": "hi"}], "pi": [{"type": "session", "id": "s3"}, {"type": "message", "message": {"role": "user", "content": "hi"}}],
        "claude/more": [{**said, "sessionId": "s4"}], "else": [said]}
    for name, records in files.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "a b.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    roots = {"claude": str(tmp_path / "claude"), "qwen": str(tmp_path / "qwen"), "pi": str(tmp_path / "pi"), "gemini": str(tmp_path / "else")}
    obs, bad = SessionAnalytics(spark).observations(roots)
    got = sorted((r["client"], r["session_id"], r["text"]) for r in obs.where("family = 'message'").collect())
    assert got == [("claude", "s1", "hi"), ("claude", "s4", "hi"), ("pi", "s3", "hi"), ("qwen", "s2", "hi")]
    assert [(r["client"], r["quarantine_code"]) for r in bad.collect()] == [("gemini", "unknown_client")]
    plan = obs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    inner = sessions.read_sessions(spark, {"claude": str(tmp_path / "claude"), "qwen": str(tmp_path / "claude" / "more")})
    assert sorted(r["client"] for r in inner.collect()) == ["claude", "qwen"]


def test_one_pass_equals_each_client_alone(spark):
    from sessionlens.plans.operator_queries import _mixed_lines

    mixed = _mixed_lines(spark, "/root/testdata/sf0.001").cache()
    drop = ("observed_at", "caps", "extra")
    alone = None
    for c in sessions.CLIENTS.values():
        got = sessions.normalise(mixed.where(F.col("client") == c.name), [c]).drop(*drop)
        alone = got if alone is None else alone.unionByName(got)
    together = sessions.normalise(mixed).drop(*drop)
    assert together.exceptAll(alone).count() == alone.exceptAll(together).count() == 0
    assert together.count() > 80
