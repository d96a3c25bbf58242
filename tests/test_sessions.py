import json

from pyspark.sql import functions as F

from logbrook.operators import events as ev
from logbrook.sources import sessions


def rows(spark, lines):
    return spark.createDataFrame([("s", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "session_id string, line_no long, value string")


def listed(df):
    return [(r.seq, r.kind, r.tool, r.message, r.output, r.exit_code) for r in df.orderBy("seq", "kind").collect()]


def test_block_lines(spark):
    lines = [
        {"type": "system", "sessionId": "own", "cwd": "/w", "version": "2"},
        {"type": "attachment"},
        "{broken",
        "[1]",
        {"type": "user", "message": {"content": "hello"}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "t"}, {"type": "other"}, {"type": "tool_use", "name": "sh", "input": {"cmd": "ls", "env": {"a": 1}}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "name": "sh", "content": [{"text": "a"}, "b"]}]}},
        {"type": "error", "error": "bad"},
        {"type": "novel"},
    ]
    found = ev.from_block_lines(rows(spark, lines))
    assert listed(found) == [(1, "user_message", None, "hello", None, None), (2, "assistant_message", None, "t", None, None), (4, "tool_call", "sh", None, None, None), (6, "tool_result", "sh", None, "a b", None), (8, "error", None, "bad", None, None)]
    assert ev.block_unknown(rows(spark, lines)).first().unknown_event_types == 4
    meta = ev.block_metadata(rows(spark, lines)).first()
    assert (meta.own_id, meta.cwd, meta.agent_version) == ("own", "/w", "2")
    line = json.loads(ev.to_jsonl(found).where("seq = 4").first().line)
    assert line["input"] == {"cmd": "ls", "env": {"omitted": "non_scalar_tool_input"}} and "ts" not in line


def test_rollout_lines(spark):
    item = lambda **p: {"type": "response_item", "timestamp": "T", "payload": p}
    lines = [
        {"type": "session_meta", "payload": {"id": "a", "cli_version": "1"}},
        item(type="message", role="assistant", content="hi"),
        item(type="message", role="user", content=[{"text": "x"}]),
        item(type="reasoning"),
        {"type": "turn_context"},
        item(type="function_call", name="sh", arguments='{"cmd": "ls"}'),
        item(type="function_call", name="sh", arguments="not json"),
        item(type="function_call_output", output={"a": 1}, exit_code=3),
        item(type="function_call_output", output="o", exit_code=0),
        item(type="odd"),
        {"type": "event_msg", "user_message": "u"},
        {"type": "event_msg"},
        {"session_meta": {"id": "b"}},
    ]
    found = ev.from_rollout_lines(rows(spark, lines))
    assert [x[:2] for x in listed(found)] == [(1, "session_start"), (2, "assistant_message"), (3, "user_message"), (4, "tool_call"), (5, "tool_call"), (6, "tool_result"), (7, "tool_result"), (8, "user_message"), (9, "session_start")]
    got = {r.seq: r for r in found.withColumn("i", F.to_json("input")).collect()}
    assert json.loads(got[4].i) == {"cmd": "ls"} and json.loads(got[5].i) == {"raw": "not json"}
    assert (got[6].output, got[6].exit_code, got[7].exit_code) == ('{"a":1}', 3, None)
    assert ev.rollout_unknown(rows(spark, lines)).first().unknown_event_types == 2
    assert ev.rollout_metadata(rows(spark, lines)).first().id == "b"


def test_role_lines(spark):
    call = lambda i, n: {"id": i, "function": {"name": n, "arguments": "{}"}}
    lines = [
        {"role": "tool", "tool_call_id": "1", "content": "early"},
        {"role": "assistant", "content": "", "tool_calls": [call("1", "a"), call("2", "b")]},
        {"role": "assistant", "reasoning": "why", "tool_calls": [call("1", "c"), 7]},
        {"role": "tool", "tool_call_id": "1", "content": json.dumps({"exit_code": 2})},
        {"role": "tool", "tool_call_id": "9", "content": json.dumps({"exit_code": 0})},
        {"content": "no role"},
        {"role": "novel"},
    ]
    found = listed(ev.from_role_lines(rows(spark, lines)))
    assert [x[1:3] for x in found] == [("session_start", None), ("tool_result", "unknown"), ("tool_call", "a"), ("tool_call", "b"), ("assistant_message", None), ("tool_call", "c"), ("tool_result", "c"), ("tool_result", "unknown"), ("session_end", None)]
    assert [x[0] for x in found] == list(range(1, 10))
    assert found[4][3] == "[reasoning: why]" and found[6][5] == 2 and found[7][5] is None
    assert ev.role_unknown(rows(spark, lines)).first().unknown_event_types == 3
    started = listed(ev.from_role_lines(rows(spark, [{"role": "session_meta"}, {"role": "assistant", "content": "x"}, {"role": "user", "content": "y"}])))
    assert [x[0] for x in started] == [1, 2, 4, 4] and {x[1] for x in started} == {"session_start", "assistant_message", "user_message", "session_end"}


def test_connectors(spark, tmp_path):
    def put(path, lines):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    put(".claude/projects/p/aaa-1.jsonl", ["{bad", {"type": "user", "timestamp": "2024-01-01", "cwd": "/w", "version": "1", "message": {"content": "x"}}, ""])
    put(".claude/projects/p/bbb-1.jsonl", [{"type": "user", "timestamp": "2024-02-01", "message": {"content": "y"}}])
    put(".codex/sessions/2024/01/02/rollout-c1.jsonl", [{"type": "session_meta", "timestamp": "T", "payload": {"cwd": "/c", "cli_version": "9"}}])
    put(".codex/sessions/2024/01/xx/rollout-no.jsonl", [{}])
    put(".hermes/sessions/H1.jsonl", [{"role": "session_meta", "provider": "p"}, {"role": "user", "content": "q"}])
    put(".hermes/sessions/.hidden.jsonl", [{}])
    store = ".local/share/opencode/storage"
    put(f"{store}/session/p/s1.json", [{"id": "s1", "directory": "/d", "version": "3", "time": {"created": 1700000000000}}])
    put(f"{store}/message/s1/m1.json", [{"id": "m1", "role": "user", "time": {"created": 5}}])
    put(f"{store}/message/s1/m2.json", [{"id": "m2", "role": "assistant", "time": {"created": 6}}])
    put(f"{store}/part/m2/p1.json", [{"id": "1", "type": "text", "text": "hi"}])
    put(f"{store}/part/m2/p2.json", [{"id": "2", "type": "tool", "tool": "sh", "state": {"input": '{"cmd": "ls"}'}}])
    home = f"file://{tmp_path}"

    block = sessions.connector(spark, "Claude", home)
    assert [r.session_id for r in block.discover("last").collect()] == ["bbb-1"]
    one = block.resolve("aaa").first()
    assert (one.event_count, one.cwd_hint, one.started_at) == (2, "/w", "2024-01-01")
    assert [r.message for r in block.read(block.discover("aaa")).collect()] == ["x"]
    roll = sessions.connector(spark, "codex-cli", home)
    assert [(r.session_id, r.agent_version) for r in roll.discover().collect()] == [("c1", "9")]
    assert roll.read(roll.discover()).first().agent_version == "9"
    role = sessions.connector(spark, "hermes", home)
    assert [(r.session_id, r.agent_version, r.event_count) for r in role.discover("h").collect()] == [("H1", "p/unknown", 2)]
    docs = sessions.connector(spark, "opencode", home)
    listing = docs.discover("S1").first()
    assert (listing.event_count, listing.started_at) == (2, "2023-11-14T22:13:20+00:00")
    assert [r.kind for r in docs.read(docs.discover("last")).orderBy("seq").collect()] == ["user_message", "assistant_message", "tool_call", "session_end"]
    try:
        sessions.connector(spark, "nobody", home)
    except sessions.SourceError as e:
        assert e.code == "E_SOURCE_ADAPTER"
