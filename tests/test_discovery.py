"""Files found, told apart, joined with what lies beside them, and told as grown or replaced."""

import json

from pyspark.sql import functions as F

from tallyforge import queries
from tallyforge.sources import discovery

SESSION = "11111111-2222-4333-8444-555555555555"


def data(*records):
    return ("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)).encode()


EVENT = {"type": "session.start", "id": "x", "parentId": None, "timestamp": "2020-01-01T00:00:00Z", "data": {"sessionId": "s", "version": 1, "producer": "copilot-cli", "copilotVersion": "1", "startTime": "t"}}
METRIC = {"requests": {"count": 1}, "usage": {"inputTokens": 1, "outputTokens": 1, "cacheReadTokens": 0, "cacheWriteTokens": 0}}
SHUT = {"sessionStartTime": 1, "shutdownType": "routine", "totalApiDurationMs": 1, "modelMetrics": {"m": METRIC}, "codeChanges": {"filesModified": ["f"], "linesAdded": 0, "linesRemoved": 0}}


def test_dialects(spark):
    at, chat, shut = f"/h/session-state/{SESSION}/events.jsonl", "/i/workspaceStorage/w/chatSessions/", lambda **more: {"type": "session.shutdown", "id": "x", "parentId": "p", "timestamp": "2020-01-01T00:00:00Z", "data": SHUT | more}
    state = {"version": 3, "sessionId": "s"}
    cases = [
        ("/a.jsonl", data({"type": "session", "version": 3, "id": "s"}, "broken"), "tree"), ("/b.jsonl", data({"type": "session", "version": 2, "id": "s"}), None), ("/c.jsonl", data({"type": "session_meta", "payload": {"id": "p"}}), "rollout"), ("/d.jsonl", data({"type": "session_meta", "payload": {"id": 1}}), None),
        ("/e.jsonl", data({"type": "summary", "sessionId": "s"}), "call"), ("/f.jsonl", data({"type": "other", "sessionId": "s"}), None), ("/g.jsonl", b"", None), ("/h.jsonl", data([1]), None), ("/i.jsonl", b"\xff\n", None), (chat + "a.jsonl", data({"kind": 0, "v": state}), "chat"),
        (chat + "b.json", json.dumps(state, indent=1).encode(), "chat"), (chat + "c.json", json.dumps(state | {"version": 3.0}).encode(), None), ("/x/b.json", json.dumps(state).encode(), None), (chat + "d.json", b" " * discovery.PROBE + b"{}", "chat"), ("/x/d.json", b" " * discovery.PROBE + b"{}", None),
        (at, data(EVENT), "event"), (at, data(EVENT | {"data": {}}), None), (at, data(EVENT | {"timestamp": "2020"}), None), ("/x/events.jsonl", data(EVENT), None), (at, data(shut()), "event"), (at, data(shut(modelMetrics={"m": {}})), None), (at, data(shut() | {"ephemeral": True}), None), (at, data(shut() | {"parentId": ""}), None),
        (at, data({"type": "session.usage_checkpoint", "id": "x", "parentId": "p", "timestamp": "2020-01-01T00:00:00Z", "data": {"totalNanoAiu": 1.5}}), "event"), (f"/h/session-state/{SESSION}/workspace.yaml", b"id: x", "event_metadata"), ("/h/session-state/x/workspace.yaml", b"id: x", None),
        ("/long.jsonl", b'{"type":"session","version":3,"id":"' + b"x" * discovery.PROBE + b'"}\n', None),
    ]
    rows = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(cases)], "i int, path string, content binary")
    found = {r.i: r.d for r in rows.select("i", discovery.dialect(F.col("path"), F.col("content")).alias("d")).collect()}
    assert {i: d for i, d in found.items() if d != cases[i][2]} == {}


def test_files_of_several_roots_and_what_lies_beside(spark, tmp_path):
    chat, events, alone = tmp_path / "r/workspaceStorage/w/chatSessions", tmp_path / f"r/session-state/{SESSION}", tmp_path / f"r/session-state/{SESSION[:-1]}6"
    for folder in (chat, events, alone):
        folder.mkdir(parents=True)
    (chat / "a.jsonl").write_bytes(data({"kind": 0, "v": {"version": 3, "sessionId": "s"}}))
    (chat.parent / "workspace.json").write_text('{"folder": "file:///w"}')
    (events / "events.jsonl").write_bytes(data(EVENT))
    (events / "workspace.yaml").write_text("x" * (discovery.PROBE + 1))
    (alone / "workspace.yaml").write_text("id: 1")
    (tmp_path / "r/notes.jsonl").write_bytes(b"no log\n")
    found = discovery.sources(discovery.listed(spark, [str(tmp_path / "r/session-state"), str(tmp_path / "r")])).collect()
    got = {r.path.split("/r/")[1]: (r.root, r.dialect, r.beside, r.problem) for r in found}
    assert got == {"workspaceStorage/w/chatSessions/a.jsonl": (1, "chat", "workspace.json", None), f"session-state/{SESSION}/events.jsonl": (0, "event", None, "sidecar_too_large"), f"session-state/{SESSION[:-1]}6/workspace.yaml": (0, "event_metadata", None, None)}
    before = {r.path: r.fingerprint for r in found}
    (chat.parent / "workspace.json").write_text('{"folder": "file:///v"}')
    after = {r.path: r.fingerprint for r in discovery.sources(discovery.listed(spark, [str(tmp_path / "r")])).collect()}
    assert {p.split("/")[-1] for p in before if before[p] != after[p]} == {"a.jsonl"}


def test_grown_or_replaced(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    first = {"same": b"a\nb\n", "tail": b"a\nb", "more": b"a\n", "other": b"a\nb\n", "short": b"a\nb\n", "none": b"xy", "empty": b""}
    kept = discovery.prefixes(frame(list(first.items())))
    assert {r.locator: r.complete_bytes for r in kept.collect()} == {"same": 4, "tail": 2, "more": 2, "other": 4, "short": 4, "none": 0, "empty": 0}
    second = {"same": b"a\nb\n", "tail": b"a\nbc\nd", "more": b"a\nb\n\xff\n", "other": b"a\nc\n", "short": b"a\n", "none": b"zz\n", "empty": b"a", "new": b"a"}
    assert {r.locator: r.extends for r in discovery.grown(frame(list(second.items())), kept).collect()} == {"same": True, "tail": True, "more": True, "other": False, "short": False, "none": True, "empty": True, "new": None}


def test_files_are_gathered_in_parts_that_grow_with_the_events(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "EVENTS_A_TASK", 100)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    parts, lines = -(-events // 100), queries._chat_lines(spark, sf_dir)
    assert queries._parts(spark, sf_dir) == parts and queries._dealt(spark, sf_dir).rdd.getNumPartitions() == parts
    assert queries._gathered(lines, parts).rdd.getNumPartitions() == parts
    # What windows sort holds no texts of lines.
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rfind("record#") < plan.index("Window [")
