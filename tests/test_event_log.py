"""Chains of events and the counters of terminal sessions, on hand-made files."""

import json
import random

from tallyforge.operators import chains, dialects
from tallyforge.sources import event_log

SESSION = "11111111-2222-4333-8444-555555555555"
START = 1_577_836_800_000


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def start(**more):
    return {"type": "session.start", "id": uid(0), "parentId": None, "timestamp": "2020-01-01T00:00:00Z", "data": {"sessionId": SESSION, "version": 1, "producer": "copilot-cli", "copilotVersion": "1", "startTime": "2020-01-01T00:00:00Z"} | more}


def event(n, kind="user.message", parent=0, data=None, **more):
    return {"type": kind, "id": uid(n), "parentId": uid(parent), "timestamp": "2021-01-01T00:00:00.5Z", "data": {} if data is None else data} | more


def shutdown(n, parent=0, **more):
    usage = {"inputTokens": 9, "outputTokens": 5, "cacheReadTokens": 0, "cacheWriteTokens": 0}
    body = {"sessionStartTime": START, "shutdownType": "routine", "totalApiDurationMs": 1, "codeChanges": {"filesModified": [], "linesAdded": 0, "linesRemoved": 0}, "modelMetrics": {"m": {"requests": {"count": 2}, "usage": usage}}, "totalNanoAiu": 7}
    return event(n, "session.shutdown", parent, body | more)


def place(i):
    return f"/h{i}/session-state/{SESSION}/events.jsonl"


def read(spark, records):
    return read_all(spark, [records])


def read_all(spark, files):
    """Lines of files: None is a malformed one, text a status without a record."""
    rows = []
    for n, records in enumerate(files):
        for i, r in enumerate(records, 1):
            rows.append((place(n), i, json.dumps(r) if isinstance(r, dict) else None, "ok" if isinstance(r, dict) else r or "malformed"))
    lines = spark.createDataFrame(rows, "locator string, line long, record string, status string")
    files, events = event_log.qualified(event_log.envelopes(lines))
    return lines, files.collect(), events, event_log.counters(events)


def test_chains(spark):
    _, files, events, _ = read(spark, [start(), event(1), event(2, parent=1), event(3, parent=9), event(4, parent=5), event(5, parent=4), event(6, parent=5), event(2, parent=0), event(7, parent=2), event(8, id="no"), event(10, ephemeral=True), event(11, agentId=" "), event(12, agentId="a", ephemeral=False)])
    assert [(f.session_id, f.started_ms, f.code) for f in files] == [(SESSION, START, None)]
    assert {r.line: (r.chain, r.accepted) for r in events.collect()} == {
        1: (None, True), 2: (None, True), 3: (None, True), 4: ("event_chain_gap", True), 5: ("invalid_event_chain", False), 6: ("invalid_event_chain", False), 7: ("invalid_event_chain", False), 8: ("duplicate_event_id", False),
        9: (None, True), 10: (None, False), 11: (None, False), 12: (None, False), 13: (None, True),
    }
    assert {(a.session_id, a.agent) for a in event_log.agents(events).collect()} == {(SESSION, "a")}


def test_random_chains_equal_a_plain_walk(spark):
    rng, rows, want = random.Random(8), [], {}
    for n in range(20):
        refused, place, file = set(), {}, []
        for line in range(2, rng.randint(3, 40)):
            file.append((line, f"e{rng.randint(0, 30)}", f"e{rng.randint(0, 40)}" if rng.random() < 0.5 else "start"))
        place["start"] = 1
        for line, e, _ in file:
            place.setdefault(e, line)
        for line, e, p in file:
            if place[e] != line:
                want[n, line] = ("duplicate_event_id", False)
            elif place.get(p, 0) >= line or p in refused:
                refused.add(e)
                want[n, line] = ("invalid_event_chain", False)
            else:
                want[n, line] = (None if p in place else "event_chain_gap", True)
        rows += [(f"{n}", 1, True, True, "start", None), *((f"{n}", line, False, True, e, p) for line, e, p in file)]
    rng.shuffle(rows)
    found = chains.qualify(spark.createDataFrame(rows, "locator string, line long, is_start boolean, valid boolean, event_id string, parent_id string").repartition(5))
    assert {(int(r.locator), r.line): (r.code, r.accepted) for r in found.collect() if r.line not in (None, 1)} == want


REFUSED = [
    ([event(1)], "invalid_session_start"), ([start(), start()], "invalid_session_start"), ([event(1), start()], "invalid_session_start"), ([start() | {"parentId": uid(1)}], "invalid_session_start"), ([start() | {"agentId": "a"}], "invalid_session_start"),
    ([start(version=2)], "conflicting_session_identity"), ([start(version=1.0)], "conflicting_session_identity"), ([start(sessionId="x")], "conflicting_session_identity"), ([start(producer="x")], "conflicting_session_identity"), ([start(startTime="2020-01-01T00:00:00.0001Z")], "conflicting_session_identity"),
    ([start(context={"cwd": "rel"})], "conflicting_session_identity"), ([start(), event(1, timestamp="2019-01-01T00:00:00Z")], "invalid_session_lifetime"), ([start(context={"cwd": "/w", "pendingGitContext": True})], None),
]


def test_files_that_are_refused(spark):
    _, files, events, _ = read_all(spark, [records for records, _ in REFUSED])
    assert {f.locator: f.code for f in files} == {place(i): code for i, (_, code) in enumerate(REFUSED)}
    assert {r.locator for r in events.select("locator").distinct().collect()} == {place(i) for i, (_, code) in enumerate(REFUSED) if code is None}


def test_counters_and_lifetimes(spark):
    odd = {"m": {"requests": {"count": "1"}, "usage": {"inputTokens": 9, "outputTokens": 5, "cacheReadTokens": 1, "cacheWriteTokens": 0, "reasoningTokens": 6}}, "n": {}, " ": {}}
    agents = {"a": {"totalApiDurationMs": 1, "totalNanoAiu": 0.5, "modelMetrics": {}}, "b": {"modelMetrics": {}}, "c": 5}
    records = [start(context={"cwd": "/w", "gitRoot": "/g"}), event(1, "session.usage_checkpoint", data={"totalNanoAiu": 2, "totalPremiumRequests": 0.25}), shutdown(2, modelMetrics=odd, agentMetrics=agents, totalNanoAiu=-1), shutdown(3, sessionStartTime=1), event(4, "session.context_changed", data={"cwd": "/g"}), shutdown(5)]
    lines, _, events, told = read(spark, records)
    got = {(r.line, r.scope, r.name): r for r in told.collect()}
    assert set(got) == {(2, "session", None), (3, "session", None), (3, "model", "m"), (3, "model", "n"), (3, "agent", "a"), (3, "agent", "b"), (4, "session", None), (6, "session", None), (6, "model", "m")}
    assert (float(got[2, "session", None].nano), float(got[2, "session", None].premium), got[2, "session", None].source) == (2, 0.25, "checkpoint")
    first = got[3, "model", "m"]
    assert (first.input, first.input_reason, first.cache_read, first.reasoning, first.requests, first.invalid) == (9, "cache_inclusion_unknown", 1, None, None, ["reasoning", "request_count"])
    assert got[3, "model", "n"].invalid == ["cacheRead", "cacheWrite", "input", "model_shape", "output"] and got[3, "session", None].invalid == ["nano_aiu"] and got[3, "session", None].models == ["m", "n"]
    assert (got[3, "agent", "a"].invalid, got[3, "agent", "b"].invalid, got[4, "session", None].invalid, got[6, "model", "m"].input_reason) == ([], ["agent_core"], ["epoch"], None)
    ends = event_log.lifetimes(lines, events, told).first()
    assert (ends.closed_line, ends.complete) == (6, True)
    assert [tuple(r)[1:] for r in event_log.contexts(events).collect()] == [("/g", False)]


AFTER = [([], True), ([event(9, "assistant.usage")], True), ([event(9)], False), ([event(9, ephemeral=True)], True), ([None], False), (["pending"], False), ([event(2)], False)]


def test_what_stands_after_the_last_shutdown(spark):
    lines, _, events, told = read_all(spark, [[start(), shutdown(2), *after] for after, _ in AFTER])
    assert {r.locator: r.complete for r in event_log.lifetimes(lines, events, told).collect()} == {place(i): complete for i, (_, complete) in enumerate(AFTER)}


def test_counters_of_several_files(spark):
    columns = "row_id long, session_id string, name string, source_id string, line long, event_id string, compatibility string, amount long, usable boolean, reason string, allow_unknown boolean"
    rows, ids = [], {}

    def add(name, *files, amounts=None, other=()):
        for n, file in enumerate(files):
            for line, e in enumerate(file):
                key = ids.setdefault((name, e, (n, e) in other), len(ids))
                amount = (amounts or {}).get(e, ord(e))
                rows.append((key, "s", name, f"{name}{n}", line, e, "x" if (n, e) in other else "c", amount, amount != -1, "broken" if amount == -1 else None, False))

    add("one", "abc")
    add("goes on", "abc", "bcd")
    add("two ends", "abc", "abd")
    add("there and back", "abc", "cb", amounts=dict.fromkeys("abc", 1))
    add("three round", "abz", "bcz", "caz", amounts=dict.fromkeys("abcz", 1))
    add("fork and join", "abd", "acd", amounts=dict.fromkeys("abcd", 1))
    add("falls", "abc", amounts={"b": 1})
    add("falls past a gap", "abc", amounts={"b": None, "c": 1})
    add("unknown end", "ab", amounts={"b": None})
    add("told otherwise", "abc", "abc", other={(1, "b")})
    add("unusable", "abc", amounts={"b": -1})
    found = {r.row_id: r for r in dialects.counter_decisions(spark.createDataFrame(rows, columns).repartition(3)).collect()}
    got = {}
    for (name, e, _), key in ids.items():
        got.setdefault(name, {})[e] = (found[key].state, found[key].reason)
    good = {"one": "c", "goes on": "d", "fork and join": "d"}
    for name, by in got.items():
        if name in good:
            assert {e for e, (state, _) in by.items() if state == "selected"} == {good[name]} and {s for e, (s, _) in by.items() if e != good[name]} == {"excluded"}, name
        else:
            assert set(by.values()) == {("unresolved", "broken" if name == "unusable" else "incomparable_history")}, name


def test_only_counters_that_lead_back_are_searched_for_rings(spark, monkeypatch):
    columns = "row_id long, session_id string, name string, source_id string, line long, event_id string, compatibility string, amount long, usable boolean, reason string, allow_unknown boolean"
    files = {"on": ("abc", "bcd"), "back": ("abc", "cb"), "fork": ("abd", "acd"), "again": ("aba",), "plain": ("abc",)}
    rows = [(ord(e), "s", name, f"{name}{n}", line, e, "c", 1, True, None, False) for name, fs in files.items() for n, file in enumerate(fs) for line, e in enumerate(file)]
    searched, search = [], dialects._cyclic
    monkeypatch.setattr(dialects, "_cyclic", lambda edges, scratch: searched.extend(r.group.split("\x1f")[1] for r in edges.select("group").distinct().collect()) or search(edges, scratch))
    found = dialects.counter_decisions(spark.createDataFrame(rows, columns)).where("state = 'selected'").count()
    assert sorted(searched) == ["again", "back", "on"] and found == 3
