"""Logs of edits replayed, and what editor chats tell of usage."""

import copy
import json
import random

from tallyforge import queries
from tallyforge.operators import edits
from tallyforge.sources import chat_log

FOLDER = "/i/workspaceStorage/w/chatSessions/"
AGENT = {"extensionId": {"value": "GitHub.copilot-chat"}}


def start(**more):
    return {"kind": 0, "v": {"version": 3, "sessionId": "s", "requests": []} | more}


def frame(spark, logs):
    """Lines of files: a record that is text stands as it is."""
    rows = []
    for name, records in logs.items():
        for i, r in enumerate(records, 1):
            status = "ok"
            if isinstance(r, tuple):
                r, status = r
            rows.append((name, i, r if isinstance(r, str) or r is None else json.dumps(r), status))
    return spark.createDataFrame(rows, "locator string, line long, record string, status string").repartition(3)


def replayed(spark, records, name="a.jsonl"):
    rows = edits.replay(frame(spark, {name: records}), "requests").collect()
    head = next(r for r in rows if r.ordinal is None)
    return head, {r.ordinal: (json.loads(r.item), r.lines) for r in rows if r.ordinal is not None}


def test_edits_apply_in_order(spark):
    records = [
        start(requests=[{"a": 1}, {"b": [1, 2, 3]}]), {"kind": 1, "k": ["requests", 0, "a"], "v": {"x": 1.50}}, {"kind": 2, "k": ["requests", 1, "b"], "i": 1, "v": [9]}, {"kind": 2, "k": ["requests"], "v": [{"c": "é"}]},
        {"kind": 3, "k": ["requests", 0, "a", "x"]}, {"kind": 1, "k": ["title"], "v": "t"}, {"kind": 2, "k": ["requests", 1, "b"]},
    ]
    head, items = replayed(spark, records)
    assert json.loads(head.head) == {"version": 3, "sessionId": "s", "requests": [], "title": "t"} and (head.code, head.last_line, head.pending) == (None, 7, False)
    assert [items[i][0] for i in range(3)] == [{"a": {}}, {"b": [1, 9]}, {"c": "é"}]
    assert items[0][1] == {"$": 1, "$.a": 2} and items[1][1] == {"$": 1, "$.b": 7, "$.b[0]": 1, "$.b[1]": 3} and items[2][1] == {"$": 4, "$.c": 4}


BROKEN = [
    ([{"kind": 1, "k": ["a"], "v": 1}], "missing_initial_state"), ([start(), start()], "duplicate_initial_state"), ([{"kind": 0}], "missing_initial_state"), ([{"kind": 0, "v": [1]}], "missing_initial_state"),
    ([start(), {"kind": 9, "k": []}], "unsupported_operation"), ([start(), {"kind": True, "k": ["a"], "v": 1}], "unsupported_operation"), ([start(), {"kind": 1, "k": [], "v": 1}], "invalid_operation_path"),
    ([start(), {"kind": 1, "k": ["requests", 0], "v": 1}], "invalid_operation_path"), ([start(), {"kind": 1, "k": ["a", "b"], "v": 1}], "invalid_operation_path"), ([start(), {"kind": 1, "k": ["a"]}], "missing_set_value"),
    ([start(), {"kind": 2, "k": ["version"], "v": [1]}], "invalid_push_target"), ([start(), {"kind": 2, "k": ["requests"], "i": 1, "v": []}], "invalid_push_index"), ([start(), {"kind": 2, "k": ["requests"], "v": 1}], "invalid_push_value"),
    ([start(), {"kind": 3, "k": ["nothing"]}], "invalid_operation_path"), ([start(requests=[1]), {"kind": 3, "k": ["requests", 0]}], "invalid_delete_path"), ([start(), [1]], "invalid_operation"), ([start(), (None, "malformed")], "malformed_operation"),
    ([start(), '{"kind":1,"k":["a"],"v":1,"v":2}'], "malformed_operation"), ([start(), ""], "malformed_operation"), ([start(), {"kind": 1, "k": ["requests", 1.0, "a"], "v": 1}], "invalid_operation_path"),
]


def test_edits_that_do_not_apply(spark):
    rows = edits.replay(frame(spark, {f"{i}.jsonl": records for i, (records, _) in enumerate(BROKEN)}), "requests").collect()
    assert {r.locator: (r.code, r.head, r.ordinal) for r in rows} == {f"{i}.jsonl": (code, None, None) for i, (_, code) in enumerate(BROKEN)} and len(rows) == len(BROKEN)
    assert edits.replay(frame(spark, {"b.jsonl": [start()]}).where("false"), "requests").collect() == []


def test_a_line_that_is_still_written_is_pending(spark):
    head, items = replayed(spark, [start(), {"kind": 2, "k": ["requests"], "v": [{}]}, (None, "pending")])
    assert (head.pending, head.last_line, len(items)) == (True, 2, 1)


def test_random_logs_equal_plain_edits(spark):
    rng, logs, want = random.Random(4), {}, {}
    for n in range(25):
        state = {"version": 3, "sessionId": "s", "requests": []}
        log = [start()]
        for _ in range(rng.randint(0, 30)):
            kind, at = rng.choice((1, 2, 2, 3)), len(state["requests"])
            if kind == 2 or not at:
                i = rng.randint(0, at)
                new = [{"n": rng.randint(0, 9), "deep": {"list": [1.25, None, True]}} for _ in range(rng.randint(0, 2))]
                log.append({"kind": 2, "k": ["requests"], "i": i, "v": new} if rng.random() < 0.5 else {"kind": 2, "k": ["requests"], "v": new})
                del state["requests"][i if "i" in log[-1] else at :]
                state["requests"] += copy.deepcopy(new)
            elif kind == 1:
                i, name = rng.randrange(at), rng.choice("nxy")
                log.append({"kind": 1, "k": ["requests", i, name], "v": rng.choice((1, "a", [2, 3], {"z": {}}))})
                state["requests"][i][name] = copy.deepcopy(log[-1]["v"])
            elif names := [(i, k) for i, r in enumerate(state["requests"]) for k in r]:
                i, name = rng.choice(names)
                log.append({"kind": 3, "k": ["requests", i, name]})
                del state["requests"][i][name]
        logs[f"{n}.jsonl"], logs[f"{n}.json"], want[n] = log, [state], state["requests"]
    rows = edits.replay(frame(spark, logs), "requests").collect()
    for n, requests in want.items():
        for form in ("jsonl", "json"):
            found = sorted((r.ordinal, r.item) for r in rows if r.locator == f"{n}.{form}" and r.ordinal is not None)
            assert [json.loads(item) for _, item in found] == requests


def told(spark, logs, **workspaces):
    rows = chat_log.documents(frame(spark, {FOLDER + k.replace("__", "."): v for k, v in logs.items()}))
    beside = spark.createDataFrame([(FOLDER + k.replace("__", "."), v) for k, v in workspaces.items()], "locator string, record string")
    heads = chat_log.headers(rows, beside)
    found = chat_log.evidence(rows, heads)
    return heads.collect(), found.collect(), chat_log.diagnostics(rows, heads, found).collect()


def test_flat_and_log_form_tell_the_same(spark):
    first = {"requestId": "r1", "responseId": "p1", "modelId": "auto", "agent": AGENT, "timestamp": 5, "promptTokens": 7, "completionTokens": 3, "copilotCredits": 0.10}
    models = [{"model": "x", "inputTokens": 5, "outputTokens": 2, "cachedTokens": 1}, {"model": "y", "outputTokens": 4}]
    second = {"requestId": "r2", "agent": AGENT, "modelTotals": models, "sessionCopilotCredits": 2}
    log = [start(), {"kind": 2, "k": ["requests"], "v": [first]}, {"kind": 2, "k": ["requests"], "v": [{"requestId": "r2", "agent": AGENT}]}, {"kind": 1, "k": ["requests", 1, "modelTotals"], "v": models[:1]}, {"kind": 2, "k": ["requests", 1, "modelTotals"], "v": models[1:]}, {"kind": 1, "k": ["requests", 1, "sessionCopilotCredits"], "v": 2}]
    heads, found, codes = told(spark, {"a__json": [start(requests=[first, second])["v"]], "a__jsonl": log})
    assert len({h.session_id for h in heads}) == 1 and {h.code for h in heads} == {None}
    forms = [sorted(tuple(v for k, v in r.asDict().items() if k not in ("locator", "line")) for r in found if r.locator.endswith(form)) for form in (".json", ".jsonl")]
    assert forms[0] == forms[1] and len(forms[0]) == 5
    line = {(r.kind, r.model, r.request_id): r.line for r in found if r.locator.endswith("l")}
    assert line == {("turn_summary", None, "r1"): 2, ("model_totals", "x", "r2"): 4, ("model_totals", "y", "r2"): 5, ("turn_summary", None, "r2"): 3, ("session_control", None, "r2"): 6}
    pick = {(r.kind, r.model, r.request_id): r for r in found if r.locator.endswith("n")}
    turn = pick["turn_summary", None, "r1"]
    assert (turn.input_amount, turn.output_amount, str(turn.credits.normalize()), turn.presence, turn.reason, turn.at_us) == (7, 3, "0.1", "110", None, 5000)
    assert (pick["model_totals", "y", "r2"].presence, pick["model_totals", "y", "r2"].cache_read_reason, pick["turn_summary", None, "r2"].output_reason) == ("010", "not_reported", "covered_by_model_totals")
    assert sorted((c.code, c.line) for c in codes) == [("lossy_turn_summary", 1), ("lossy_turn_summary", 2)]


def test_what_a_request_may_hold(spark):
    q = lambda i, **more: {"requestId": f"r{i}", "agent": AGENT} | more
    kept = lambda a, b, **more: {"usage": {"promptTokens": a, "completionTokens": b}} | more
    requests = [
        q(0, promptTokens="7"), q(1, requestId=" ", promptTokens=1), q(2, responseId=5, promptTokens=1), q(3, modelTotals=[{"model": "x"}, {"model": "x"}]), q(4, modelTotals={}), q(5, agent={"extensionId": {"value": "x"}}), q(6),
        q(7, result={"metadata": {"promptTokens": 4, "outputTokens": 5}}), q(8, result=kept(4, 5)), q(9, result=kept(4, 5, metadata={"promptTokens": 4, "outputTokens": 6})), q(10, result=kept(4, "5")), q(11, copilotCredits=-1), q(12, sessionCopilotCredits="1"),
        q(13, promptTokens=2**63), q(14, modelTotals=[7]), 5, q(15, promptTokens=1), q(15, promptTokens=1), q(16, promptTokens=1, result=kept(4, 5)),
    ]
    _, found, codes = told(spark, {"a__json": [start(requests=requests)["v"]]})
    got = {(r.ordinal, r.kind): r for r in found if r.kind != "model_totals"}
    reason = {k[0]: r.reason for k, r in got.items() if k[1] != "session_control"}
    assert reason == {
        0: "invalid_numeric_value", 1: "missing_request_identity", 2: "invalid_response_identity", 3: "duplicate_actual_model", 4: "invalid_numeric_value", 6: None, 7: None, 8: None, 9: "conflicting_retained_usage", 10: "invalid_retained_usage", 11: "invalid_numeric_value",
        12: "invalid_numeric_value", 13: "invalid_numeric_value", 14: "invalid_numeric_value", 16: None, 18: None,
    }
    assert got[6, "unavailable"].input_reason == "not_reported" and got[0, "turn_summary"].input_reason == "invalid_count"
    last = got[7, "turn_summary"]
    assert (last.lower_bound, last.raw_input, last.output_amount, last.input_reason, last.provider) == (True, 4, 5, "cache_inclusion_unknown", None)
    assert (got[9, "turn_summary"].raw_output, got[9, "turn_summary"].retained_output, got[18, "turn_summary"].lower_bound) == (5, 6, False)
    assert got[12, "session_control"].reason == "invalid_numeric_value" and {r.reason for r in found if r.kind == "model_totals" and r.ordinal == 3} == {"duplicate_actual_model"}
    assert ("invalid_request", 1) in {(c.code, c.line) for c in codes}


def test_documents_that_are_refused_and_where_a_chat_lies(spark):
    state = lambda **more: [start(**more)["v"]]
    files = {"a__json": state(version=2), "b__json": state(version=3.0), "c__json": state(requests={}), "d__json": state(sessionId=""), "e__jsonl": [start(), {"kind": 9, "k": []}], "f__json": state(workingDirectory="file:///a%20b+c", customTitle=" x \n y ", creationDate=7), "g__json": state(workingDirectory="http://x"), "h__json": state()}
    heads, _, _ = told(spark, files, g__json='{"folder": "file://localhost/w"}', h__json='{"folder": "file://host/w"}', f__json='{"folder": "file:///no"}')
    got = {h.locator[len(FOLDER) :]: h for h in heads}
    assert [got[f"{x}.json"].code for x in "abcd"] == ["invalid_chat_state"] * 4 and got["e.jsonl"].code == "unsupported_operation"
    assert (got["f.json"].cwd, got["f.json"].title, got["f.json"].started_us, got["g.json"].cwd, got["h.json"].cwd) == ("/a b+c", "x y", 7000, "/w", None)
    from pyspark.sql import functions as F

    places = ["/x/workspaceStorage/1/chatSessions/a.json", "/x/workspaceStorage/2/chatSessions/b.jsonl", "/y/workspaceStorage/1/chatSessions/a.json", "/x/chatSessions/a.json", "x/workspaceStorage/1/chatSessions/a.json"]
    found = [r[0] for r in spark.createDataFrame([(p,) for p in places], "p string").select(chat_log.scope(F.col("p"))).collect()]
    assert found[0] == found[1] != found[2] and found[3:] == [None, None]


def test_logs_are_replayed_once_for_their_heads_and_items(spark, sf_dir):
    plan = queries.chat_evidence(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
