"""Call logs: whose they are, how final their counts are, and what can't be used."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import call_log

ID = "6f0c1f3e-1111-4222-8333-0123456789ab"


def entry(i, usage=None, **more):
    message = {"id": f"m{i}", "model": "x", "usage": {"input_tokens": 11, "output_tokens": 7, "cache_read_input_tokens": 5} if usage is None else usage}
    return {"type": "assistant", "uuid": f"u{i}", "requestId": f"q{i}", "sessionId": ID, "timestamp": "2026-03-02T01:00:00Z", "version": "2.1.98", "cwd": "/w", "message": message} | more


def lines(spark, **files):
    rows = [(name.replace("__", "/") + ".jsonl", i, json.dumps(r) if r else None, "ok" if r else "malformed") for name, records in files.items() for i, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, "locator string, line long, record string, status string")


def test_locators(spark):
    cases = {f"/a/{ID}.jsonl": (ID, None, None), f"/a/{ID.upper()}.jsonl": (ID, None, None), f"/a/{ID}/subagents/agent-k.jsonl": (ID, "k", f"/a/{ID}.jsonl"), f"/a/{ID}/subagents/deep/agent-k.jsonl": (ID, "k", f"/a/{ID}.jsonl"), "/a/b.jsonl": None, f"/a/{ID}/subagents/k.jsonl": None, "/a/b/subagents/agent-k.jsonl": None, f"/a/{ID}.json": None}
    found = spark.createDataFrame([(c,) for c in cases], "l string").select("l", call_log.identity(F.col("l")).alias("i")).collect()
    assert {r.l: r.i and tuple(r.i) for r in found} == cases


@pytest.mark.parametrize("kind, versions", [("final", ["2.1.97", "2.1.97+b", "2.2.0-rc.1", "10.0.0", "2.1.98-0"]), ("placeholder", ["2.1.97-rc", "2.1.96", "0.0.1", "2.0.999"]), ("unqualified", ["2.1", "v2.1.98", "2.1.098", "2.1.98-01", "", "2.1.98 ", None, "2.1." + "9" * 130])])
def test_writers(spark, kind, versions):
    found = spark.createDataFrame([(v,) for v in versions], "v string").select("v", call_log.writer(F.col("v")).alias("k")).collect()
    assert [r.v for r in found if r.k != kind] == []


def test_observations_and_diagnostics(spark):
    records = [
        entry(1), entry(2, {"input_tokens": 1}), entry(3, {"input_tokens": 1, "output_tokens": "x"}), entry(4, version="2.1.90"), entry(5, version="?"), entry(6, {"input_tokens": "1", "output_tokens": 1}), entry(7, uuid=None), entry(8, requestId=None, message={"model": "x", "usage": {"input_tokens": 1}}),
        entry(9, message={"id": "m", "usage": {}}), entry(10, timestamp="noon"), {"type": "user", "uuid": "z", "sessionId": ID, "cwd": "rel"}, None, {"type": "summary"},
    ]
    found = lines(spark, **{ID: records, "other": [entry(1)], f"{ID}__subagents__agent-k": [entry(1, sessionId=ID.upper())], ID.replace("6f", "7f"): [entry(1)]})
    rows = call_log.parsed(found)
    got = {(r.session_id, r.line): r for r in call_log.observations(rows).collect()}
    pick = {k[1]: (r.output_amount, r.output_reason, r.finality, r.usable, r.reason) for k, r in got.items() if k[0] == ID}
    assert pick == {
        1: (7, None, "final", True, None), 2: (None, "not_reported", "final_missing", True, None), 3: (None, "invalid_count", "invalid", False, "invalid_count"), 4: (None, "stream_start_placeholder", "placeholder", True, None),
        5: (None, "writer_version_unavailable", "unqualified", True, None), 8: (None, "not_reported", "final_missing", False, "missing_identity"), 10: (7, None, "final", True, None),
    }
    first = got[ID, 1]
    assert (first.input_amount, first.cache_read_amount, first.cache_write_amount, first.cache_write_reason, first.time_kind) == (11, 5, None, "not_reported", "point") and got[ID, 10].time_kind == "undated"
    assert (f"{ID}:agent:k", 1) in got and len(got) == 8
    heads = {r.session_id: (r.parent_id, r.cwd, r.cwd_state) for r in call_log.headers(rows).collect()}
    assert heads == {ID: (None, None, "invalid"), f"{ID}:agent:k": (ID, "/w", "valid")}
    codes = sorted((r.locator[:2], r.line or 0, r.code) for r in call_log.diagnostics(found).collect())
    assert codes == sorted([("6f", 11, "cwd_attribution_unavailable"), ("6f", 3, "invalid_count"), ("6f", 5, "writer_version_unavailable"), ("6f", 6, "invalid_count"), ("6f", 7, "invalid_entry_identity"), ("6f", 9, "invalid_model"), ("6f", 10, "invalid_timestamp"), ("6f", 12, "malformed_json"), ("ot", 0, "conflicting_session_identity"), ("7f", 0, "conflicting_session_identity")])
