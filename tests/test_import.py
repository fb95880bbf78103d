"""Readers of lines and tree logs, and the incremental import."""

import json
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.evidence import all_sums
from tallyforge.sources import lines, tree_log
from tallyforge.streaming.importer import Ledger, import_stream


def entry(i, parent, usage, role="assistant", stop="stop", **more):
    return {"type": "message", "id": f"e{i}", "parentId": parent, "timestamp": f"2026-09-12T10:0{i}:00Z", "message": {"role": role, "provider": "p", "model": "m", "stopReason": stop, "usage": usage, **more}}


HEADER = {"type": "session", "version": 3, "id": "s1", "timestamp": "2026-09-12T10:00:00+02:00", "cwd": "/w"}
USAGE = {"input": 317, "output": 41, "cacheRead": 2063, "cacheWrite": 79, "totalTokens": 2500}


def write(path, rows, tail=""):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows) + tail)


def read(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(str(folder))
    return lines.read_lines(files)


def test_tree_log(spark, tmp_path):
    rows = [HEADER, entry(1, None, USAGE), '{"id": 1, "id": 2}', entry(2, "e1", USAGE | {"input": 1.5}), entry(3, "e2", USAGE, role="toolResult"), entry(4, "e3", USAGE, stop="pending"), {"type": "session_info", "id": "e5", "name": "n"}, entry(6, "e5", USAGE | {"output": 2**63})]
    write(tmp_path / "a.jsonl", rows, '{"type": "mess')
    found = read(spark, tmp_path).cache()
    assert sorted((r.line, r.status) for r in found.where("status != 'ok'").collect()) == [(3, "malformed"), (9, "pending")]
    obs = tree_log.observations(found)
    assert {(r.entry_id, r.decision, r.input_amount, r.output_amount) for r in obs.collect()} == {("e1", "selected", 317, 41), ("e2", "selected", None, 41), ("e3", "unresolved", 317, 41), ("e4", "unresolved", 317, 41), ("e6", "selected", 317, None)}
    sums = obs.agg(*all_sums()).first()
    assert (int(sums.input_known), sums.input_unknown, int(sums.cache_read_known)) == (634, 3, 6189)
    assert [r.code for r in tree_log.diagnostics(found).collect()] == ["malformed_line"]


def test_import_is_incremental_and_repeatable(spark, tmp_path):
    logs, ledger = tmp_path / "logs", Ledger(spark, str(tmp_path / "ledger"))
    logs.mkdir()
    write(logs / "a.jsonl", [HEADER])
    write(logs / "b.jsonl", [HEADER | {"id": "s2"}])
    run = lambda: import_stream(spark, str(logs), ledger, str(tmp_path / "offsets")).awaitTermination()
    run()
    assert ledger.revision() == 1 and ledger.sources().count() == 2
    run()
    assert ledger.revision() == 1
    again = spark.read.format("binaryFile").load(str(logs)).select("path", "content")
    assert not ledger.merge(again)
    write(logs / "a.jsonl", [HEADER, entry(1, None, USAGE)])
    assert ledger.merge(spark.read.format("binaryFile").load(str(logs)).select("path", "content"))
    assert sorted((r.locator[-7:], r.generation) for r in ledger.sources().collect()) == [("a.jsonl", 1), ("a.jsonl", 2), ("b.jsonl", 1)]
    (logs / "b.jsonl").unlink()
    assert ledger.mark_missing(spark.read.format("binaryFile").load(str(logs)).select("path"))
    assert [r.locator[-7:] for r in ledger.sources().where("NOT available").collect()] == ["b.jsonl"]


def test_versions_are_never_replaced(spark, tmp_path):
    ledger, other = Ledger(spark, str(tmp_path / "ledger")), Ledger(spark, str(tmp_path / "ledger"))
    batch = lambda *rows: spark.createDataFrame(rows, "path string, content binary, modificationTime timestamp").withColumn("modificationTime", F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, int(length(content)))"))
    assert ledger.merge(batch(("a", b"longer", None), ("a", b"new", None), ("b", b"x", None)))
    first = [tuple(r) for r in ledger.sources().orderBy("locator", "generation").select("locator", "generation", "bytes").collect()]
    assert first == [("a", 1, 3), ("a", 2, 6), ("b", 1, 1)]
    assert other.mark_missing(spark.createDataFrame([("a",)], "path string")) and ledger.revision() == 2
    assert ledger.sources(1).where("NOT available").count() == 0 and ledger.sources().where("NOT available").count() == 1
    assert ledger.contents().count() == 3
    (tmp_path / "ledger" / "rows" / "torn").mkdir()  # a crash before the commit
    assert ledger.revision() == 2 and ledger.sources().count() == 3


def test_of_two_writers_of_a_version_one_fails_and_both_batches_are_there_after_its_retry(spark, tmp_path, monkeypatch):
    ledger, other = Ledger(spark, str(tmp_path / "ledger")), Ledger(spark, str(tmp_path / "ledger"))
    batch = lambda name: spark.createDataFrame([(name, name.encode())], "path string, content binary")
    real = other._commit
    monkeypatch.setattr(other, "_commit", lambda rows, after, name: (ledger.merge(batch("a")), real(rows, after, name)))  # the other one is first
    with pytest.raises(RuntimeError, match="another writer"):
        other.merge(batch("b"))
    monkeypatch.undo()
    assert [r.locator for r in ledger.sources().collect()] == ["a"]
    assert other.merge(batch("b")) and ledger.revision() == 2 and sorted(r.locator for r in ledger.sources().collect()) == ["a", "b"]


def test_a_writer_that_died_at_its_commit_stops_nobody(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    batch = spark.createDataFrame([("a", b"x")], "path string, content binary")
    assert ledger.merge(batch)
    (tmp_path / "ledger" / "commits" / f"{2:012d}").write_bytes(b"abc")  # without its line's end
    assert ledger.sources().count() == 1 and not ledger.merge(batch)
    assert ledger.mark_missing(batch.where("false")) and ledger.revision() == 3 and ledger.sources().where("NOT available").count() == 1


def test_scratch_folders_go_with_the_session(tmp_path):
    # Spark makes a folder of its own there.
    program = "from pyspark.sql import SparkSession; from tallyforge.sources.scratch import Scratch; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '%s').getOrCreate(); t = Scratch(s, 't').table(s.range(3)); assert t.count() == 3; s.stop()" % tmp_path
    subprocess.run([sys.executable, "-c", program], check=True, timeout=120, cwd=str(Path(__file__).resolve().parent.parent))
    for _ in range(50):
        if not any(tmp_path.glob("t-*")):
            break
        time.sleep(0.2)
    assert not any(tmp_path.glob("t-*"))
