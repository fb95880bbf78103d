"""What the event queries do once: chains are passed over once, and a session's counters are one pass over its events."""

from pyspark.sql import functions as F

from tallyforge import queries
from tallyforge.operators import chains
from tallyforge.sources import event_log


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chains_are_passed_over_once(spark, sf_dir):
    plan = _plan(queries.event_counters(spark, sf_dir))
    assert "MapInArrow" not in plan and plan.count("Generate") == 1 and "Union" not in plan


def test_verdicts_are_never_broadcast(spark, sf_dir):
    assert "SortMergeJoin" in queries.event_counters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_chain_are_given(spark):
    rows = spark.createDataFrame([(f"f{i}", 1, True, True, "a", None) for i in range(20)], "locator string, line long, is_start boolean, valid boolean, event_id string, parent_id string")
    found = chains.qualify(rows, 7)
    assert found.rdd.getNumPartitions() == 7 and found.where("code IS NULL").count() == 40


def test_counts_with_a_point_are_no_counts(spark):
    usage = '{"inputTokens":5.0,"outputTokens":2,"cacheReadTokens":0,"cacheWriteTokens":0}'
    data = '{"sessionStartTime":0,"shutdownType":"routine","totalApiDurationMs":5,"codeChanges":{"filesModified":[],"linesAdded":1,"linesRemoved":0},"totalNanoAiu":1,"modelMetrics":{"m":{"requests":{},"usage":%s}}}' % usage
    events = spark.createDataFrame([("f", "s", "e", 2, "x", 0, 0, "session.shutdown", True, False, data)], "locator string, session_id string, epoch string, line long, event_id string, at_ms long, started_ms long, kind string, accepted boolean, named_agent boolean, data string")
    row = event_log.counters(events.withColumn("v", F.try_parse_json("data"))).where("scope = 'model'").first()
    assert row.input is None and row.output == 2 and row.invalid == ["input"] and row.input_reason == "invalid_counter"


def test_last_shutdowns_are_read_once(spark, sf_dir):
    # No generator of counters is left in what is returned: the last shutdowns are written.
    assert "Generate" not in _plan(queries.event_files(spark, sf_dir))
