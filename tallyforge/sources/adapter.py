"""The driver's tables seen as an evidence ledger: sessions, observations, quantities and source generations.

Amounts are whole numbers taken from the floats by floor, so sums are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = ("input", "output", "cache_read", "cache_write")
MEASURES = (*BUCKETS, "reported")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, harness, project_id, parent_id, started_us."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    number = F.substring("o_orderpriority", 1, 1)
    harness = F.concat(F.lit("harness"), number)
    project = F.when(F.col("o_custkey") % 7 == 0, None).otherwise(F.concat(F.lit("directory:/n"), F.col("c_nationkey").cast("string")))
    parent = F.when((F.col("o_orderkey") % 5 == 0) & (F.col("o_orderkey") > 0), F.expr("o_orderkey div 5"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("session_id"), harness.alias("harness"), project.alias("project_id"), parent.alias("parent_id"), micros("o_orderdate").alias("started_us")
    )


def observations(spark: SparkSession, sf_dir: str, line: DataFrame | None = None, *more: str) -> DataFrame:
    """One row per line item: identity, time, model, and per measure its state, amount and decision; of line items that are given, with more of their columns."""
    line = table(spark, sf_dir, "lineitem") if line is None else line
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    whole = lambda c, by=1: F.floor(F.col(c) * by).cast("long")
    at = micros("l_shipdate")
    kind = F.when((F.col("l_linestatus") == "O") & (n == 7), "undated").when((F.col("l_linestatus") == "F") & (n % 3 == 0), "interval").otherwise("point")
    states = {
        "input": F.when((F.col("l_returnflag") == "R") & (n % 2 == 0), "unknown").otherwise("known"),
        "output": F.when(supp % 11 == 0, "unknown").otherwise("known"),
        "cache_read": F.when((F.col("l_returnflag") == "A") & (part % 5 == 0), "not_applicable").otherwise("known"),
        "cache_write": F.when(part % 3 == 0, "not_applicable").otherwise("known"),
        "reported": F.when(part % 4 == 0, "known").otherwise("unknown"),
    }
    amounts = {"input": whole("l_quantity", 10), "output": whole("l_extendedprice"), "cache_read": whole("l_discount", 100), "cache_write": whole("l_tax", 100)}
    amounts["reported"] = sum(amounts.values()) + F.when(part % 8 == 0, 1).otherwise(0)
    decision = F.when(part % 13 == 0, "excluded").when(part % 17 == 0, "unresolved").otherwise("selected")
    invalid = {"input": n == 2, "output": supp % 2 == 0, "cache_read": F.lit(False), "cache_write": F.lit(False), "reported": part % 4 == 1}
    reasons = {m: F.when(states[m] == "unknown", F.when(invalid[m], "invalid_count").otherwise("not_reported")) for m in MEASURES}
    columns = [c for m in MEASURES for c in (states[m].alias(f"{m}_state"), F.when(states[m] == "known", amounts[m]).alias(f"{m}_amount"), reasons[m].alias(f"{m}_reason"))]
    return line.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"), F.col("l_orderkey").alias("session_id"), n.cast("long").alias("native_id"),
        kind.alias("time_kind"), F.when(kind != "undated", at).alias("at_us"), F.when((kind == "interval") & (n != 3), at - 86_400_000_000 * n.cast("long")).alias("start_us"),
        F.when(supp % 10 == 0, None).otherwise(F.concat(F.lit("provider"), (supp % 3).cast("string"))).alias("provider"),
        F.when(part % 25 == 0, None).otherwise(F.concat(F.lit("model"), (part % 25).cast("string"))).alias("model"),
        decision.alias("decision"), ((supp % 7) == 0).alias("lower_bound"), *columns, *more,
    )


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, harness, measure, state, amount, lower_bound, decision, at_us."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.when(i % 9 == 0, "unknown").when(i % 23 == 0, "not_applicable").otherwise("known")
    return e.select(
        i, "user_id", F.col("event_type").alias("harness"), F.when(F.col("user_id") % 2 == 0, "credits").otherwise("requests").alias("measure"), state.alias("state"),
        F.when(state == "known", F.floor(F.col("value") * 100).cast("long")).alias("amount"), ((i % 5) == 0).alias("lower_bound"),
        F.when(i % 7 == 0, "excluded").when(i % 31 == 0, "unresolved").otherwise("selected").alias("decision"), micros("ts").alias("at_us"), "props",
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, locator, generation, available, bytes: events as generations of the files of 150 users."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("source_id"), F.concat(F.lit("/logs/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("locator"), F.col("event_id").alias("generation"),
        (F.col("event_type") != "error").alias("available"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), "user_id",
    )


#: The same for DuckDB, as common table expressions.
SQL = """
sessions AS (
  SELECT o_orderkey AS session_id, 'harness' || substring(o_orderpriority, 1, 1) AS harness,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'directory:/n' || CAST(c_nationkey AS VARCHAR) END AS project_id,
    CASE WHEN o_orderkey % 5 = 0 AND o_orderkey > 0 THEN o_orderkey // 5 END AS parent_id, epoch_us(o_orderdate) AS started_us
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), raw_observations AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS observation_id, l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS native_id,
    CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'undated' WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN 'interval' ELSE 'point' END AS time_kind,
    epoch_us(l_shipdate) AS us, l_linenumber AS n, l_suppkey AS supp, l_partkey AS part,
    CASE WHEN l_suppkey % 10 <> 0 THEN 'provider' || CAST(l_suppkey % 3 AS VARCHAR) END AS provider,
    CASE WHEN l_partkey % 25 <> 0 THEN 'model' || CAST(l_partkey % 25 AS VARCHAR) END AS model,
    CASE WHEN l_partkey % 13 = 0 THEN 'excluded' WHEN l_partkey % 17 = 0 THEN 'unresolved' ELSE 'selected' END AS decision, l_suppkey % 7 = 0 AS lower_bound,
    CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'unknown' ELSE 'known' END AS input_state, CAST(floor(l_quantity * 10) AS BIGINT) AS input_a,
    CASE WHEN l_suppkey % 11 = 0 THEN 'unknown' ELSE 'known' END AS output_state, CAST(floor(l_extendedprice) AS BIGINT) AS output_a,
    CASE WHEN l_returnflag = 'A' AND l_partkey % 5 = 0 THEN 'not_applicable' ELSE 'known' END AS cache_read_state, CAST(floor(l_discount * 100) AS BIGINT) AS cache_read_a,
    CASE WHEN l_partkey % 3 = 0 THEN 'not_applicable' ELSE 'known' END AS cache_write_state, CAST(floor(l_tax * 100) AS BIGINT) AS cache_write_a,
    CASE WHEN l_partkey % 4 = 0 THEN 'known' ELSE 'unknown' END AS reported_state, CASE WHEN l_partkey % 8 = 0 THEN 1 ELSE 0 END AS extra
  FROM lineitem
), observations AS (
  SELECT observation_id, session_id, native_id, time_kind, CASE WHEN time_kind <> 'undated' THEN us END AS at_us,
    CASE WHEN time_kind = 'interval' AND n <> 3 THEN us - 86400000000 * n END AS start_us, provider, model, decision, lower_bound,
    input_state, CASE WHEN input_state = 'known' THEN input_a END AS input_amount, output_state, CASE WHEN output_state = 'known' THEN output_a END AS output_amount,
    cache_read_state, CASE WHEN cache_read_state = 'known' THEN cache_read_a END AS cache_read_amount,
    cache_write_state, CASE WHEN cache_write_state = 'known' THEN cache_write_a END AS cache_write_amount,
    CASE WHEN input_state = 'unknown' THEN CASE WHEN n = 2 THEN 'invalid_count' ELSE 'not_reported' END END AS input_reason,
    CASE WHEN output_state = 'unknown' THEN CASE WHEN supp % 2 = 0 THEN 'invalid_count' ELSE 'not_reported' END END AS output_reason, CAST(NULL AS VARCHAR) AS cache_read_reason, CAST(NULL AS VARCHAR) AS cache_write_reason,
    CASE WHEN reported_state = 'unknown' THEN CASE WHEN part % 4 = 1 THEN 'invalid_count' ELSE 'not_reported' END END AS reported_reason,
    reported_state, CASE WHEN reported_state = 'known' THEN input_a + output_a + cache_read_a + cache_write_a + extra END AS reported_amount
  FROM raw_observations
), quantities AS (
  SELECT event_id, user_id, event_type AS harness, CASE WHEN user_id % 2 = 0 THEN 'credits' ELSE 'requests' END AS measure,
    CASE WHEN event_id % 9 = 0 THEN 'unknown' WHEN event_id % 23 = 0 THEN 'not_applicable' ELSE 'known' END AS state,
    CASE WHEN event_id % 9 <> 0 AND event_id % 23 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS amount, event_id % 5 = 0 AS lower_bound,
    CASE WHEN event_id % 7 = 0 THEN 'excluded' WHEN event_id % 31 = 0 THEN 'unresolved' ELSE 'selected' END AS decision, epoch_us(ts) AS at_us, props
  FROM events
), generations AS (
  SELECT event_id AS source_id, '/logs/' || CAST(user_id AS VARCHAR) || '.jsonl' AS locator, event_id AS generation, event_type <> 'error' AS available,
    CAST(floor(value * 100) AS BIGINT) AS bytes, user_id
  FROM events
)"""
