"""Version 3 tree logs: a session header, then entries that point at their parents.

The reader yields entries as rows; usage is taken with column expressions from the lines that are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import instant
from .lines import count

#: Roles and stop reasons of the log.
FINISHED = ("stop", "length", "toolUse", "error", "aborted")
USAGE_KINDS = ("message", "compaction", "branch_summary")


def _text(path: str) -> Column:
    return F.get_json_object("record", f"$.{path}")


def headers(lines: DataFrame) -> DataFrame:
    """locator, session_id, cwd, parent_locator, started_us: of files whose first line is a version 3 header."""
    first = lines.where("line = 1 AND status = 'ok'")
    return first.where((_text("type") == "session") & (count(F.col("record"), "version") == 3) & _text("id").isNotNull()).select(
        "locator", _text("id").alias("session_id"), _text("cwd").alias("cwd"), _text("parentSession").alias("parent_locator"), instant(_text("timestamp")).alias("started_us")
    )


def entries(lines: DataFrame) -> DataFrame:
    """One row per entry with an id: its parent, kind, model, time, and the counts of its usage with their states."""
    usage = F.when(_text("type") == "message", "message.usage").otherwise("usage")
    pick = lambda name: F.when(usage == "message.usage", count(F.col("record"), "message", "usage", name)).otherwise(count(F.col("record"), "usage", name))
    has = F.coalesce(_text("message.usage"), _text("usage")).isNotNull()
    kind = F.when(_text("message.role") == "assistant", "assistant").when(_text("message.role") == "toolResult", "tool_result").otherwise(_text("type"))
    names = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "reported": "totalTokens"}
    at = instant(_text("timestamp"))
    out = lines.where("status = 'ok' AND line > 1").where(_text("id").isNotNull()).select(
        "locator", "line", _text("id").alias("entry_id"), _text("parentId").alias("parent_entry"), kind.alias("kind"), _text("message.provider").alias("provider"), _text("message.model").alias("model"),
        _text("message.stopReason").alias("stop_reason"), at.alias("at_us"), has.alias("has_usage"), *(pick(v).alias(f"{k}_amount") for k, v in names.items()),
    )
    states = [F.when(F.col(f"{k}_amount").isNull(), "unknown").otherwise("known").alias(f"{k}_state") for k in names]
    pending = (F.col("kind") == "assistant") & ~F.coalesce(F.col("stop_reason").isin(*FINISHED), F.lit(False))
    time_kind = F.when(F.col("at_us").isNull(), "undated").when(F.col("kind") == "assistant", "point").otherwise("interval")
    return out.select("*", *states, pending.alias("pending"), time_kind.alias("time_kind"), F.lit(None).cast("long").alias("start_us"))


def observations(lines: DataFrame) -> DataFrame:
    """The entries with usage, with their session; what a tool reports and what isn't finished stays unresolved."""
    decision = F.when(F.col("kind") == "tool_result", "unresolved").when(F.col("pending"), "unresolved").otherwise("selected")
    rows = entries(lines).where("has_usage").join(headers(lines), "locator")
    return rows.withColumn("decision", decision).withColumn("lower_bound", F.lit(False))


def diagnostics(lines: DataFrame) -> DataFrame:
    """locator, line, code of broken lines, and of entry ids that stand twice in a file."""
    broken = lines.where("status = 'malformed'").select("locator", "line", F.lit("malformed_line").alias("code"))
    twice = entries(lines).groupBy("locator", "entry_id").agg(F.max("line").alias("line"), F.count("*").alias("n")).where("n > 1").select("locator", "line", F.lit("duplicate_entry_id").alias("code"))
    return broken.unionByName(twice)
