"""A recorded session as an ordered transcript: the branch that is shown, tools with their results, groups of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..operators.graph import branch


def shown_branch(entries: DataFrame) -> DataFrame:
    """session_id, entry_id, position of (session_id, entry_id, parent_id, line): the path to the last leaf of each session.

    A leaf is an entry that is nobody's parent; only the ways from the wanted leaves are followed, by doubled pointers.
    """
    parents = entries.where("parent_id IS NOT NULL").select("session_id", F.col("parent_id").alias("entry_id")).distinct()
    leaves = entries.join(parents, ["session_id", "entry_id"], "left_anti").groupBy("session_id").agg(F.max_by("entry_id", "line").alias("leaf"))
    node = lambda c: F.concat_ws("/", "session_id", c)
    nodes = entries.select(node("entry_id").alias("node"), F.when(F.col("parent_id").isNotNull(), node("parent_id")).alias("parent"))
    ends = leaves.select("session_id", node("leaf").alias("leaf"))
    path = branch(nodes, ends.select(F.col("leaf").alias("node"))).join(ends, "leaf").select("session_id", "node", "distance")
    known = entries.select("session_id", "entry_id", node("entry_id").alias("node"))
    ordered = Window.partitionBy("session_id").orderBy(F.col("distance").desc())
    return path.join(known, ["session_id", "node"]).select("session_id", "entry_id", F.row_number().over(ordered).cast("long").alias("position"))


def tool_label(name: Column) -> Column:
    """The group of a tool by its name."""
    low = F.lower(name)
    return F.when(low.rlike("read|cat|view|open"), "read").when(low.rlike("edit|write|patch"), "edit").when(low.rlike("bash|shell|exec|run"), "command").when(low.rlike("grep|glob|search|find"), "search").otherwise("tool")


def paired_tools(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (session_id, call_id, name, line) with their result (session_id, call_id, text, is_error) and status.

    An id that a side has twice is a conflict: no result is shown for it.
    """
    w = Window.partitionBy("session_id", "call_id")
    c = calls.withColumn("n_calls", F.count("*").over(w))
    r = results.groupBy("session_id", "call_id").agg(F.count("*").alias("n_results"), F.min("text").alias("text"), F.bool_or("is_error").alias("is_error"))
    joined = c.join(r, ["session_id", "call_id"], "left")
    clear = (F.col("n_calls") == 1) & (F.col("n_results") == 1)
    status = F.when(F.col("n_results").isNull(), "pending").when(~clear, "conflict").when(F.col("is_error"), "failed").otherwise("done")
    return joined.select("session_id", "call_id", "name", tool_label(F.col("name")).alias("category"), "line", status.alias("status"), F.when(clear, F.col("text")).alias("text"))


def view(entries: DataFrame, key: str, order: str, role: str, text: str, limit: int = 160) -> DataFrame:
    """key, position, group, role as shown, excerpt: consecutive entries of a role are one group, named at its first."""
    w = Window.partitionBy(key).orderBy(order)
    new = ~F.col(role).eqNullSafe(F.lag(role).over(w)) | (F.row_number().over(w) == 1)
    marked = entries.withColumn("__new", new)
    return marked.select(
        key, F.row_number().over(w).cast("long").alias("position"), F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("group"),
        F.when(F.col("__new"), F.col(role)).alias("shown_role"), excerpt(F.col(text), limit).alias("excerpt"),
    )
