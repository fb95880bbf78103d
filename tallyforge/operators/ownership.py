"""Families of sessions: who owns a delegated session, by evidence that names exactly one owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import chain_roots
from .matching import unique_only


def owners(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """child, owner, problem of (child, kind, key) looked up in (kind, key, session_id).

    A key that several sessions have names none of them. Evidence that names several owners is ambiguous; a session isn't
    its own owner.
    """
    full = lambda: F.concat_ws("\x1f", "kind", F.col("key").cast("string"))
    known = unique_only(names, full(), F.col("session_id")).withColumnRenamed("key", "full")
    found = evidence.select("child", full().alias("full")).join(known, "full", "left").where("value IS NULL OR value != child")
    per = found.groupBy("child").agg(F.countDistinct("value").alias("n"), F.min("value").alias("owner"))
    return per.select("child", F.when(F.col("n") == 1, F.col("owner")).alias("owner"), F.when(F.col("n") == 0, "owner_unknown").when(F.col("n") > 1, "owner_ambiguous").alias("problem"))


def families(sessions: DataFrame, owned: DataFrame) -> DataFrame:
    """session_id, family (the root of its owners), problem: sessions on a cycle of owners are families of their own."""
    nodes = sessions.select(F.col("session_id").alias("node")).join(owned.select(F.col("child").alias("node"), F.col("owner").alias("parent"), "problem"), "node", "left")
    roots = chain_roots(nodes.select("node", "parent"))
    return nodes.join(roots, "node").select(F.col("node").alias("session_id"), F.coalesce("root", "node").alias("family"), F.when(F.col("root").isNull(), "owner_cycle").otherwise(F.col("problem")).alias("problem"))


def titles(rows: DataFrame, key: str, name: str, updated: str, order: str) -> DataFrame:
    """The name of each key that was updated last; of equal times the later row."""
    return rows.groupBy(key).agg(F.max_by(name, F.struct(updated, order)).alias(name))


def settled_directory(rows: DataFrame, session: str, directory: str) -> DataFrame:
    """A session's directory if all that is said of it agrees, else null, and whether it is disputed."""
    n = F.countDistinct(directory)
    return rows.groupBy(session).agg(F.when(n == 1, F.min(directory)).alias(directory), (n > 1).alias("disputed"))
