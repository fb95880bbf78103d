"""Which observation counts once, and which is a copy, superseded or contradictory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .lineage import nearest


def identity_conflicts(rows: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Keys under which more than one fingerprint stands, with how many."""
    return rows.groupBy(*keys).agg(F.countDistinct(fingerprint).cast("long").alias("variants")).where("variants > 1")


def canonical(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Adds ``canonical``: whether a row is the first of its key."""
    return rows.withColumn("canonical", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def copied_paths(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Decisions of (session_id, native_id, observation_id, fingerprint) along session parents.

    In one session: several fingerprints are a conflict, further equal rows are variants of the smallest id. Across
    sessions the nearest ancestor that has the same native id decides: an equal fingerprint is a proven copy, another
    one a conflict; without such an ancestor the row is independent.
    """
    per = rows.groupBy("session_id", "native_id").agg(F.countDistinct("fingerprint").alias("variants"), F.min("observation_id").alias("first"), F.min("fingerprint").alias("own"))
    scratch = Scratch(rows.sparkSession, "copies")
    per = scratch.table(per)
    tree = sessions.select(F.col("session_id").alias("node"), F.col("parent_id").alias("parent"))
    held = per.select("session_id", F.col("native_id").alias("key"), F.struct(F.col("variants").alias("up_variants"), F.col("own").alias("up_own")).alias("what"))
    near = nearest(held, scratch.table(tree), scratch).withColumnRenamed("key", "native_id")
    reason = (
        F.when(F.col("variants") > 1, "identity_conflict")
        .when(F.col("observation_id") != F.col("first"), "identical_measure_variant")
        .when(F.col("near").isNull(), "independent_entry")
        .when((F.col("near.up_variants") == 1) & (F.col("near.up_own") == F.col("own")), "proven_copied_path")
        .otherwise("copied_identity_conflict")
    )
    state = F.when(reason == "independent_entry", "selected").when(reason.isin("identical_measure_variant", "proven_copied_path"), "excluded").otherwise("unresolved")
    joined = rows.join(per, ["session_id", "native_id"]).join(near, ["session_id", "native_id"], "left")
    return joined.select("observation_id", "session_id", "native_id", state.alias("state"), reason.alias("reason"))


def cumulative_sinks(rows: DataFrame, group: list[str], source: str, order: str, amount: str, row_id: str) -> DataFrame:
    """Decisions of cumulative counters: of a group the last row counts and covers the others.

    A group is comparable if it stands in one source, no amount is null and none falls from row to row; only neighbours
    are compared, as the order within a source is total.
    """
    w = Window.partitionBy(*group, source).orderBy(order)
    steps = rows.withColumn("__falls", F.coalesce(F.col(amount) < F.lag(amount).over(w), F.lit(False)))
    per = steps.groupBy(*group).agg(F.countDistinct(source).alias("__sources"), F.max(F.col("__falls").cast("int")).alias("__fell"), F.max(F.col(amount).isNull().cast("int")).alias("__open"), F.max(order).alias("__last"))
    good = (F.col("__sources") == 1) & (F.col("__fell") == 0) & (F.col("__open") == 0)
    state = F.when(~good, "unresolved").when(F.col(order) == F.col("__last"), "selected").otherwise("excluded")
    return rows.join(per, group).select(row_id, *group, state.alias("state"))


def session_controls(rows: DataFrame, session: str, order: str, amount: str, control: str, row_id: str) -> DataFrame:
    """Decisions of turns and session controls: the largest control (ties: the latest) counts with all turns after it."""
    best = rows.where(F.col(control)).groupBy(session).agg(F.max(F.struct(amount, order)).alias("__best"))
    joined = rows.join(best, session, "left")
    at = F.col(f"__best.{order}")
    state = (
        F.when(at.isNull(), "selected").when(F.col(control) & (F.col(order) == at), "selected").when(F.col(control) | (F.col(order) < at), "excluded").otherwise("selected")
    )
    return joined.select(row_id, session, state.alias("state"))


def signatures(rows: DataFrame, keys: list[str], *facts: str) -> DataFrame:
    """A digest of each key's facts that doesn't depend on their order."""
    fact = F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in facts))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(fact)), ","), 256).alias("signature"), F.countDistinct(fact).cast("long").alias("facts"))
