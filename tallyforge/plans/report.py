"""The usage report: one population, from which totals, projects, models, sessions and buckets are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import BUCKETS, all_sums, included, in_scope, normalized_total
from ..sources.scratch import Scratch

DAY = 86_400_000_000


def wide(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations with their session's harness, project and start."""
    return observations.join(sessions.select("session_id", "harness", "project_id", "started_us", "parent_id"), "session_id")


def scoped(observations: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """The population of a dated report, with the flag for what counts."""
    return observations.where(in_scope(start_us, end_us)).withColumn("included", included(start_us, end_us))


def bucket_of(zone: str = "UTC") -> Column:
    """The local day of a point, as its start in microseconds; null for what isn't a point."""
    local = F.from_utc_timestamp(F.timestamp_micros("at_us"), zone)
    return F.when(F.col("time_kind") == "point", F.unix_micros(F.to_utc_timestamp(F.date_trunc("DAY", local), zone)))


def grouped(observations: DataFrame, *keys: str | Column) -> DataFrame:
    """The counters of every bucket by key; null keys are groups of their own."""
    selected = F.max((F.col("decision") == "selected").cast("int")).alias("selected")
    return observations.groupBy(*keys).agg(F.count("*").cast("long").alias("observations"), selected, *all_sums())


def grouping_sets(rows: DataFrame) -> DataFrame:
    """Total, projects, models and days; ``level`` tells a subtotal from a null key.

    Days are aggregated apart: together with them the other keys would make nearly as many groups as there are rows.
    """
    known = [f"{b}_known" for b in BUCKETS]
    agg = [F.sum("observations").cast("long").alias("observations"), *[F.sum(k).cast("decimal(38,0)").alias(k) for k in known]]
    names = ("project_id", "harness", "provider", "model")
    p, h, v, m = (F.col(c) for c in names)
    sets = grouped(rows, *names).groupingSets([[], [p], [h, v, m]], p, h, v, m).agg((F.grouping_id() * 2 + 1).cast("long").alias("level"), *agg).withColumn("bucket_us", F.lit(None).cast("long"))
    days = grouped(rows, "bucket_us").select(*(F.lit(None).cast("string").alias(c) for c in names), F.lit(30).cast("long").alias("level"), "observations", *known, "bucket_us")
    return sets.unionByName(days).select(*names, "bucket_us", "level", "observations", *known)


def dense_days(base: DataFrame) -> DataFrame:
    """Every day from the first to the last point, zero where nothing stood."""
    ends = base.where("bucket_us IS NOT NULL").agg(F.min("bucket_us").alias("a"), F.max("bucket_us").alias("b")).where("a IS NOT NULL")
    axis = ends.select(F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(DAY))).alias("bucket_us"))
    days = base.where("bucket_us IS NOT NULL").groupBy("bucket_us").agg(F.sum("observations").cast("long").alias("observations"), F.sum("input_known").cast("decimal(38,0)").alias("input_known"))
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    return axis.join(days, "bucket_us", "left").select("bucket_us", zero("observations", "long"), zero("input_known", "decimal(38,0)"))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page of rows, counted from 1 and clamped to the last, with each row's rank and the count of all.

    Each task keeps its first rows up to the page's end; only those meet in one task. The rows are written first, as they are counted and then read, and what they come from may be long.
    """
    if number < 1 or size < 1:
        raise ValueError("page and size count from 1")
    rows = Scratch(rows.sparkSession, "page").table(rows)
    total = rows.count()
    last = max(1, -(-total // size))
    first = (min(number, last) - 1) * size
    cut = rows.orderBy(*order).offset(first).limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return cut.withColumn("position", (rank + first).cast("long")).withColumn("total_rows", F.lit(total).cast("long"))


def conditions(base: DataFrame) -> dict[str, Column]:
    """What makes a report partial, by code; rows of a dated report say whether they are included, and why an amount is unknown where they have such columns."""
    selected = F.col("decision") == "selected"
    any_of = lambda state: F.greatest(*(F.col(f"{b}_state") == state for b in BUCKETS))
    total = normalized_total(f"{BUCKETS[0]}_reason" in base.columns)
    untimed = F.col("time_kind") == "undated"
    found = {
        "unresolved_evidence": F.col("decision") == "unresolved",
        "interval_only": F.col("time_kind") == "interval",
        "timing_unavailable": untimed | ~F.col("included") if "included" in base.columns else untimed,
        "unknown_model_identity": F.col("provider").isNull() | F.col("model").isNull(),
        "unassigned": F.col("project_id").isNull(),
        "lower_bound": selected & F.col("lower_bound") & (F.col("output_state") == "known"),
        "_known_usage": selected & (any_of("known") | total.isNotNull()),
        "usage_partial": selected & (any_of("unknown") | total.isNull()),
        "not_applicable": selected & any_of("not_applicable"),
    }
    return {code: F.coalesce(c, F.lit(False)) for code, c in found.items()}


def coverage(base: DataFrame) -> DataFrame:
    """observation_id, code: what makes a report partial, one pass over the population."""
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in conditions(base).items())))
    return base.select("observation_id", "project_id", "session_id", F.explode(codes).alias("code"))


def coverage_codes(base: DataFrame, scope: str) -> DataFrame:
    """Codes by scope with the count of distinct sessions; partial usage is unavailable where none is known.

    A session has a flag for each code, so nothing is exploded and sessions are shuffled once.
    """
    codes = conditions(base)
    per = base.groupBy(scope, "session_id").agg(*(F.max(c).alias(k) for k, c in codes.items()))
    counts = per.groupBy(scope).agg(*(F.count_if(F.col(k)).cast("long").alias(k) for k in codes))
    name = lambda k: F.when(F.col("_known_usage") == 0, "usage_unavailable").otherwise(k) if k == "usage_partial" else F.lit(k)
    rows = F.array(*(F.struct(name(k).alias("code"), F.col(k).alias("sessions")) for k in codes if k != "_known_usage"))
    return counts.select(scope, F.explode(rows).alias("row")).select(scope, "row.*").where("sessions > 0")


def quantity_rows(quantities: DataFrame) -> DataFrame:
    decision, state = F.col("decision"), F.col("state")
    selected = decision == "selected"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return quantities.where(decision != "excluded").groupBy("harness", "measure").agg(
        F.sum(F.when(selected & (state == "known"), F.col("amount")).cast("decimal(38,0)")).alias("known_sum"), n(selected & (state == "known")).alias("known"),
        n(selected & (state == "unknown")).alias("unknown"), n(selected & (state == "known") & F.col("lower_bound")).alias("lower"), n(decision == "unresolved").alias("unresolved"),
        n(selected & (state == "not_applicable")).alias("na"),
    )
