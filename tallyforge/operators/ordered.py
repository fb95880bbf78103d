"""Operators on the order of rows: carried state, counters, islands, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Each column's last known value up to and with the row, as current_<column>."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *(F.last(c, ignorenulls=True).over(w).alias(f"current_{c}") for c in columns))


def cumulative_advance(rows: DataFrame, key: str, order: list[str], total: str, last: str) -> DataFrame:
    """How a cumulative counter moves: ``advance`` and ``reason`` (baseline, repeat, regression, mismatch, advance)."""
    before = F.lag(total).over(Window.partitionBy(key).orderBy(*order))
    step = F.col(total) - before
    reason = F.when(before.isNull(), "missing_baseline").when(step == 0, "repeat").when(step < 0, "regression").when(step != F.col(last), "mismatch").otherwise("advance")
    return rows.select("*", F.when(reason == "advance", step).alias("advance"), reason.alias("reason"))


def unbroken_prefix(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """``inherited``: whether the flag held for this row and all before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("inherited", F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == 1)


def first_seen(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_of(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key; a null clears what stood before, and its key goes."""
    return rows.groupBy(key).agg(F.max_by(F.struct(value), F.struct(*order))[value].alias(value)).where(F.col(value).isNotNull())


def latest_generation(rows: DataFrame, locator: str = "locator", generation: str = "generation") -> DataFrame:
    """Rows of each locator's latest generation: one aggregate and a join, no sort of all versions."""
    last = rows.groupBy(locator).agg(F.max(generation).alias(generation))
    return rows.join(last, [locator, generation], "left_semi")


def prefer_available(rows: DataFrame, session: str, available: str = "available") -> DataFrame:
    """Without rows that aren't available, in sessions that have one that is."""
    any_available = F.max(F.col(available).cast("int")).over(Window.partitionBy(session)) == 1
    return rows.withColumn("__any", any_available).where(F.col(available) | ~F.col("__any")).drop("__any")


def changes(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """The column where it differs from the row before, else null; nulls compare as values."""
    before = F.lag(column).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumn("shown", F.when(first | ~F.col(column).eqNullSafe(before), F.col(column)))


def islands(rows: DataFrame, key: str, order: list[str], kind: Column) -> DataFrame:
    """key, island, kind, first, last, members: stretches of equal kind."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__kind", kind).withColumn("__new", F.coalesce((F.col("__kind") != F.lag("__kind").over(w)).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return numbered.groupBy(key, "island").agg(F.first("__kind").alias("kind"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").cast("long").alias("members"))
