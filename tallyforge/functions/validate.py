"""The ledger's constraints as a table of violations: what isn't empty isn't committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import BUCKETS


def violations(observations: DataFrame) -> DataFrame:
    """observation_id, rule: one row for each broken rule."""
    checks = {}
    for b in BUCKETS:
        state, amount = F.col(f"{b}_state"), F.col(f"{b}_amount")
        checks[f"{b}: a known amount and no other"] = (state == "known") != amount.isNotNull()
        checks[f"{b}: no negative amount"] = amount < 0
        checks[f"{b}: a state of three"] = ~state.isin("known", "unknown", "not_applicable")
    kind, at, start = F.col("time_kind"), F.col("at_us"), F.col("start_us")
    checks["time: undated has none"] = (kind == "undated") & (at.isNotNull() | start.isNotNull())
    checks["time: points and intervals have one"] = (kind != "undated") & at.isNull()
    checks["time: only intervals start"] = (kind != "interval") & start.isNotNull()
    checks["time: a start lies before"] = start >= at
    checks["decision: of three"] = ~F.col("decision").isin("selected", "excluded", "unresolved")
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())))
    return observations.select("observation_id", F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").cast("long").alias("rows")).where("rows > 1")
