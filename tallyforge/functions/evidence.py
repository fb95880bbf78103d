"""Column expressions over tagged measures: known, unknown and not applicable never turn into zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"
BUCKETS = ("input", "output", "cache_read", "cache_write")
LIMIT = 2**63


def metric_sum(measure: str) -> list[Column]:
    """Four counters of a measure: the known sum (exact, beyond 64 bits), unknown, not applicable, lower bounds."""
    state, amount, decision = F.col(f"{measure}_state"), F.col(f"{measure}_amount"), F.col("decision")
    selected = decision == "selected"
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return [
        F.coalesce(F.sum(F.when(selected & (state == "known"), amount).cast(EXACT)), F.lit(0)).cast(EXACT).alias(f"{measure}_known"),
        one((decision == "unresolved") | (selected & (state == "unknown"))).alias(f"{measure}_unknown"),
        one(selected & (state == "not_applicable")).alias(f"{measure}_na"),
        (one(selected & (state == "known") & F.col("lower_bound")) if measure == "output" else F.lit(0).cast("long")).alias(f"{measure}_lower"),
    ]


def all_sums(*measures: str) -> list[Column]:
    return [c for m in measures or BUCKETS for c in metric_sum(m)]


def merge_sums(*measures: str) -> list[Column]:
    """The counters of coarser groups from those of finer ones."""
    names = [f"{m}_{k}" for m in measures or BUCKETS for k in ("known", "unknown", "na", "lower")]
    return [F.sum(n).cast(EXACT if n.endswith("_known") else "long").alias(n) for n in names]


def normalized_total(reasons: bool = False) -> Column:
    """The recorded total where it agrees with the parts, else the parts' sum where all are known, else null.

    With ``reasons`` (columns that say why an amount is unknown) a count that couldn't be read makes the total unknown, be it a part's or the recorded one.
    """
    known = [F.col(f"{b}_state") == "known" for b in BUCKETS]
    absent = [F.col(f"{b}_state") != "unknown" for b in BUCKETS]
    parts = sum(F.coalesce(F.col(f"{b}_amount"), F.lit(0)).cast(EXACT) for b in BUCKETS)
    everything, none_unknown = known[0] & known[1] & known[2] & known[3], absent[0] & absent[1] & absent[2] & absent[3]
    reported = F.col("reported_amount").cast(EXACT)
    agrees = (reported >= parts) & (~everything | (reported == parts))
    bad = lambda *names: F.coalesce(F.greatest(F.lit(False), *(F.col(f"{n}_reason") == "invalid_count" for n in names)), F.lit(False)) if reasons else F.lit(False)
    return (
        F.when(bad(*BUCKETS) | (parts >= F.lit(str(LIMIT)).cast(EXACT)), None).when(F.col("reported_state") == "known", F.when(agrees, reported))
        .when(bad("reported"), None).when(everything & none_unknown, parts).cast(EXACT)
    )


def prompt_size() -> Column:
    return sum(F.coalesce(F.col(f"{b}_amount"), F.lit(0)) for b in ("input", "cache_read", "cache_write"))


def unknown_prompt() -> Column:
    return F.exists(F.array(*(F.col(f"{b}_state") for b in ("input", "cache_read", "cache_write"))), lambda s: s == "unknown")


def in_scope(start_us: int, end_us: int) -> Column:
    """Whether an observation can lie in [start, end): points in it, intervals that overlap it or have no start, undated ones."""
    kind, at, start = F.col("time_kind"), F.col("at_us"), F.col("start_us")
    return (kind == "undated") | ((kind == "point") & (at >= start_us) & (at < end_us)) | ((kind == "interval") & (at > start_us) & (start.isNull() | (start < end_us)))


def included(start_us: int, end_us: int) -> Column:
    """Whether it surely lies in it: an interval without a known start never does."""
    kind, at, start = F.col("time_kind"), F.col("at_us"), F.col("start_us")
    return F.coalesce(((kind == "point") & (at >= start_us) & (at < end_us)) | ((kind == "interval") & (start >= start_us) & (at <= end_us)), F.lit(False))
