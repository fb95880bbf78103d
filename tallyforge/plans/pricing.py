"""Exact price estimates. Rates are decimals per million tokens; amounts stay in millionths, so nothing is divided."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import BUCKETS, prompt_size, unknown_prompt

RATE = "decimal(17,9)"
RATES_SCHEMA = f"provider string, model string, category string, threshold long, rate {RATE}"


def catalog(spark: SparkSession, data: str) -> DataFrame:
    """provider, model, category, threshold, rate of a JSON price table; threshold 0 is the base rate.

    A price table is a small document: it is parsed on the driver, with exact decimals.
    """
    from decimal import Decimal

    rows = []
    for provider, p in json.loads(data, parse_float=Decimal, parse_int=Decimal).items():
        for model, m in p["models"].items():
            cost = m.get("cost") or {}
            tiers = [(0, cost), *((int(t["tier"]["size"]), t) for t in cost.get("tiers", ()) if t["tier"]["type"] == "context")]
            if not cost.get("tiers") and "context_over_200k" in cost:
                tiers.append((200_000, cost["context_over_200k"]))
            rows += [(provider, model, c, size, Decimal(t[c])) for size, t in tiers for c in BUCKETS if c in t]
    return spark.createDataFrame(rows, RATES_SCHEMA)


def tiers(rates: DataFrame) -> DataFrame:
    return rates.where("threshold > 0").groupBy("provider", "model").agg(F.sort_array(F.collect_set("threshold")).alias("tiers"))


def context(observations: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds context_reason and context_threshold: the largest tier strictly below the prompt."""
    joined = observations.join(tiers(rates), ["provider", "model"], "left")
    reason = F.when(F.col("tiers").isNotNull(), F.when(F.col("time_kind") != "point", "aggregate_context").when(unknown_prompt(), "unknown_context_size"))
    below = F.array_max(F.filter("tiers", lambda b: prompt_size() > b))
    return joined.withColumn("context_reason", reason).withColumn("context_threshold", F.when(reason.isNull(), F.coalesce(below, F.lit(0))).otherwise(0).cast("long")).drop("tiers")


def priced(observations: DataFrame, rates: DataFrame) -> DataFrame:
    """Lines by model, category and tier: tokens, millionths of a dollar, or the reason why there is no price.

    Observations are grouped before rates are joined, and each keeps its own tier in the key.
    """
    base = context(observations, rates).where("decision != 'excluded'")
    category = F.explode(F.array(*(F.struct(F.lit(b).alias("category"), F.col(f"{b}_state").alias("state"), F.col(f"{b}_amount").alias("amount")) for b in BUCKETS)))
    lines = base.select("provider", "model", "decision", "context_reason", "context_threshold", category.alias("c")).select("provider", "model", "decision", "context_reason", "context_threshold", "c.*")
    lines = lines.where("NOT (decision = 'selected' AND (state = 'not_applicable' OR coalesce(amount, 1) = 0))")
    reason = F.when(F.col("decision") == "unresolved", "unresolved_tokens").when(F.col("state") == "unknown", "unknown_tokens").otherwise(F.col("context_reason"))
    keys = ["provider", "model", "category", "threshold"]
    sums = lines.groupBy("provider", "model", "category", F.col("context_threshold").alias("threshold"), reason.alias("reason")).agg(F.count("*").cast("long").alias("observations"), F.sum(F.col("amount").cast("decimal(20,0)")).cast("decimal(20,0)").alias("tokens"))
    found = sums.join(rates, keys, "left")
    why: Column = F.coalesce("reason", F.when(F.col("rate").isNull(), "missing_category_rate"))
    return found.select(*keys, why.alias("reason"), "observations", F.coalesce("tokens", F.lit(0)).cast("decimal(38,0)").alias("tokens"), F.when(why.isNull(), (F.col("tokens") * F.col("rate")).cast("decimal(38,9)")).alias("micro_usd"))
