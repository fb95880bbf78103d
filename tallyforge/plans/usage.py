"""From decided measures to the report: who is eligible, whose it is, what it costs.

Measures and decisions are rows, one for each observation and measure, as reconcilers give them. They are turned into columns by one aggregate with conditions, meet their
observation by its id or carry what it is, and are grouped by all that the report and the price list tell apart. Everything after that is sums of few groups: rates are joined to groups, never to observations.

Where rows are dealt by session, what belongs to a session stays in its task until its groups are dealt by owner, narrow; every view by owner stays there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import BUCKETS, EXACT, LIMIT, prompt_size
from .report import bucket_of

#: What is summed, and what else a value may be of.
MEASURES = (*BUCKETS, "total")
VALUES = (*BUCKETS, "reported", "cache_write_1h")
TOKENS = "decimal(20,0)"
#: What a state and a decision can be, in the order in which the greater one stands.
STATES, DECISIONS = ("known", "not_applicable", "unknown"), ("excluded", "selected", "unresolved")


#: Four bits for each value (its state, and whether its count couldn't be read), then for each measure (its decision).
SAID = 4 * len(VALUES)
ONES = int("1" * len(MEASURES), 16)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _place(column: str, names: tuple[str, ...]) -> Column:
    """The place of a name, from 0, null without one; another name is an error, as a null would pass for an absent value."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int")
    return F.when(place > 0, place - 1).when(F.col(column).isNotNull(), F.raise_error(F.concat(F.lit(f"{column} can't be "), F.col(column))).cast("int"))


def _has(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask).cast("long")) != 0


def _greatest(flags: Column) -> Column:
    """Of the states and decisions of each four bits the greatest alone; a value without one is unknown, a measure without one excluded."""
    every = int("1" * (len(VALUES) + len(MEASURES)), 16)
    of = lambda mask: F.lit(mask).cast("long")
    absent = F.bitwise_not(flags.bitwiseOR(F.shiftright(flags, 1)).bitwiseOR(F.shiftright(flags, 2))).bitwiseAND(of(every))
    lesser = F.shiftright(flags, 1).bitwiseAND(of(3 * every)).bitwiseOR(F.shiftright(flags, 2).bitwiseAND(of(every)))
    unknown = F.shiftleft(absent.bitwiseAND(of((1 << SAID) - 1)), 2)
    return flags.bitwiseAND(F.bitwise_not(lesser)).bitwiseOR(unknown).bitwiseOR(absent.bitwiseAND(of(ONES << SAID)))


def _named(bits: Column, start: int, names: tuple[str, ...]) -> Column:
    return F.when(_has(bits, 4 << start), names[2]).when(_has(bits, 2 << start), names[1]).otherwise(names[0])


def pivoted(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, the state, amount and reason of each value, and the decision on each measure (excluded where there is none), of (keys, measure, state, amount, reason, decision).

    States, decisions and whether a count couldn't be read are bits of one number (``bits``), so that tasks put the rows of an observation together in a small hash table; texts would have to be sorted for
    that, and a column for each would fill memory and be spilled. Of reasons only ``invalid_count`` decides anything, and only it is kept. Rows that are dealt by some of the keys stay where they are.
    """
    of = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("measure")).cast("int") - 1
    zero = F.lit(0).cast("long")
    held = rows.select(*keys, "measure", F.col("amount").cast("long").alias("amount"), (F.col("reason") == "invalid_count").alias("invalid"), _place("state", STATES).alias("state"), _place("decision", DECISIONS).alias("decision"), of(VALUES).alias("known"), of(MEASURES).alias("decided"))
    state = F.when(F.col("known") >= 0, F.coalesce(_bit(F.col("known") * 4 + F.col("state")), zero).bitwiseOR(F.when(F.col("invalid"), _bit(F.col("known") * 4 + 3)).otherwise(0))).otherwise(0)
    said = F.when((F.col("decided") >= 0) & F.col("decision").isNotNull(), _bit(F.col("decided") * 4 + SAID + F.col("decision"))).otherwise(0)
    held = held.select(*keys, "measure", "amount", state.bitwiseOR(said).alias("bits"))
    coded = held.groupBy(*keys).agg(F.coalesce(F.bit_or("bits"), zero).alias("bits"), *(F.max(F.when(F.col("measure") == m, F.col("amount"))).alias(f"{m}_amount") for m in VALUES))
    bits, columns = F.col("bits"), ["bits"]
    for i, m in enumerate(VALUES):
        columns += [_named(bits, 4 * i, STATES).alias(f"{m}_state"), F.col(f"{m}_amount"), F.when(_has(bits, 8 << 4 * i), "invalid_count").alias(f"{m}_reason")]
    return coded.withColumn("bits", _greatest(bits)).select(*keys, *columns, *(_named(bits, SAID + 4 * i, DECISIONS).alias(f"{m}_decision") for i, m in enumerate(MEASURES)))


def pivot(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """``pivoted`` by observation_id, of (observation_id, measure, state, amount, reason) and (observation_id, measure, state), which are dealt by observation once, together."""
    absent = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = values.select("observation_id", "measure", "state", F.col("amount").cast("long").alias("amount"), "reason", absent("string", "decision"))
    return pivoted(rows.unionByName(decisions.select("observation_id", "measure", absent("string", "state"), absent("long", "amount"), absent("string", "reason"), F.col("state").alias("decision"))), "observation_id")


def any_decision(state: str, quantities: Column | None = None) -> Column:
    """Whether some measure of a pivoted row is decided so, or some quantity is."""
    found = _has(F.col("bits"), ONES << SAID + DECISIONS.index(state))
    return found if quantities is None else found | F.coalesce(F.array_contains(quantities, state), F.lit(False))


def total(bits: Column) -> Column:
    """``normalized_total`` with reasons, of the bits of a pivoted row."""
    known, reported = int("1" * len(BUCKETS), 16), VALUES.index("reported")
    parts = sum(F.coalesce(F.col(f"{b}_amount"), F.lit(0)).cast(EXACT) for b in BUCKETS)
    everything = bits.bitwiseAND(known) == known
    recorded = F.col("reported_amount").cast(EXACT)
    return (
        F.when(_has(bits, 8 * known) | (parts >= F.lit(str(LIMIT)).cast(EXACT)), None).when(_has(bits, 1 << 4 * reported), F.when((recorded >= parts) & (~everything | (recorded == parts)), recorded))
        .when(_has(bits, 8 << 4 * reported), None).when(everything, parts).cast("long")
    )


def placed(sessions: DataFrame, owners: DataFrame) -> DataFrame:
    """session_id, owner_id, harness, and the owner's project_id, of sessions and (session_id, owner_id); a session without an owner is its own."""
    rows = sessions.select("session_id", "harness").join(owners, "session_id", "left").withColumn("owner_id", F.coalesce("owner_id", "session_id"))
    rows = rows.join(sessions.select(F.col("session_id").alias("owner_id"), "project_id"), "owner_id", "left")
    return rows.select("session_id", "owner_id", "harness", "project_id")


def eligible(rows: DataFrame, quantities: Column | None = None) -> DataFrame:
    """Of pivoted rows those with a measure or quantity that isn't excluded, and whether anything of them is selected."""
    return rows.where(any_decision("selected", quantities) | any_decision("unresolved", quantities)).withColumn("selected", any_decision("selected", quantities))


def undisputed(rows: DataFrame) -> DataFrame:
    """Rows whose model is disputed have none."""
    return rows.withColumns({c: F.when(~F.coalesce("disputed", F.lit(False)), F.col(c)) for c in ("provider", "model")}).drop("disputed")


def population(observations: DataFrame, wide: DataFrame, sessions: DataFrame, owners: DataFrame, quantity_decisions: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """The report's rows: observations with a measure or quantity that isn't excluded, with their owner, the owner's project, and whether anything of them is selected.

    owners: session_id, owner_id; a session without one is its own. quantity_decisions: observation_id, state. conflicts: observation_id of those whose model is disputed, which have none then.
    """
    quantities = None
    rows = observations.join(wide, "observation_id", "left" if quantity_decisions is not None else "inner")
    if quantity_decisions is not None:
        states = quantity_decisions.groupBy("observation_id").agg(F.collect_set("state").alias("quantity_states"))
        rows, quantities = rows.join(states, "observation_id", "left"), F.col("quantity_states")
        rows = rows.withColumn("bits", F.coalesce("bits", _greatest(F.lit(0).cast("long"))))
        rows = rows.withColumns({f"{m}_decision": F.coalesce(f"{m}_decision", F.lit("excluded")) for m in MEASURES} | {f"{m}_state": F.coalesce(f"{m}_state", F.lit("unknown")) for m in VALUES})
    rows = eligible(rows, quantities)
    if conflicts is not None:
        rows = undisputed(rows.join(conflicts.select("observation_id").distinct().withColumn("disputed", F.lit(True)), "observation_id", "left"))
    return rows.drop("quantity_states").join(placed(sessions, owners), "session_id")


def profiles(rates: DataFrame) -> DataFrame:
    """price_provider, price_model, tiers (thresholds above 0, null without), steady (categories with one rate in all tiers), and by threshold the rates of all categories, of (provider, model, category, threshold, rate).

    One row per model of a price list; how many there are is the list's size.
    """
    names = ["provider", "model"]
    by_tier = rates.groupBy(*names, "threshold").agg(*(F.max(F.when(F.col("category") == b, F.col("rate"))).alias(b) for b in BUCKETS))
    same = lambda b: (F.countDistinct(F.col(b)) == 1) & (F.count(F.col(b)) == F.count("*"))
    return by_tier.groupBy(*names).agg(
        F.sort_array(F.collect_set(F.when(F.col("threshold") > 0, F.col("threshold")))).alias("tiers"), F.array_compact(F.array(*(F.when(same(b), F.lit(b)) for b in BUCKETS))).alias("steady"),
        F.map_from_entries(F.collect_list(F.struct("threshold", F.struct(*BUCKETS)))).alias("rates"),
    ).withColumnsRenamed({"provider": "price_provider", "model": "price_model"})


def groups(base: DataFrame, rates: DataFrame, aliases: dict[str, str] | None = None, zone: str = "UTC", parts: int | None = None) -> DataFrame:
    """The population by all that totals and prices tell apart, with sums of every measure.

    Besides owner, project, harness, provider, model and bucket these are: why the size of a prompt isn't known, the largest tier below it, whether a long cache was written, whether a price is open because a
    count is (``open``), and which categories have tokens to be priced (``priced``, a bit for each). Rows are dealt by owner in as many parts as are asked for, so that a task's groups fit its memory.
    """
    name_of = F.col("provider")
    for known, listed in (aliases or {}).items():
        name_of = F.when(F.col("provider") == known, listed).otherwise(name_of)
    tiers = profiles(rates).where("size(tiers) > 0").select("price_provider", "price_model", "tiers")
    rows = base.withColumn("price_provider", name_of)
    rows = rows.join(tiers, (rows["price_provider"] == tiers["price_provider"]) & (rows["model"] == tiers["price_model"]), "left").drop(tiers["price_provider"]).drop("price_model")
    sized, point, bits, value = F.col("tiers").isNotNull(), F.col("time_kind") == "point", F.col("bits"), {v: 4 * i for i, v in enumerate(VALUES)}
    unsized = _has(bits, sum(4 << value[v] for v in ("input", "cache_read", "cache_write")))
    threshold = F.when(sized & point & ~unsized, F.array_max(F.filter("tiers", lambda b: prompt_size() > b)))
    ones, of = (lambda c: c.bitwiseAND(F.lit(ONES).cast("long"))), value["reported"]
    # The total's state stands where the recorded one was, so that values and decisions of all measures lie alike.
    rows = rows.withColumn("total_amount", total(bits)).withColumn("bits", bits.bitwiseAND(F.lit(~(15 << of)).cast("long")).bitwiseOR(F.when(F.col("total_amount").isNull(), 4 << of).otherwise(1 << of)))
    selected, unresolved = ones(F.shiftright(bits, SAID + 1)), ones(F.shiftright(bits, SAID + 2))
    rows = rows.withColumns({
        "chosen": selected.bitwiseAND(bits), "undecided": unresolved.bitwiseOR(selected.bitwiseAND(F.shiftright(bits, 2))), "na": selected.bitwiseAND(F.shiftright(bits, 1)),
    })
    # What a row says is bits of one number while rows are dealt: of each measure whether its amount isn't known and whether it isn't applicable, and these.
    facts = {
        "long_cache": _has(bits, 1 << value["cache_write_1h"]) & (F.col("cache_write_1h_amount") > 0), "selected": F.col("selected"), "aggregate": sized & ~point, "unsized": sized & point & unsized,
        "lower": _has(F.col("chosen"), 1 << value["output"]) & F.col("lower_bound"),
    }
    at = {name: 4 * len(MEASURES) + i for i, name in enumerate(facts)}
    said = F.col("undecided").bitwiseOR(F.shiftleft("na", 1))
    for name, c in facts.items():
        said = said.bitwiseOR(F.when(c, 1 << at[name]).otherwise(0))
    is_ = lambda place: _has(F.col("said"), 1 << place)
    amounts = [F.when(_has(F.col("chosen"), 1 << 4 * i), F.col(f"{m}_amount")).alias(f"{m}_amount") for i, m in enumerate(MEASURES)]
    # Nearly every row is a group of its own, so they are dealt as they are, once: all that is grouped by owner from here on stays where its owner is.
    rows = rows.select("owner_id", "project_id", "harness", "provider", "model", bucket_of(zone).alias("bucket_us"), threshold.alias("context_threshold"), said.alias("said"), *amounts)
    rows = rows.repartition("owner_id") if parts is None else rows.repartition(parts, "owner_id")
    rows = rows.withColumns({
        "price_provider": name_of, "context_reason": F.when(is_(at["aggregate"]), "aggregate_context").when(is_(at["unsized"]), "unknown_context_size"), "long_cache": is_(at["long_cache"]),
        "open": _has(F.col("said"), int("1" * len(BUCKETS), 16)), "priced": sum(F.when(F.col(f"{b}_amount") > 0, 1 << i).otherwise(0) for i, b in enumerate(BUCKETS)),
    })
    keys = ["owner_id", "project_id", "harness", "provider", "price_provider", "model", "bucket_us", "context_reason", "context_threshold", "long_cache", "open", "priced"]
    one = lambda place: F.count_if(is_(place)).cast("long")
    # Exact beyond 64 bits: halves are summed apart, which is much faster than decimals.
    exact = lambda c: (F.coalesce(F.sum(F.shiftright(c, 32)), F.lit(0)).cast(TOKENS) * F.lit(1 << 32).cast("decimal(10,0)") + F.coalesce(F.sum(F.col(c).bitwiseAND(F.lit((1 << 32) - 1))), F.lit(0)).cast(TOKENS)).cast(EXACT)
    sums = []
    for i, m in enumerate(MEASURES):
        sums += [
            exact(f"{m}_amount").alias(f"{m}_known"), one(4 * i).alias(f"{m}_unknown"), one(4 * i + 1).alias(f"{m}_na"),
            (one(at["lower"]) if m == "output" else F.lit(0).cast("long")).alias(f"{m}_lower"),
        ]
    return rows.groupBy(*keys).agg(F.count("*").cast("long").alias("observations"), F.bool_or(is_(at["selected"])).alias("selected"), *sums)


def costs(grouped: DataFrame, rates: DataFrame) -> DataFrame:
    """The groups with micro_usd (the sum of what can be priced), lines (how many categories are), and unpriced (observations with something that can't)."""
    profile = profiles(rates)
    rows = grouped.join(profile, grouped["price_provider"].eqNullSafe(profile["price_provider"]) & (grouped["model"] == profile["price_model"]), "left").drop(profile["price_provider"]).drop("price_model")
    at = F.coalesce("context_threshold", F.lit(0).cast("long"))
    amounts, lines, closed = F.lit(0).cast("decimal(38,9)"), F.lit(0), F.col("open")
    for i, b in enumerate(BUCKETS):
        wanted = F.col("priced").bitwiseAND(1 << i) != 0
        rate = F.element_at("rates", at)[b]
        blocked = F.col("rates").isNull() | rate.isNull() | (F.col("context_reason").isNotNull() & ~F.array_contains("steady", b))
        if b == "cache_write":
            blocked = blocked | F.col("long_cache")
        blocked = F.coalesce(blocked, F.lit(True))
        amounts = amounts + F.when(wanted & ~blocked, F.col(f"{b}_known").cast(TOKENS) * rate).otherwise(0).cast("decimal(38,9)")
        lines = lines + F.when(wanted & ~blocked, 1).otherwise(0)
        closed = closed | (wanted & blocked)
    return rows.select(*grouped.columns, amounts.cast("decimal(38,9)").alias("micro_usd"), lines.alias("lines"), F.when(closed, F.col("observations")).otherwise(0).cast("long").alias("unpriced"))


def summed(priced: DataFrame, *keys: str) -> DataFrame:
    """Any coarser view of the groups: observations, owners with something selected, sums of measures and costs.

    Groups are dealt by owner, so they are first summed by owner where they are, and then an owner is counted by a flag instead of a distinct count.
    """
    names = [f"{m}_{k}" for m in MEASURES for k in ("known", "unknown", "na", "lower")]
    sums = [F.sum("observations").cast("long").alias("observations"), *(F.sum(n).cast(EXACT if n.endswith("_known") else "long").alias(n) for n in names)]
    costs = [F.sum("micro_usd").cast("decimal(38,9)").alias("micro_usd"), F.sum("lines").cast("long").alias("lines"), F.sum("unpriced").cast("long").alias("unpriced")]
    found = priced.groupBy(*dict.fromkeys((*keys, "owner_id"))).agg(sums[0], F.max(F.when(F.col("selected"), 1).otherwise(0)).cast("long").alias("owners"), *sums[1:], *costs)
    return found if "owner_id" in keys else found.groupBy(*keys).agg(sums[0], F.sum("owners").cast("long").alias("owners"), *sums[1:], *costs)


def cost_order(descending: bool = True) -> list[Column]:
    """Owners by cost: those of which something is known first, equal ones by start and id (columns of ``summed`` by owner, and started_us)."""
    known = (F.col("unpriced") == 0) | (F.col("lines") > 0)
    amount = F.col("micro_usd").desc() if descending else F.col("micro_usd").asc()
    return [(~known).asc(), amount, F.col("started_us").asc_nulls_last(), F.col("owner_id").asc()]
