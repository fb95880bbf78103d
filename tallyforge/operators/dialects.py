"""Reconcilers of log dialects that identify usage by responses, by call components, or by alternate sources."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .graph import chain_roots, connected
from .lineage import decision, follow, lines, nearest


def response_decisions(rows: DataFrame) -> DataFrame:
    """row_id, state, reason of (row_id, response_id, session_id, value, at_us, usable).

    Rows of a response have to agree in session and value; the earliest (without a time last, then by id) counts.
    """
    per = rows.groupBy("response_id").agg(F.countDistinct("session_id").alias("owners"), F.countDistinct("value").alias("values"), F.min(F.struct(F.col("at_us").isNull().alias("late"), "at_us", "row_id"))["row_id"].alias("first"))
    reason = (
        F.when(~F.col("usable"), "usage_unresolved").when(F.col("owners") > 1, "response_owner_conflict").when(F.col("values") > 1, "response_conflict")
        .when(F.col("row_id") != F.col("first"), "response_duplicate").otherwise("response")
    )
    state = F.when(reason == "response", "selected").when(reason == "response_duplicate", "excluded").otherwise("unresolved")
    return rows.join(per, "response_id").select("row_id", state.alias("state"), reason.alias("reason"))


def call_components(rows: DataFrame) -> DataFrame:
    """row_id, component of (row_id, message_id, request_id): rows that share a message or a request are one call.

    Each id is tied to its smallest row, so a group of n rows is n edges.
    """
    edges = []
    for name in ("message_id", "request_id"):
        first = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("row_id").alias("b"))
        edges.append(rows.join(first, name).select(F.col("row_id").alias("a"), "b"))
    found = connected(edges[0].unionByName(edges[1]).distinct())
    return rows.select("row_id").join(found.withColumnRenamed("node", "row_id"), "row_id", "left")


def call_decisions(rows: DataFrame) -> DataFrame:
    """row_id, state, reason of (row_id, message_id, request_id, signature, final, output, at_us, superseded).

    Superseded rows only count where a component has no others. Final rows that differ in output, messages and requests that
    aren't one to one, or several signatures leave the component unresolved; else its first final row (or first row) counts.
    """
    placed = rows.join(call_components(rows), "row_id")
    w = Window.partitionBy("component")
    placed = placed.withColumn("active", ~F.col("superseded") | (F.min(F.col("superseded").cast("int")).over(w) == 1))
    live = placed.where("active AND component IS NOT NULL")
    per = live.groupBy("component").agg(
        F.countDistinct(F.when(F.col("final"), F.col("output"))).alias("outputs"), F.countDistinct("message_id").alias("messages"), F.countDistinct("request_id").alias("requests"),
        F.countDistinct("signature").alias("signatures"), F.min(F.struct((~F.col("final")).alias("open"), F.col("at_us").isNull().alias("late"), "at_us", "row_id"))["row_id"].alias("first"),
    )
    reason = (
        F.when(F.col("component").isNull(), "missing_identity").when(~F.col("active"), "superseded_projection").when(F.col("outputs") > 1, "output_conflict")
        .when((F.col("messages") > 1) | (F.col("requests") > 1) | (F.col("signatures") > 1), "identity_conflict").when(F.col("row_id") == F.col("first"), "call").otherwise("duplicate")
    )
    state = F.when(reason == "call", "selected").when(reason.isin("duplicate", "superseded_projection"), "excluded").otherwise("unresolved")
    return placed.join(per, "component", "left").select("row_id", state.alias("state"), reason.alias("reason"))


def _differ(column: str | Column) -> Column:
    """Whether a group holds several values, none being no value; unlike a distinct count it copies no rows."""
    return F.coalesce(F.min(column) != F.max(column), F.lit(False))


def call_log_decisions(rows: DataFrame) -> DataFrame:
    """row_id, state, reason, canonical of (row_id long, message_id, request_id, entry_id, signature, output, finality, writer_token, usable, reason, at_us, locator, line, current, superseded).

    A row that stands in several places has a row for each. What shares a message, a request or an entry is one call. Superseded places only count where a call has no others. A call's output is contested if
    final counts differ, one is missing or unreadable beside them, an entry is final in one place and not in another, or several writers wrote it, but for one that made final what another began; its identity is if messages,
    requests and entries aren't one to one, its inputs differ, or a place of it can't be used. Else its first final row counts (first by projection, time, file and line), and rows without
    ids only through their entry.
    """
    scratch = Scratch(rows.sparkSession, "calls")
    rows = scratch.table(rows)
    ties = []
    for name in ("message_id", "request_id", "entry_id"):
        first = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("row_id").alias("b"))
        ties.append(rows.join(first, name).select(F.col("row_id").alias("a"), "b"))
    found = connected(functools.reduce(DataFrame.unionByName, ties).unionByName(rows.select(F.col("row_id").alias("a"), F.col("row_id").alias("b"))).distinct())
    rows = rows.join(found.withColumnRenamed("node", "row_id"), "row_id")
    lone = rows.groupBy("component").agg(F.min("superseded").alias("all_superseded"))
    named = F.col("message_id").isNotNull() | F.col("request_id").isNotNull()
    rows = scratch.table(rows.join(lone, "component").withColumn("active", ~F.col("superseded") | F.col("all_superseded")).withColumn("named", named))

    # What isn't one to one, by the component of any row of it.
    pairs = (("message_id", ("request_id",)), ("request_id", ("message_id",)), ("entry_id", ("message_id", "request_id")))
    split = [rows.where(F.col(a).isNotNull()).groupBy(a).agg(functools.reduce(Column.__or__, map(_differ, bs)).alias("split"), F.min("component").alias("component")).where("split").select("component") for a, bs in pairs]
    split = functools.reduce(DataFrame.unionByName, split).distinct().withColumn("split", F.lit(True))
    active = rows.where("active")
    entries = active.groupBy("entry_id").agg(
        F.bool_or("named").alias("entry_named"), F.bool_or((F.col("finality") == "final") & F.col("current")).alias("has_final"), F.bool_or((F.col("finality") != "final") & F.col("current")).alias("has_other"),
    )
    active = active.join(entries, "entry_id", "left")
    nameless = ~F.col("named") & ~F.coalesce("entry_named", F.lit(False))
    active = scratch.table(active.withColumn("nameless", F.max(nameless.cast("int")).over(Window.partitionBy("row_id")) == 1))
    final, token = F.col("finality") == "final", F.col("writer_token")
    excused = ~F.col("named") & F.coalesce("entry_named", F.lit(False)) & F.coalesce(F.col("reason") == "missing_identity", F.lit(False))
    order = F.struct((~F.col("current")).alias("old"), F.col("at_us").isNull().alias("late"), F.coalesce("at_us", F.lit(0)).alias("at"), "locator", "line", F.coalesce("entry_id", F.lit("")).alias("entry"))
    per = active.groupBy("component").agg(
        F.coalesce(F.bool_or(final), F.lit(False)).alias("finals"), (_differ(F.when(final, F.col("output"))) | ((F.count(F.when(final, F.col("output"))) > 0) & (F.count_if(final & F.col("output").isNull()) > 0))).alias("final_outputs"), F.bool_or(F.col("finality").isin("final_missing", "invalid")).alias("lacks"), F.bool_or(F.col("finality") == "invalid").alias("broken"),
        F.bool_or(F.col("has_final") & F.col("has_other")).alias("mixed"), _differ(token).alias("writers"), ((F.count(F.when(final, token)) > 0) & ~_differ(F.when(final, token))).alias("final_writer"), _differ(F.when(F.col("finality") == "placeholder", token)).alias("first_writers"),
        F.bool_and((final & token.isNotNull()) | (F.col("finality") == "placeholder") | ((F.col("finality") == "unqualified") & token.isNull())).alias("plain"), F.bool_or(final & token.isNull()).alias("final_unsigned"), F.bool_or(final & token.isNotNull()).alias("final_signed"),
        _differ("signature").alias("signatures"), F.bool_or(~F.col("usable") & ~F.col("nameless") & ~excused).alias("unusable"),
    )
    refined = F.col("final_writer") & ~F.col("first_writers") & F.col("plain")
    output_conflict = F.col("final_outputs") | (F.col("finals") & F.col("lacks")) | F.col("broken") | F.col("mixed") | (F.col("writers") & ~refined) | (F.col("final_unsigned") & F.col("final_signed"))
    per = per.join(split, "component", "left").select("component", output_conflict.alias("output_conflict"), (F.coalesce("split", F.lit(False)) | F.col("signatures") | F.col("unusable")).alias("conflict"))
    best = rows.where("named AND NOT superseded").groupBy("component", "row_id").agg(F.min_by("finality", order).alias("finality"), F.min(order).alias("order"))
    canonical = best.groupBy("component").agg(F.min(F.struct((F.col("finality") != "final").alias("open"), "order", "row_id"))["row_id"].alias("canonical"))
    one = rows.groupBy("component", "row_id").agg(F.bool_or("active").alias("active")).join(active.groupBy("row_id").agg(F.bool_or("nameless").alias("nameless")), "row_id", "left")
    one = one.join(per, "component").join(canonical, "component", "left")
    say = lambda state, reason, copy=False: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"), (F.col("canonical") if copy else F.lit(None).cast("long")).alias("canonical"))
    said = (
        F.when(F.col("output_conflict"), say("unresolved", "output_conflict")).when(F.col("conflict"), say("unresolved", "identity_conflict")).when(F.col("canonical").isNull(), say("unresolved", "missing_identity"))
        .when(~F.col("active"), say("excluded", "superseded_projection", True)).when(F.col("nameless"), say("unresolved", "missing_identity")).when(F.col("row_id") == F.col("canonical"), say("selected", "call")).otherwise(say("excluded", "duplicate", True))
    )
    return one.select("row_id", said.alias("d")).select("row_id", "d.*")


def event_conflicts(rows: DataFrame) -> DataFrame:
    """row_id, reason of the rows (row_id, session_id, source_id, event_id, parent_event_id, fact) whose event can't be trusted.

    An event belongs to one session and has one parent there, and all files that hold it tell the same facts of it.
    """
    named = rows.where("event_id IS NOT NULL")
    owners = named.groupBy("event_id").agg(F.countDistinct("session_id").alias("n")).where("n > 1").select("event_id", F.lit(True).alias("crossing"))
    keys = ["session_id", "event_id"]
    parents = named.groupBy(*keys).agg(F.countDistinct(F.struct("parent_event_id")).alias("n")).where("n > 1").select(*keys, F.lit(True).alias("forked"))
    told = named.groupBy(*keys, "source_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.coalesce(F.col("fact").cast("string"), F.lit("~")))), "|"), 256).alias("signature"))
    differ = told.groupBy(*keys).agg(F.countDistinct("signature").alias("n")).where("n > 1").select(*keys, F.lit(True).alias("differing"))
    reason = F.when(F.col("crossing"), "cross_session_event").when(F.col("forked"), "parent_conflict").when(F.col("differing"), "event_conflict")
    return named.join(owners, "event_id", "left").join(parents, keys, "left").join(differ, keys, "left").select("row_id", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def _cyclic(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The groups of (group, a, b) whose edges go round. Where each node has one successor, pointers are doubled; other groups are peeled from their beginnings."""
    forked = scratch.table(edges.groupBy("group", "a").agg(F.count("*").alias("n")).where("n > 1").select("group").distinct())
    plain = edges.join(forked, "group", "left_anti")
    ends = plain.select("group", F.col("b").alias("a")).join(plain.select("group", "a"), ["group", "a"], "left_anti").distinct()
    nodes = plain.select(F.struct("group", "a").alias("node"), F.struct("group", F.col("b").alias("a")).alias("parent")).unionByName(ends.select(F.struct("group", "a").alias("node"), F.lit(None).cast("struct<group:string,a:string>").alias("parent")))
    rings = chain_roots(nodes).where("root IS NULL").select("node.group").distinct()
    left = scratch.table(edges.join(forked, "group", "left_semi"))
    while not left.isEmpty():
        later = left.select("group", F.col("b").alias("a")).distinct()
        kept = scratch.table(left.join(later, ["group", "a"], "left_semi"))
        if kept.count() == left.count():
            break
        left = kept
    return rings.unionByName(left.select("group").distinct())


def counter_decisions(rows: DataFrame) -> DataFrame:
    """row_id, state, reason, canonical of cumulative counters (row_id, session_id, name, source_id, line, event_id, compatibility, amount, usable, reason, allow_unknown), by session and name.

    A row that stands in several files has a row for each. Order is proved within a file only; files are joined by the events that they share, which have to be the same in all that is told of them (``compatibility``). One
    event is the last if all others come before it in some file or through shared ones, nothing goes round and no amount falls from one to the next; it counts and covers the others. Else all are unresolved, with the first reason that a row has.

    Rows are shuffled once by session and name, and written with what each leads to. Only groups in which some step leads back, to an event whose first line isn't a later one, are searched for rings.
    """
    scratch = Scratch(rows.sparkSession, "counters")
    event = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("row "), F.col("row_id").cast("string")))
    rows = rows.withColumn("event", event).withColumn("node", F.concat_ws(":", "event", F.coalesce("compatibility", F.lit("~"))))
    rows = rows.withColumn("group", F.concat_ws("\x1f", F.col("session_id").cast("string"), F.coalesce("name", F.lit("~")))).repartition("group")
    same, w = Window.partitionBy("group", "event"), Window.partitionBy("group", "source_id").orderBy("line")
    rows = rows.withColumn("place", F.min("line").over(same)).withColumn("varied", F.col("event_id").isNotNull() & (F.min("node").over(same) != F.max("node").over(same)))
    # Amounts that are null on the way are passed over: each is compared with the highest before it in its file.
    high = F.max("amount").over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.select("*", F.lead("node").over(w).alias("next"), F.lead("place").over(w).alias("next_place"), (F.col("amount") < high).alias("falls"))
    goes = F.col("next").isNotNull() & (F.col("next") != F.col("node"))
    # Where every step leads to an event whose first line is a later one, nothing goes round.
    steps = scratch.table(steps.select("row_id", "group", "source_id", "line", "node", "amount", "usable", "reason", "allow_unknown", "varied", "falls", F.when(goes, F.col("next")).alias("next"), (goes & (F.col("next_place") <= F.col("place"))).alias("back")))
    said_of = lambda name: F.coalesce(F.bool_or(name), F.lit(False)).alias(name)
    nodes = steps.groupBy("group", "node").agg(
        F.min("row_id").alias("first"), F.min_by("amount", "row_id").alias("amount"), F.min_by("allow_unknown", "row_id").alias("allow_unknown"), (F.count("next") == 0).alias("ends"), F.bool_and("usable").alias("usable"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct("source_id", "line", "row_id", "reason"))).alias("why"), *map(said_of, ("varied", "falls", "back")),
    )
    per = nodes.groupBy("group").agg(
        F.count_if("ends").alias("ends"), F.min(F.when(F.col("ends"), F.col("first"))).alias("canonical"), F.bool_and(F.when(F.col("ends"), F.col("amount").isNotNull() | F.col("allow_unknown"))).alias("sized"), F.bool_and("usable").alias("usable"),
        F.min("why")["reason"].alias("why"), *map(said_of, ("varied", "falls", "back")),
    )
    per = scratch.table(per)
    edges = steps.where("next IS NOT NULL").join(per.where("back").select("group"), "group", "left_semi").select("group", F.col("node").alias("a"), F.col("next").alias("b")).distinct()
    rings = _cyclic(scratch.table(edges), scratch).distinct().withColumn("ring", F.lit(True))
    per = per.join(rings, "group", "left")
    proved = F.col("usable") & (F.col("ends") == 1) & ~F.col("varied") & ~F.col("falls") & F.col("ring").isNull() & F.col("sized")
    per = per.select("group", "canonical", F.coalesce(proved, F.lit(False)).alias("proved"), "why")
    found = steps.select("row_id", "group").distinct().join(per, "group")
    say = lambda state, reason, copy: F.struct(F.lit(state).alias("state"), reason.alias("reason"), copy.alias("canonical"))
    none = F.lit(None).cast(rows.schema["row_id"].dataType)
    said = F.when(~F.col("proved"), say("unresolved", F.coalesce("why", F.lit("incomparable_history")), none)).when(F.col("row_id") == F.col("canonical"), say("selected", F.lit("cumulative_counter"), none)).otherwise(say("excluded", F.lit("covered_by_later_counter"), F.col("canonical")))
    return found.select("row_id", said.alias("d")).select("row_id", "d.*")


def alternate_decisions(rows: DataFrame) -> DataFrame:
    """row_id, state, reason of (row_id, session_id, source, is_log, logical_key, value).

    Sources of a session tell the same requests, or the session is unresolved; of sources that agree one is canonical: a
    log before others, then the smallest name.
    """
    fact = F.concat_ws("|", F.col("logical_key").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit("~")))
    sources = rows.groupBy("session_id", "source", "is_log").agg(F.sha2(F.array_join(F.sort_array(F.collect_set(fact)), ","), 256).alias("signature"))
    per = sources.groupBy("session_id").agg(F.countDistinct("signature").alias("signatures"), F.min(F.struct((~F.col("is_log")).alias("late"), "source"))["source"].alias("canonical"))
    reason = F.when(F.col("signatures") > 1, "alternate_conflict").when(F.col("source") == F.col("canonical"), "request").otherwise("alternate")
    state = F.when(reason == "request", "selected").when(reason == "alternate", "excluded").otherwise("unresolved")
    return rows.join(per, "session_id").select("row_id", state.alias("state"), reason.alias("reason"))


def removed_models(rows: DataFrame, group: str, order: str, model: str) -> DataFrame:
    """group, model of the models that a group's latest counters no longer name."""
    last = rows.groupBy(group).agg(F.max(order).alias(order))
    named = rows.join(last, [group, order], "left_semi").select(group, model).distinct()
    return rows.select(group, model).distinct().join(named, [group, model], "left_anti")


def rollout_decisions(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """row_id, state, reason, canonical of rollout usage (row_id, locator, line, session_id, source_kind, response_id, mirror_id, total_key, step_key, value, at_us, usable, reason).

    parents: session_id, parent_id of each file; one that is no session is missing, and a session with several is in conflict. A row that stands in several files has a row for each. A response counts once, if its rows
    agree in session and value. A step of a running total is a mirror of the response it repeats, a duplicate of an equal total of its session, or, at the start of all files that hold it, a replay
    of the nearest ancestor with this step. What copies another row has that one's fate: pointers to originals are doubled to their ends. All groups are joins and aggregates by key.

    The rows are written first, as they are read for each rule. Only sessions whose steps also stand in others look for ancestors.
    """
    scratch = Scratch(rows.sparkSession, "rollouts")
    places = scratch.table(rows)
    rows = places.dropDuplicates(["row_id"])
    modern, old = F.col("source_kind") == "response", F.col("source_kind") == "legacy"
    first = F.min(F.struct(F.col("at_us").isNull().alias("late"), "at_us", "row_id"))["row_id"]
    # A null value is a value like others.
    one_value, value_of = F.countDistinct(F.struct("value")), F.min("value")
    responses = rows.where(modern & F.col("response_id").isNotNull()).groupBy("response_id").agg(F.countDistinct("session_id").alias("owners"), one_value.alias("values"), value_of.alias("value_r"), first.alias("first_r"))
    mirrors = responses.select(F.col("response_id").alias("mirror_id"), F.col("values").alias("values_m"), F.col("value_r").alias("value_m"), F.col("first_r").alias("first_m"))
    keys = ["session_id", "total_key", "step_key"]
    twins = rows.where(modern & F.col("response_id").isNotNull() & F.col("total_key").isNotNull() & F.col("step_key").isNotNull()).groupBy(*keys).agg(F.countDistinct("response_id").alias("ids_t"), one_value.alias("values_t"), value_of.alias("value_t"), first.alias("first_t"))
    steps = rows.where(old & F.col("total_key").isNotNull())
    totals = steps.groupBy("session_id", "total_key").agg(one_value.alias("values_l"), first.alias("first_l"))

    tree, line = lines(parents, scratch)

    # A step without its own key matches another such one, though it counts nothing itself.
    key = F.struct("total_key", "step_key").alias("key")
    by_step = steps.groupBy("session_id", key).agg(one_value.alias("values_a"), value_of.alias("value_a"), first.alias("first_a"))
    above = nearest(by_step.select("session_id", "key", F.struct("values_a", "value_a", "first_a").alias("what")), tree, scratch)
    # A step is a replay while all before it in its file are: what comes after the first own one stands for itself.
    marked = places.where(old).withColumn("key", key).join(above, ["session_id", "key"], "left")
    w = Window.partitionBy("locator").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    prefix = marked.withColumn("inherited", F.min(F.col("near").isNotNull().cast("int")).over(w) == 1).groupBy("row_id").agg(F.min("inherited").alias("inherited"), F.any_value("near").alias("near"))

    all_of = (
        rows.join(responses, "response_id", "left").join(mirrors, "mirror_id", "left").join(twins, keys, "left").join(totals, ["session_id", "total_key"], "left")
        .join(prefix, "row_id", "left").join(line, "session_id", "left")
    )
    value, say = F.col("value"), functools.partial(decision, like=rows.schema["row_id"].dataType.simpleString())

    def copy_if(same: Column, reason: str, target: str, otherwise: str) -> Column:
        return F.when(same, say("excluded", reason, F.col(target))).otherwise(say("unresolved", otherwise))

    equal = lambda n, v: (F.col(n) == 1) & F.col(v).eqNullSafe(value)
    base = (
        F.when(F.col("disputed"), say("unresolved", "identity_conflict"))
        .when(F.col("mirror_id").isNotNull(), copy_if(equal("values_m", "value_m"), "modern_legacy_mirror", "first_m", "modern_legacy_overlap"))
        .when(old & F.col("ids_t").isNotNull(), copy_if((F.col("ids_t") == 1) & equal("values_t", "value_t"), "modern_legacy_mirror", "first_t", "modern_legacy_overlap"))
        .when(~F.col("usable"), say("unresolved", F.coalesce("reason", F.lit("usage_unresolved"))))
        .when(modern & (F.col("owners") > 1), say("unresolved", "response_owner_conflict")).when(modern & (F.col("values") > 1), say("unresolved", "response_conflict"))
        .when(modern & (F.col("first_r") != F.col("row_id")), say("excluded", "response_duplicate", F.col("first_r"))).when(modern, say("selected", "response"))
        .when(F.col("total_key").isNull() | F.col("step_key").isNull(), say("unresolved", "missing_cumulative")).when(F.col("values_l") > 1, say("unresolved", "cumulative_conflict"))
        .when(F.col("first_l") != F.col("row_id"), say("excluded", "legacy_duplicate", F.col("first_l")))
        .when(F.col("inherited"), copy_if(equal("near.values_a", "near.value_a"), "legacy_replay", "near.first_a", "replay_conflict"))
        .when(F.col("cycle"), say("unresolved", "lineage_cycle")).when(F.col("lost"), say("unresolved", "missing_ancestor")).otherwise(say("selected", "cumulative_advance"))
    )
    return follow(scratch.table(all_of.select("row_id", base.alias("b")).select("row_id", "b.*")))
