"""Terminal sessions: a chain of events with checkpoints and shutdowns, whose counters cover the whole session so far, by model and by agent.

Envelopes are columns of lines that are parsed once; whether their chain holds is said by ``operators.chains``. What a shutdown counts by model and agent are maps, whose entries become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UUID4, instant
from ..operators import chains
from .lines import an_object, given, whole
from .scratch import Scratch

#: Where sessions lie, who writes them, and the version of their start.
FOLDERS, PRODUCERS, VERSION = ("session-state",), ("copilot-cli", "github-copilot-cli"), 1
START, SHUTDOWN, CHECKPOINT, USAGE, MOVED = "session.start", "session.shutdown", "session.usage_checkpoint", "assistant.usage", "session.context_changed"
SPOKEN = ("user.message", "assistant.message", "assistant.reasoning", "tool.execution_start", "tool.execution_complete")
COUNTS = ("input", "output", "cacheRead", "cacheWrite")
_AMOUNT = "decimal(38,18)"
#: Lines that a task passes over, or whose bodies it reads.
LINES_A_TASK = 100_000


def session_of(locator: Column) -> Column:
    """The session that a path names, or null."""
    folders = "|".join(FOLDERS)
    found = F.regexp_extract(locator, rf"(?:^|/)(?:{folders})/([^/]+)/events\.jsonl$", 1)
    return F.when(F.lower(found).rlike(UUID4), found)


def _string(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _text(v: Column, path: str) -> Column:
    """A text of at most 256 characters that isn't blank."""
    text = _string(v, path)
    return F.when(text.rlike(r"\S") & (F.length(text) <= 256), text)


def _millis(v: Column, path: str) -> Column:
    """Milliseconds of a time that names its offset and has no finer part."""
    at = instant(_string(v, path))
    return F.when(at % 1000 == 0, F.floor(at / 1000).cast("long"))


def amount(v: Column, name: str) -> Column:
    """An exact number from 0 below 2**63, else null."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    number = F.try_variant_get(v, f"$.{name}", _AMOUNT)
    return F.when((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (number >= 0) & (number < F.lit(str(2**63)).cast(_AMOUNT)), number)


def _folder(v: Column, path: str) -> Column:
    text = _string(v, path)
    return F.when(text.startswith("/") & (F.length(text) <= 4096), text)


def _context(v: Column) -> tuple[Column, Column]:
    """Whether a context can be read, and the folder that it settles (a repository's before the directory; none while it is pending)."""
    pending = F.try_variant_get(v, "$.pendingGitContext", "variant")
    good = an_object(v).isNotNull() & _folder(v, "$.cwd").isNotNull() & (pending.isNull() | (F.schema_of_variant(pending) == "BOOLEAN")) & (~given(v, "gitRoot") | _folder(v, "$.gitRoot").isNotNull())
    good = F.coalesce(good, F.lit(False))
    settled = F.when(good & ~F.coalesce(F.try_variant_get(v, "$.pendingGitContext", "boolean"), F.lit(False)), F.coalesce(_folder(v, "$.gitRoot"), _folder(v, "$.cwd")))
    return good, settled


def envelopes(lines: DataFrame) -> DataFrame:
    """locator, line, kind, event_id, parent_id, at_ms, agent, named_agent (whether one is named), ephemeral, valid, is_start and the event's body ``v``, of lines that can be read."""
    v = F.col("v")
    rows = lines.where("status = 'ok'").select("locator", "line", F.try_parse_json("record").alias("v"))
    uuid = lambda path: F.when(F.lower(_string(v, path)).rlike(UUID4), _string(v, path))
    parent = F.try_variant_get(v, "$.parentId", "variant")
    quiet = ~given(v, "ephemeral") | F.coalesce(~F.try_variant_get(v, "$.ephemeral", "boolean"), F.lit(False)) & (F.schema_of_variant(F.try_variant_get(v, "$.ephemeral", "variant")) == "BOOLEAN")
    rows = rows.select(
        "locator", "line", _string(v, "$.type").alias("kind"), uuid("$.id").alias("event_id"), uuid("$.parentId").alias("parent_id"), F.coalesce(F.is_variant_null(parent), F.lit(False)).alias("no_parent"), _millis(v, "$.timestamp").alias("at_ms"),
        _text(v, "$.agentId").alias("agent"), given(v, "agentId").alias("named_agent"), F.coalesce(F.try_variant_get(v, "$.ephemeral", "boolean"), F.lit(False)).alias("ephemeral"), F.coalesce(quiet, F.lit(False)).alias("quiet"),
        an_object(F.try_variant_get(v, "$.data", "variant")).alias("v"),
    )
    is_start = F.coalesce(F.col("kind") == START, F.lit(False))
    whole_ = F.col("event_id").isNotNull() & F.col("at_ms").isNotNull() & F.col("v").isNotNull() & F.col("quiet")
    placed = F.when(is_start, F.col("no_parent") & ~F.col("named_agent")).otherwise(F.col("parent_id").isNotNull() & (~F.col("named_agent") | F.col("agent").isNotNull()))
    return rows.select("*", is_start.alias("is_start"), F.coalesce(whole_ & placed, F.lit(False)).alias("valid"))


def qualified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (locator, session_id, started_ms, epoch, code), and the events of good ones with chain (a code or null) and accepted, of ``envelopes``, which are read several times.

    Verdicts, starts and files are written once. Bodies meet what is said of their lines last, in parts whose number grows with the lines: they are small when packed, but not for those who read them.
    """
    scratch = Scratch(rows.sparkSession, "chains")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // LINES_A_TASK))
    verdicts = scratch.table(chains.qualify(rows, parts))
    # The verdict on a sound file has no line; one on a refused file is its only row.
    sound = verdicts.where("line IS NULL AND code IS NULL").select("locator")
    refused = verdicts.where("code = 'invalid_session_start'").select("locator", F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("long").alias("started_ms"), F.lit(None).cast("string").alias("epoch"), "code")
    v, expected = F.col("v"), session_of(F.col("locator"))
    started = _millis(v, "$.startTime")
    context_ok = ~given(v, "context") | _context(F.try_variant_get(v, "$.context", "variant"))[0]
    who = (_string(v, "$.sessionId") == expected) & (whole(v, "version") == VERSION) & _string(v, "$.producer").isin(*PRODUCERS) & _text(v, "$.copilotVersion").isNotNull() & started.isNotNull() & context_ok
    starts = scratch.table(rows.where("is_start").join(sound, "locator").select("locator", expected.alias("session_id"), started.alias("started_ms"), F.coalesce(who, F.lit(False)).alias("known")))
    # Few events lie before their session's start, if any. Verdicts are small when packed but large in memory, so they are never sent to all tasks.
    before = rows.select("locator", "line", "at_ms").join(starts.where("known").select("locator", "started_ms"), "locator").where("at_ms < started_ms").select("locator", "line")
    early = before.join(verdicts.hint("merge").where("accepted OR code = 'invalid_event_chain'").select("locator", "line"), ["locator", "line"]).select("locator").distinct().withColumn("early", F.lit(True))
    files = starts.join(early, "locator", "left")
    code = F.when(~F.col("known"), "conflicting_session_identity").when(F.col("early"), "invalid_session_lifetime")
    files = files.select("locator", F.when(code.isNull(), F.col("session_id")).alias("session_id"), F.when(code.isNull(), F.col("started_ms")).alias("started_ms"), F.when(code.isNull(), F.sha2(F.concat_ws("|", "session_id", F.lit(VERSION), "started_ms"), 256)).alias("epoch"), code.alias("code"))
    files = scratch.table(files.unionByName(refused))
    said = verdicts.where("line IS NOT NULL").select("locator", "line", F.col("code").alias("chain"), "accepted").join(files.where("code IS NULL").drop("code"), "locator")
    place = ["locator", "line"]
    return files, rows.repartition(parts, *place).join(said.repartition(parts, *place).hint("merge"), place)


def counters(events: DataFrame) -> DataFrame:
    """One row per checkpoint or shutdown, and per model and agent of a shutdown whose frame can be read: scope (session, model, agent) with what it counts so far.

    Columns: locator, session_id, epoch, line, event_id, at_ms, source (checkpoint, shutdown), scope, name; nano and premium (of sessions); input, output, cache_read, cache_write, reasoning, requests and cost (of models); input_reason says why an
    input can't be used though it was read (caches may be part of it); invalid: the fields that can't be read; models: the models that a shutdown names.
    """
    v = F.col("v")
    rows = events.where(F.col("accepted") & F.col("kind").isin(SHUTDOWN, CHECKPOINT) & ~F.col("named_agent"))
    closing = F.col("kind") == SHUTDOWN
    part = lambda x, name: an_object(F.try_variant_get(x, f"$.{name}", "variant"))
    rows = rows.select(
        "locator", "session_id", "epoch", "line", "event_id", "at_ms", "started_ms", "v", closing.alias("closing"),
        F.when(closing, part(v, "codeChanges")).alias("changes"), F.when(closing, part(v, "modelMetrics")).alias("metrics"), F.when(closing, part(v, "agentMetrics")).alias("agents"), _text(v, "$.shutdownType").alias("shutdown_type"),
    )
    closing, changes, metrics, agents = map(F.col, ("closing", "changes", "metrics", "agents"))
    files = F.try_variant_get(changes, "$.filesModified", "array<variant>")
    changed = changes.isNotNull() & F.coalesce(F.forall(files, lambda f: F.schema_of_variant(f) == "STRING"), F.lit(False)) & whole(changes, "linesAdded").isNotNull() & whole(changes, "linesRemoved").isNotNull()
    same_epoch = F.coalesce(whole(v, "sessionStartTime") == F.col("started_ms"), F.lit(False))
    framed = F.coalesce(F.col("shutdown_type").isin("routine", "error") & whole(v, "totalApiDurationMs").isNotNull() & metrics.isNotNull() & changed, F.lit(False))
    rows = rows.select("*", (closing & same_epoch).alias("same_epoch"), (closing & framed).alias("whole_frame"))
    same_epoch, framed = F.col("same_epoch"), F.col("whole_frame")
    bad = lambda name, condition: F.when(F.coalesce(condition, F.lit(False)), name)
    unread = lambda x, name: given(x, name) & amount(x, name).isNull()
    shapeless = lambda x, name: given(x, name) & part(x, name).isNull()
    faults = F.array_compact(F.array(
        bad("nano_aiu", unread(v, "totalNanoAiu") | (~closing & ~given(v, "totalNanoAiu"))), bad("premium_requests", unread(v, "totalPremiumRequests")), bad("epoch", closing & ~same_epoch), bad("shutdown", closing & ~framed),
        bad("agentMetrics", closing & given(v, "agentMetrics") & agents.isNull()), bad("tokenDetails", closing & shapeless(v, "tokenDetails")),
    ))
    as_map = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
    own = ["locator", "session_id", "epoch", "line", "event_id", "at_ms", "source", "shutdown_type", "framed"]
    base = rows.select(
        *own[:6], F.when(closing, "shutdown").otherwise("checkpoint").alias("source"), "shutdown_type", (framed & same_epoch).alias("framed"), amount(v, "totalNanoAiu").alias("total"), amount(v, "totalPremiumRequests").alias("premium"), faults.alias("faults"),
        F.when(framed & same_epoch, as_map(metrics)).alias("metrics"), F.when(framed & same_epoch, as_map(agents)).alias("agents"),
    )
    # A session's own counters, its models and its agents are rows of one pass over its events.
    a_name = lambda k: k.rlike(r"\S") & (F.length(k) <= 256)
    entry = lambda scope, name, m: F.struct(F.lit(scope).alias("scope"), name.alias("name"), m.alias("m"))
    no_entry = F.array().cast("array<struct<scope:string,name:string,m:variant>>")
    of = lambda scope, found: F.coalesce(F.transform(F.filter(F.map_entries(found), lambda e: a_name(e["key"])), lambda e: entry(scope, e["key"], e["value"])), no_entry)
    each = base.select(
        *own, "total", "premium", "faults", F.sort_array(F.filter(F.map_keys("metrics"), a_name)).alias("names"),
        F.inline(F.concat(F.array(entry("session", F.lit(None).cast("string"), F.lit(None).cast("variant"))), of("model", F.col("metrics")), of("agent", F.col("agents")))).alias("scope", "name", "m"),
    )
    m, session, model, agent = F.col("m"), F.col("scope") == "session", F.col("scope") == "model", F.col("scope") == "agent"
    each = each.where(~agent | an_object(m).isNotNull()).select("*", F.when(model, part(m, "usage")).alias("usage"), F.when(model, part(m, "requests")).alias("asked"))
    usage, asked = F.col("usage"), F.col("asked")
    counted = ("input", "output", "cache_read", "cache_write", "reasoning")
    each = each.select("*", *(whole(usage, f"{n}Tokens").alias(c) for c, n in zip(counted, (*COUNTS, "reasoning"), strict=True)), amount(m, "totalNanoAiu").alias("part_total"))
    thinks_more = F.col("reasoning") > F.col("output")
    wrong = F.array_sort(F.array_compact(F.array(
        *(bad(n, F.col(c).isNull()) for n, c in zip(COUNTS, counted[:4], strict=True)), bad("model_shape", usage.isNull() | asked.isNull()), bad("reasoning", (given(usage, "reasoningTokens") & F.col("reasoning").isNull()) | thinks_more),
        bad("request_count", given(asked, "count") & whole(asked, "count").isNull()), bad("request_cost", unread(asked, "cost")), bad("totalNanoAiu", given(m, "totalNanoAiu") & F.col("part_total").isNull()), bad("tokenDetails", shapeless(m, "tokenDetails")),
    )))
    caches = (F.col("cache_read") > 0) | (F.col("cache_write") > 0)
    why = F.when(F.col("input").isNull() | caches.isNull(), "invalid_counter").when(caches, "cache_inclusion_unknown")
    # An agent's breakdown adds nothing to the session's; it counts whole, or not at all.
    inner = as_map(part(m, "modelMetrics"))
    sound = lambda x: part(x, "requests").isNotNull() & F.least(*(whole(F.try_variant_get(x, "$.usage", "variant"), f"{n}Tokens").isNotNull() for n in COUNTS))
    agent_ok = whole(m, "totalApiDurationMs").isNotNull() & F.col("part_total").isNotNull() & inner.isNotNull() & F.forall(F.map_values(inner), sound)
    broken = F.array_compact(F.array(F.when(~F.coalesce(agent_ok, F.lit(False)), "agent_core")))
    return each.select(
        *own[:7], "scope", "name", F.when(session, F.col("total")).otherwise(F.col("part_total")).alias("nano"), F.when(session, F.col("premium")).alias("premium"),
        *counted[:4], F.when(~F.coalesce(thinks_more, F.lit(False)), F.col("reasoning")).alias("reasoning"), F.when(model, whole(asked, "count")).alias("requests"), F.when(model, amount(asked, "cost")).alias("cost"),
        F.when(model, why).when(agent, "non_additive_agent_breakdown").alias("input_reason"), F.when(session, F.col("faults")).when(model, wrong).otherwise(broken).alias("invalid"), F.when(session, F.col("names")).alias("models"), "shutdown_type", "framed",
    )


def lifetimes(lines: DataFrame, events: DataFrame, told: DataFrame) -> DataFrame:
    """locator, closed_line, complete: whether a file ends with a routine shutdown, after which nothing durable stands: no event, nothing that can't be read, and no pending tail. Last shutdowns are written, so counters are read once."""
    last = Scratch(told.sparkSession, "lifetimes").table(told.where("scope = 'session' AND framed").groupBy("locator").agg(F.max("line").alias("closed_line"), F.max_by("shutdown_type", "line").alias("shutdown_type")))
    after = events.join(last.select("locator", "closed_line"), "locator").where((F.col("line") > F.col("closed_line")) & (F.coalesce(F.col("kind") != USAGE, F.lit(True)) & ~F.col("ephemeral") | F.coalesce(F.col("chain").isNotNull(), F.lit(False)))).select("locator")
    torn = lines.where("status != 'ok'").join(last.select("locator", "closed_line"), "locator").where("line > closed_line OR status = 'pending'").select("locator")
    later = after.unionByName(torn).distinct().withColumn("later", F.lit(True))
    return events.select("locator").distinct().join(last, "locator", "left").join(later, "locator", "left").select("locator", "closed_line", (F.coalesce(F.col("shutdown_type") == "routine", F.lit(False)) & F.col("later").isNull()).alias("complete"))


def contexts(events: DataFrame) -> DataFrame:
    """locator, cwd, disputed: the folder that all settled contexts of a session agree on."""
    v = F.col("v")
    at_start, moved = _context(F.try_variant_get(v, "$.context", "variant"))[1], _context(v)[1]
    said = events.where("accepted").select("locator", F.when(F.col("is_start"), at_start).when(F.col("kind") == MOVED, moved).alias("cwd"))
    n = F.countDistinct("cwd")
    return said.groupBy("locator").agg(F.when(n == 1, F.min("cwd")).alias("cwd"), (n > 1).alias("disputed"))


def agents(events: DataFrame) -> DataFrame:
    """session_id, agent: who else spoke in a session; each is a session below it."""
    return events.where(F.col("accepted") & F.col("kind").isin(*SPOKEN) & F.col("agent").isNotNull() & (F.col("agent") != "main")).select("session_id", "agent").distinct()
