"""Call logs: entries of a session with a message's usage, in files that are named by the session, or by an agent below it.

An output count is final only as of the writer's version; earlier writers left the count a stream began with. Everything is a
column expression over lines that are parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UUID, instant
from .lines import an_object, given, whole

#: Fixed value: the first release that writes final output counts.
FINAL_SINCE = (2, 1, 97)
_NUMBER, _NAME = "(?:0|[1-9][0-9]*)", "[0-9A-Za-z-]+"
_PRE = f"(?:{_NUMBER}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
STRICT = rf"^{_NUMBER}\.{_NUMBER}\.{_NUMBER}(-{_PRE}(\.{_PRE})*)?(\+{_NAME}(\.{_NAME})*)?$"
_RECORD = "type string, uuid string, parentUuid string, requestId string, sessionId string, timestamp string, cwd string, version string, message struct<id: string, model: string, usage: variant>"


def _text(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def identity(locator: Column) -> Column:
    """parent (a UUID), agent, main locator that a path names; null where it names none."""
    below = F.regexp_extract(locator, r"^(.*/)?([^/]+)/subagents/(?:[^/]+/)*agent-([^/\\]+)\.jsonl$", 2)
    agent = F.regexp_extract(locator, r"/subagents/(?:[^/]+/)*agent-([^/\\]+)\.jsonl$", 1)
    folder = F.regexp_extract(locator, r"^(.*/)?([^/]+)/subagents/(?:[^/]+/)*[^/]+$", 1)
    alone = F.regexp_extract(locator, r"([^/]+)\.jsonl$", 1)
    plain = ~locator.rlike(r"(^|/)subagents/")
    is_id = lambda c: F.lower(c).rlike(UUID)
    return (
        F.when(plain & is_id(alone), F.struct(F.lower(alone).alias("parent"), F.lit(None).cast("string").alias("agent"), F.lit(None).cast("string").alias("main")))
        .when(~plain & is_id(below) & (agent != ""), F.struct(F.lower(below).alias("parent"), agent.alias("agent"), F.concat(folder, F.lower(below), F.lit(".jsonl")).alias("main")))
    )


def release(version: Column) -> Column:
    """The three numbers and whether a pre-release follows, of a strict semantic version of at most 128 characters; else null.

    What follows the first plus is the build, what follows the first hyphen before it the pre-release; both are names between points.
    """
    before_plus = F.substring_index(version, "+", 1)
    core = F.substring_index(before_plus, "-", 1)
    numbers = F.split(core, r"\.")
    good = (F.length(version) <= 128) & version.rlike(STRICT) & ~version.contains("\n")
    return F.when(good, F.struct(*(numbers[i].try_cast("decimal(38,0)").alias(f"v{i + 1}") for i in range(3)), before_plus.contains("-").alias("early")))


def writer(version: Column) -> Column:
    """final, placeholder or unqualified, by a strict version."""
    return _finality(release(version))


def _finality(found: Column) -> Column:
    since = F.struct(*(F.lit(v).cast("decimal(38,0)").alias(f"v{i}") for i, v in enumerate(FINAL_SINCE, 1)), F.lit(False).alias("early"))
    numbers, least = (F.struct(*(x[f"v{i}"].alias(f"v{i}") for i in (1, 2, 3))) for x in (found, since))
    return F.when(found.isNull(), "unqualified").when((numbers > least) | ((numbers == least) & ~found["early"]), "final").otherwise("placeholder")


def writer_token(version: Column) -> Column:
    """What tells one writer's version from another; null for one that isn't strict."""
    return F.when(release(version).isNotNull(), _token(version))


def _token(version: Column) -> Column:
    return F.sha2(F.concat(F.lit("writer:"), version), 256)


def parsed(lines: DataFrame) -> DataFrame:
    """locator, line, the record ``r``, and who the file says it is, of files in which every entry that names a session names the file's."""
    rows = lines.where("status = 'ok'").select("locator", "line", F.from_json("record", _RECORD).alias("r"), identity(F.col("locator")).alias("own")).where("own IS NOT NULL")
    naming = _text(F.col("r.uuid")).isNotNull() | _text(F.col("r.requestId")).isNotNull() | F.col("r.message").isNotNull()
    agrees = F.lower("r.sessionId").eqNullSafe(F.col("own.parent"))
    good = rows.where(naming).groupBy("locator").agg(F.bool_and(agrees).alias("good")).where("good").select("locator")
    native = F.concat_ws(":agent:", "own.parent", "own.agent")
    return rows.join(good, "locator").select("locator", "line", "r", native.alias("session_id"), F.when(F.col("own.agent").isNotNull(), F.col("own.parent")).alias("parent_id"), F.col("own.main").alias("main_locator"))


def cwd_broken(cwd: Column) -> Column:
    """Whether a directory is given that is no absolute path."""
    return cwd.isNotNull() & ~F.coalesce(cwd.startswith("/"), F.lit(False))


def headers(rows: DataFrame) -> DataFrame:
    """locator, session_id, parent_id, started_us, last_us, cwd, cwd_state of the files in ``parsed`` rows: a directory holds if all that is said of it is valid and agrees."""
    at, cwd = instant(F.col("r.timestamp")), F.col("r.cwd")
    valid = F.coalesce(cwd.startswith("/"), F.lit(False))
    n, bad = F.countDistinct(F.when(valid, cwd)), F.count_if(cwd.isNotNull() & ~valid)
    out = rows.groupBy("locator", "session_id", "parent_id").agg(F.min(at).alias("started_us"), F.max(at).alias("last_us"), F.min(F.when(valid, cwd)).alias("cwd"), n.alias("n"), bad.alias("bad"))
    state = F.when((F.col("bad") > 0) | (F.col("n") > 1), "invalid").when(F.col("n") == 1, "valid").otherwise("absent")
    return out.select("locator", "session_id", "parent_id", "started_us", "last_us", F.when(state == "valid", F.col("cwd")).alias("cwd"), state.alias("cwd_state"))


def observations(rows: DataFrame) -> DataFrame:
    """One row per assistant entry with usage whose input counts and model can be read: ids, time, model, amounts with reasons, and how final the output is."""
    # Releases, and what follows from them, are worked out once a row.
    version = F.col("r.version")
    rows = rows.where((F.col("r.type") == "assistant") & F.col("r.message.usage").isNotNull()).select("*", release(version).alias("release")).select("*", _finality(F.col("release")).alias("writes"))
    usage = an_object(F.col("r.message.usage"))
    has, count = (lambda n: given(usage, n)), (lambda n: whole(usage, n))
    names = {"input": "input_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
    unread = F.greatest(*(has(n) & count(n).isNull() for n in (*names.values(), names["input"])))
    kind = F.col("writes")
    written = count("output_tokens")
    finality = F.when(~has("output_tokens"), F.when(kind == "final", "final_missing").otherwise("not_reported")).when(written.isNull(), "invalid").otherwise(kind)
    message, request = _text(F.col("r.message.id")), _text(F.col("r.requestId"))
    billed = rows.where(usage.isNotNull() & _text(F.col("r.uuid")).isNotNull() & ~unread & _text(F.col("r.message.model")).isNotNull())
    billed = billed.select("*", finality.alias("finality"), instant(F.col("r.timestamp")).alias("at_us"))
    finality, at = F.col("finality"), F.col("at_us")
    columns = {}
    for m, n in names.items():
        columns |= {f"{m}_amount": count(n), f"{m}_reason": F.when(~has(n), "not_reported")}
    columns["output_amount"] = F.when(finality == "final", written)
    columns["output_reason"] = F.when(finality.isin("final_missing", "not_reported"), "not_reported").when(finality == "invalid", "invalid_count").when(finality == "placeholder", "stream_start_placeholder").when(finality == "unqualified", "writer_version_unavailable")
    columns |= {f"{m}_state": F.when(columns[f"{m}_amount"].isNull(), "unknown").otherwise("known") for m in (*names, "output")}
    reason = F.when(message.isNull() & request.isNull(), "missing_identity").when(finality == "invalid", "invalid_count")
    token = F.when(F.col("release").isNotNull(), _token(version))
    return billed.select(
        "locator", "line", "session_id", F.col("r.uuid").alias("entry_id"), _text(F.col("r.parentUuid")).alias("parent_entry"), message.alias("message_id"), request.alias("request_id"), F.col("r.message.model").alias("model"),
        "at_us", F.when(at.isNull(), "undated").otherwise("point").alias("time_kind"), "finality", written.alias("written_output"), token.alias("writer_token"), reason.isNull().alias("usable"), reason.alias("reason"), *(c.alias(n) for n, c in columns.items()),
    )


def diagnostics(lines: DataFrame) -> DataFrame:
    """locator, line, code of what can't be used."""
    rows, usage = parsed(lines), an_object(F.col("r.message.usage"))
    unread = lambda n: given(usage, n) & whole(usage, n).isNull()
    billed = (F.col("r.type") == "assistant") & usage.isNotNull()
    codes = {
        "invalid_timestamp": F.col("r.timestamp").isNotNull() & instant(F.col("r.timestamp")).isNull(),
        "invalid_entry_identity": billed & _text(F.col("r.uuid")).isNull(),
        "invalid_count": billed & F.greatest(*(unread(n) for n in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))),
        "invalid_model": billed & _text(F.col("r.message.model")).isNull(),
        "writer_version_unavailable": billed & (writer(F.col("r.version")) == "unqualified"),
    }
    found = rows.select("locator", "line", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in codes.items())))).alias("code"))
    known = rows.select("locator").distinct()
    strange = lines.where("status = 'malformed' AND record IS NOT NULL").join(known, "locator").select("locator", "line", F.lit("invalid_record").alias("code"))
    where = F.min(F.when(cwd_broken(F.col("r.cwd")), F.col("line"))).alias("broken"), F.min_by("r.cwd", "line").alias("first")
    place = rows.where("r.cwd IS NOT NULL").groupBy("locator").agg(*where)
    other = rows.join(place.where("broken IS NULL"), "locator").where("r.cwd != first").groupBy("locator").agg(F.min("line").alias("other"))
    cwd = known.join(place, "locator", "left").join(other, "locator", "left").where("first IS NULL OR broken IS NOT NULL OR other IS NOT NULL")
    unplaced = cwd.select("locator", F.coalesce("broken", "other").alias("line"), F.lit("cwd_attribution_unavailable").alias("code"))
    refused = lines.select("locator").distinct().join(known, "locator", "left_anti").select("locator", F.lit(None).cast("long").alias("line"), F.lit("conflicting_session_identity").alias("code"))
    found = found.unionByName(strange).unionByName(unplaced)
    return found.unionByName(lines.where("status = 'malformed' AND record IS NULL").join(known, "locator").select("locator", "line", F.lit("malformed_json").alias("code"))).unionByName(refused)
