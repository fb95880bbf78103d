"""Editor chats: documents of a session's requests, written flat or as logs of edits; what their models, turns and controls recorded.

A request tells its usage in up to three ways: totals by model, a summary of the turn, and a control that counts credits of the whole session so far. Each is a row
of its own. Documents come from ``operators.edits``; everything here is column expressions over their items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import edits
from .lines import given, whole

#: The participant whose requests count, and the document's version.
PARTICIPANT, VERSION = "github.copilot-chat", 3
PROVIDER = "github-copilot"
_AMOUNT = "decimal(38,18)"


def scope(locator: Column) -> Column:
    """A digest of the installation's folder, so that copies of a workspace are one and installations differ; null where the path isn't that of a chat."""
    root = F.regexp_extract(locator, r"^(/.*|)/workspaceStorage/[^/]+/chatSessions/[^/]+\.jsonl?$", 1)
    return F.when(locator.rlike(r"^(/.*|)/workspaceStorage/[^/]+/chatSessions/[^/]+\.jsonl?$"), F.sha2(F.concat(F.lit("chat-scope:"), root), 256))


def _text(value: Column, path: str) -> Column:
    """A text that isn't blank."""
    text = F.try_variant_get(value, path, "string")
    return F.when((F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING") & text.rlike(r"\S"), text)


def _instant(value: Column, path: str) -> Column:
    """Microseconds of a count of milliseconds, up to the year 9999."""
    ms = whole(value, path)
    return F.when(ms < 253_402_300_800_000, ms * 1000)


def credit(value: Column, name: str) -> Column:
    """An amount of credits: a number from 0 below 2**63, exact; else null."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    amount = F.try_variant_get(value, f"$.{name}", _AMOUNT)
    return F.when((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (amount >= 0) & (amount < F.lit(str(2**63)).cast(_AMOUNT)), amount)


def file_path(uri: Column) -> Column:
    """The absolute path of a local file's address, or null."""
    rest = F.regexp_extract(uri, r"^[Ff][Ii][Ll][Ee]:(?://(?:localhost)?)?(/[^?#]*)$", 1)
    # The decoder takes plus signs for spaces, which addresses don't.
    path = F.try_url_decode(F.regexp_replace(rest, r"\+", "%2B"))
    broken = uri.rlike(r"[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})") | path.rlike(r"^//|^/[A-Za-z]:|[\x00-\x1f\x7f]|\x{FFFD}")
    return F.when((rest != "") & ~broken, path)


def documents(lines: DataFrame) -> DataFrame:
    """The rows of ``edits.replay``, with the head as ``h`` and items as ``r``."""
    rows = edits.replay(lines, "requests")
    return rows.select("locator", "code", "last_line", "pending", "ordinal", "lines", F.try_parse_json("head").alias("h"), F.try_parse_json("item").alias("r"))


def headers(rows: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """locator, session_id, started_us, title, cwd, code of each document; code says why it is refused. workspaces: locator, record of the file beside it."""
    h = F.col("h")
    head = rows.where("ordinal IS NULL").select("locator", "code", "last_line", "pending", "h", scope(F.col("locator")).alias("scope"))
    shaped = (whole(h, "version") == VERSION) & _text(h, "$.sessionId").isNotNull() & F.schema_of_variant(F.try_variant_get(h, "$.requests", "variant")).startswith("ARRAY")
    code = F.when(F.col("scope").isNull(), "missing_scope").otherwise(F.coalesce("code", F.when(~F.coalesce(shaped, F.lit(False)), "invalid_chat_state")))
    cwd = file_path(_text(h, "$.workingDirectory"))
    if workspaces is not None:
        beside = workspaces.groupBy("locator").agg(F.min("record").alias("record")).select("locator", file_path(_text(F.try_parse_json("record"), "$.folder")).alias("beside"))
        head, cwd = head.join(beside, "locator", "left"), F.coalesce(cwd, F.col("beside"))
    title = F.regexp_replace(F.trim(F.regexp_replace(_text(h, "$.customTitle"), r"\s+", " ")), r"(?s)^(.{160}).*$", "$1")
    ok = code.isNull()
    return head.select(
        "locator", F.when(ok, F.concat_ws(":", "scope", _text(h, "$.sessionId"))).alias("session_id"), F.when(ok, _instant(h, "creationDate")).alias("started_us"),
        F.when(ok, F.nullif(title, F.lit(""))).alias("title"), F.when(ok, cwd).alias("cwd"), "last_line", "pending", code.alias("code"),
    )


def _line(*paths: str) -> Column:
    """The latest line of the values at these paths; the request's own where there are none."""
    return F.greatest(F.lit(1).cast("long"), *(F.coalesce(F.element_at("lines", p), F.lit(0)) for p in paths))


def _bits(*present: Column) -> Column:
    return F.concat(*(F.when(p, "1").otherwise("0") for p in present))


def evidence(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per recorded way of telling usage, of the requests that count in documents that aren't refused.

    Columns: locator, session_id, ordinal, line, request_id, response_id, selected_model, kind (model_totals, turn_summary, unavailable, session_control), model, at_us; raw_input, raw_output, raw_cache_read and
    presence (which of input, output, cache read were given); input, output and cache_read as amount and reason; credits with credit_state and credit_reason; lower_bound, retained_input and retained_output; reason (null: usable).
    Equal rows of a file are one, its first.
    """
    r = F.col("r")
    at = lambda path: F.try_variant_get(r, path, "variant")
    good = heads.where("code IS NULL").select("locator", "session_id", "started_us")
    asked = rows.where("ordinal IS NOT NULL").join(good, "locator").where(F.lower(_text(r, "$.agent.extensionId.value")) == PARTICIPANT)
    has, unread = (lambda n: given(r, n)), (lambda n, read: given(r, n) & read(r, n).isNull())
    core = has("modelTotals") | has("promptTokens") | has("completionTokens")
    models_given = F.coalesce(~F.is_variant_null(at("$.modelTotals")), F.lit(False))
    models = F.coalesce(F.try_variant_get(r, "$.modelTotals", "array<variant>"), F.array().cast("array<variant>"))
    names = F.filter(F.transform(models, lambda m: _text(m, "$.model")), lambda n: n.isNotNull())
    bad_model = lambda m: ~F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)) | _text(m, "$.model").isNull() | F.greatest(*(given(m, n) & whole(m, n).isNull() for n in ("inputTokens", "cachedTokens", "outputTokens")))
    asked = asked.withColumns({
        "request_id": _text(r, "$.requestId"), "response_id": _text(r, "$.responseId"), "selected_model": _text(r, "$.modelId"), "models": models, "doubled": F.size(names) > F.size(F.array_distinct(names)), "names": names,
        "own_us": F.coalesce(_instant(r, "responseTimestamp"), _instant(r, "timestamp"), "started_us"),
        "broken": unread("promptTokens", whole) | unread("completionTokens", whole) | unread("copilotCredits", credit) | unread("sessionCopilotCredits", credit)
        | (models_given & ~F.schema_of_variant(at("$.modelTotals")).startswith("ARRAY")) | F.exists(models, bad_model),
    }).withColumn("unnamed", F.when(has("responseId") & F.col("response_id").isNull(), "invalid_response_identity").when(F.col("request_id").isNull(), "missing_request_identity"))

    null_long, null_text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def row(kind: Column, suffix: Column, line: Column, model: Column, provider: Column, raws: tuple, presence: Column, amounts: dict, credits: tuple, reason: Column, lower: Column = F.lit(False), kept: tuple = (null_long, null_long)) -> Column:
        named = zip(("raw_input", "raw_output", "raw_cache_read"), raws, strict=True)
        told = [c.alias(f"{m}_{part}") for m, pair in amounts.items() for part, c in zip(("amount", "reason"), pair, strict=True)]
        return F.struct(
            kind.alias("kind"), suffix.alias("suffix"), line.cast("long").alias("line"), model.alias("model"), provider.alias("provider"), *(c.alias(n) for n, c in named), presence.alias("presence"), *told,
            credits[0].cast(_AMOUNT).alias("credits"), credits[1].alias("credit_state"), credits[2].alias("credit_reason"), reason.alias("reason"), lower.alias("lower_bound"), kept[0].alias("retained_input"), kept[1].alias("retained_output"),
        )

    none = (F.lit(None).cast(_AMOUNT), null_text, null_text)
    unknown = lambda why: (null_long, F.lit(why))

    def read(value: Column, name: str, invalid: str) -> tuple[Column, Column]:
        amount = whole(value, name)
        return amount, F.when(amount.isNull(), F.when(given(value, name), invalid).otherwise("not_reported"))

    def of_model(m: Column, i: Column) -> Column:
        name, place = _text(m, "$.model"), F.concat(F.lit("$.modelTotals["), i.cast("string"), F.lit("]"))
        line = F.greatest(F.coalesce(F.element_at("lines", place), F.lit(1)), *(F.coalesce(F.element_at("lines", F.concat(place, F.lit(f".{n}"))), F.lit(0)) for n in ("model", "inputTokens", "cachedTokens", "outputTokens")), _line("$.requestId", "$.responseId"))
        reason = F.when(bad_model(m), "invalid_numeric_value").when(F.size(F.filter("names", lambda n: n == name)) > 1, "duplicate_actual_model").otherwise(F.col("unnamed"))
        cache, output = read(m, "cachedTokens", "invalid_numeric_value"), read(m, "outputTokens", "invalid_numeric_value")
        raws = (whole(m, "inputTokens"), whole(m, "outputTokens"), whole(m, "cachedTokens"))
        amounts = {"input": unknown("cache_inclusion_unknown"), "output": output, "cache_read": cache}
        return row(F.lit("model_totals"), F.concat(F.lit("model:"), F.coalesce(name, i.cast("string"))), line, name, F.lit(PROVIDER), raws, _bits(given(m, "inputTokens"), given(m, "outputTokens"), given(m, "cachedTokens")), amounts, none, reason)

    # Without core counts a turn may keep those of its last successful call.
    meta, kept = at("$.result.metadata"), at("$.result.usage")
    meta_in, meta_out, kept_in, kept_out = whole(meta, "promptTokens"), whole(meta, "outputTokens"), whole(kept, "promptTokens"), whole(kept, "completionTokens")
    legacy = ~core & kept.isNotNull()
    both_meta, both_kept = meta_in.isNotNull() & meta_out.isNotNull(), kept_in.isNotNull() & kept_out.isNotNull()
    differ = legacy & both_kept & both_meta & ((meta_in != kept_in) | (meta_out != kept_out))
    retained_reason = F.when(legacy & ~F.coalesce(both_kept, F.lit(False)), "invalid_retained_usage").when(F.coalesce(differ, F.lit(False)), "conflicting_retained_usage")
    last_in, last_out = F.when(legacy, kept_in).otherwise(meta_in), F.when(legacy, kept_out).otherwise(meta_out)
    last_call = F.coalesce(~core & last_in.isNotNull() & last_out.isNotNull(), F.lit(False))
    some_models = F.size("models") > 0
    turn = has("promptTokens") | has("completionTokens") | has("copilotCredits") | some_models | last_call
    fields = lambda parent, *names_: [f"$.result.{parent}.{n}" for n in names_]
    identity, metadata = ["$.requestId", "$.responseId"], fields("metadata", "promptTokens", "outputTokens")
    line = (
        F.when(F.coalesce(differ, F.lit(False)), _line("$", "$.promptTokens", "$.completionTokens", "$.copilotCredits", *identity, *fields("usage", "promptTokens", "completionTokens"), *metadata))
        .when(legacy, _line("$", "$.promptTokens", "$.completionTokens", "$.copilotCredits", *identity, *fields("usage", "promptTokens", "completionTokens")))
        .when(last_call, _line("$", "$.promptTokens", "$.completionTokens", "$.copilotCredits", *identity, *metadata)).otherwise(_line("$", "$.promptTokens", "$.completionTokens", "$.copilotCredits"))
    )
    prompt, completion = read(r, "promptTokens", "invalid_count"), read(r, "completionTokens", "invalid_count")
    covered = unknown("covered_by_model_totals")
    choose = lambda other, last: tuple(F.when(some_models, c).when(last_call, x).otherwise(o) for c, x, o in zip(covered, last, other, strict=True))
    amounts = {"input": choose(prompt, unknown("cache_inclusion_unknown")), "output": choose(completion, (last_out, null_text)), "cache_read": choose(unknown("not_reported"), unknown("not_reported"))}
    spent, control = credit(r, "copilotCredits"), credit(r, "sessionCopilotCredits")
    stated = lambda amount, name: (amount, F.when(amount.isNull(), "unknown").otherwise("known"), F.when(amount.isNull(), F.when(has(name), "invalid_numeric_value").otherwise("not_reported")))
    raws = (F.when(last_call, last_in).otherwise(prompt[0]), F.when(last_call, last_out).otherwise(completion[0]), null_long)
    why = F.coalesce(retained_reason, F.when(F.col("broken"), "invalid_numeric_value").when(F.col("doubled"), "duplicate_actual_model").otherwise(F.col("unnamed")))
    summary = row(
        F.when(turn, "turn_summary").otherwise("unavailable"), F.when(turn, "summary").otherwise("unavailable"), line, null_text, F.when(~last_call & retained_reason.isNull(), PROVIDER), raws, _bits(has("promptTokens") | last_call, has("completionTokens") | last_call, F.lit(False)),
        amounts, stated(spent, "copilotCredits"), why, last_call, (F.when(differ, meta_in), F.when(differ, meta_out)),
    )
    controlled = row(
        F.lit("session_control"), F.lit("session-control"), _line("$.sessionCopilotCredits"), null_text, F.lit(PROVIDER), (null_long,) * 3, F.lit("000"), {m: unknown("not_applicable") for m in ("input", "output", "cache_read")},
        stated(control, "sessionCopilotCredits"), F.when(control.isNull(), "invalid_numeric_value").otherwise(F.col("unnamed")),
    )
    ways = F.array_compact(F.concat(F.transform("models", of_model), F.array(summary, F.when(has("sessionCopilotCredits"), controlled))))
    told = asked.select("locator", "session_id", "ordinal", "request_id", "response_id", "selected_model", F.col("own_us").alias("at_us"), F.explode(ways).alias("w")).select("*", "w.*").drop("w")
    same = [c for c in told.columns if c not in ("ordinal", "line", "selected_model")]
    # A request without an id is itself, wherever it stands.
    told = told.withColumn("own", F.when(F.col("request_id").isNull(), F.col("ordinal")))
    once = told.groupBy(*same, "own").agg(F.min(F.struct("ordinal", "line", "selected_model")).alias("first"))
    entry = F.sha2(F.to_json(F.struct(F.coalesce("request_id", F.concat_ws("#", "locator", "own")).alias("request"), F.col("request_id").isNull().alias("missing"), "response_id", "suffix"), {"ignoreNullFields": "false"}), 256)
    return once.select("locator", "session_id", "first.*", entry.alias("entry_id"), *(c for c in same if c not in ("locator", "session_id")))


def diagnostics(rows: DataFrame, heads: DataFrame, told: DataFrame) -> DataFrame:
    """locator, line, code of documents that are refused, requests that are none, and summaries that say less than they should."""
    refused = heads.where("code IS NOT NULL").select("locator", F.lit(None).cast("long").alias("line"), "code")
    good = heads.where("code IS NULL").select("locator")
    broken = rows.where("ordinal IS NOT NULL").join(good, "locator").where(~F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False))).select("locator", _line("$").alias("line"), F.lit("invalid_request").alias("code"))
    lossy = (F.col("kind") == "turn_summary") & ~F.col("lower_bound") & ~F.coalesce(F.col("input_reason") == "covered_by_model_totals", F.lit(False))
    codes = F.array_compact(F.array(F.when(F.col("reason").isin("invalid_retained_usage", "conflicting_retained_usage"), F.col("reason")), F.when(lossy, F.lit("lossy_turn_summary"))))
    return refused.unionByName(broken).unionByName(told.select("locator", "line", F.explode(codes).alias("code")))
