"""Which files are logs, of which dialect, what lies beside them, and whether a changed file only grew.

Spark lists and reads the files, from any store that it can read; what a file is, is said by column expressions over its first line (or all of a small document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_log, event_log
from .lines import an_object, given, whole

#: Bytes of a first line, and of a file beside a log, that are looked at.
PROBE = 1 << 20
FILES = "path string, modificationTime timestamp, length long, content binary"
#: Entries that a call log may begin with.
CALL_ENTRIES = ("assistant", "user", "system", "summary", "progress")
#: Files beside logs, and the folder (from the log's own, upwards) that they lie in.
BESIDE = {"workspace.json": ("chatSessions", 1), "workspace.yaml": ("session-state", 0)}


def listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """FILES and root (the place in ``roots`` of the first one that a file lies under) of all logs and what lies beside them; a file under several roots is one."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl,yaml}").load(roots)
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*:/*", "/"), r"/+$", "")
    under = [F.when(F.startswith(bare(F.col("path")), F.concat(bare(F.lit(r)), F.lit("/"))), F.lit(i)) for i, r in enumerate(roots)]
    return found.withColumn("root", F.coalesce(*under)).dropDuplicates(["path"])


def _first_line(content: Column) -> Column:
    """The first line if it ends within PROBE bytes, as text; null if it is longer or no UTF-8."""
    head = F.substring(content, 1, PROBE + 1)
    text = F.decode(head, "ISO-8859-1")  # bytes as letters, to find the line's end
    size = F.when(F.instr(text, "\n") > 0, F.instr(text, "\n") - 1).otherwise(F.length(head))
    return F.when(size <= PROBE, F.try_validate_utf8(F.substring(content, F.lit(1), size).cast("string")))


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))


def _is_number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def _counted(m: Column) -> Column:
    """Whether a model's metrics have the shape of such."""
    asked, usage = an_object(F.try_variant_get(m, "$.requests", "variant")), an_object(F.try_variant_get(m, "$.usage", "variant"))
    optional = [~given(v, n) | _is_number(v, f"$.{n}") for v, n in ((asked, "count"), (asked, "cost"), (usage, "reasoningTokens"))]
    return F.least(asked.isNotNull(), usage.isNotNull(), *optional, *(_is_number(usage, f"$.{n}Tokens") for n in event_log.COUNTS))


def dialect(path: Column, content: Column) -> Column:
    """tree, rollout, call, chat, event, event_metadata, or null.

    A chat whose first line or document is too long to look at is known by its path; its reader says what it is.
    """
    is_lines = path.endswith(".jsonl")
    text = _first_line(content)
    v = F.try_parse_json(F.when(is_lines | ~F.coalesce(F.instr(F.decode(F.substring(content, 1, PROBE + 1), "ISO-8859-1"), "\n") > 0, F.lit(False)), text).otherwise(F.when(F.octet_length(content) <= PROBE, F.try_validate_utf8(content.cast("string")))))
    first = F.try_parse_json(text)
    kind = F.try_variant_get(first, "$.type", "string")
    is_kind = lambda *names: F.coalesce(kind.isin(*names), F.lit(False)) & _is_text(first, "$.type")
    folder = F.element_at(F.split(path, "/"), -2)
    state = F.when(whole(v, "kind") == 0, F.try_variant_get(v, "$.v", "variant")).otherwise(v)
    chat_state = (whole(state, "version") == chat_log.VERSION) & _is_text(state, "$.sessionId") & (F.try_variant_get(state, "$.sessionId", "string") != "")
    data = an_object(F.try_variant_get(v, "$.data", "variant"))
    begins = is_kind(event_log.START)
    parent = F.try_variant_get(v, "$.parentId", "variant")
    linked = F.when(begins, parent.isNull() | F.is_variant_null(parent) | _is_text(v, "$.parentId")).otherwise(_is_text(v, "$.parentId") & (F.try_variant_get(v, "$.parentId", "string") != "") & ~given(v, "agentId"))
    quiet = ~given(v, "ephemeral") | (F.schema_of_variant(F.try_variant_get(v, "$.ephemeral", "variant")) == "BOOLEAN") & (begins | ~F.coalesce(F.try_variant_get(v, "$.ephemeral", "boolean"), F.lit(True)))
    envelope = data.isNotNull() & _is_text(v, "$.id") & (F.try_variant_get(v, "$.id", "string") != "") & linked & quiet & event_log.instant(F.try_variant_get(v, "$.timestamp", "string")).isNotNull()
    opening = _is_text(data, "$.sessionId") & _is_number(data, "$.version") & F.coalesce(F.try_variant_get(data, "$.producer", "string").isin(*event_log.PRODUCERS), F.lit(False)) & _is_text(data, "$.copilotVersion") & _is_text(data, "$.startTime")
    checkpoint = _is_number(data, "$.totalNanoAiu") & (~given(data, "totalPremiumRequests") | _is_number(data, "$.totalPremiumRequests"))
    metrics = F.from_json(F.to_json(an_object(F.try_variant_get(data, "$.modelMetrics", "variant"))), "map<string,variant>")
    changes = F.try_variant_get(data, "$.codeChanges", "variant")
    files = F.try_variant_get(changes, "$.filesModified", "array<variant>")
    closing = (
        _is_number(data, "$.sessionStartTime") & F.try_variant_get(data, "$.shutdownType", "string").isin("routine", "error") & _is_number(data, "$.totalApiDurationMs") & F.coalesce(F.forall(F.map_values(metrics), _counted), F.lit(False))
        & F.forall(files, lambda f: F.schema_of_variant(f) == "STRING") & _is_number(changes, "$.linesAdded") & _is_number(changes, "$.linesRemoved")
    )
    own_events = event_log.session_of(path).isNotNull() | path.rlike(r"(^|/)session-state/[^/]+/events\.jsonl$")
    rules = [
        ("event_metadata", path.rlike(r"(^|/)session-state/[^/]+/workspace\.yaml$") & event_log.session_of(F.regexp_replace(path, r"workspace\.yaml$", "events.jsonl")).isNotNull()),
        (None, path.endswith(".yaml")),
        ("tree", is_kind("session") & (whole(first, "version") == 3) & _is_text(first, "$.id")),
        ("rollout", is_kind("session_meta") & _is_text(first, "$.payload.id")),
        ("call", is_kind(*CALL_ENTRIES) & _is_text(first, "$.sessionId")),
        ("chat", (folder == "chatSessions") & chat_state),
        ("chat", v.isNull() & (F.octet_length(content) > PROBE) & F.when(is_lines, text.isNull()).otherwise(True) & chat_log.scope(path).isNotNull()),
        ("event", own_events & envelope & ((begins & opening) | (is_kind(event_log.CHECKPOINT) & checkpoint) | (is_kind(event_log.SHUTDOWN) & closing))),
    ]
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(F.coalesce(rule, F.lit(False)), F.lit(name))
    return out


def sources(files: DataFrame) -> DataFrame:
    """The logs among (path, content, and root if known) with dialect, what lies beside them (name and content), and a fingerprint over both.

    What lies beside a log is only taken from under a root, too, and only up to PROBE bytes: a longer one is told in ``problem``. A chat has it in the folder above its own. Metadata of a session that has events is no source of its own.
    """
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    up = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    beside = named.where(F.col("name").isin(*BESIDE)).select(F.col("folder").alias("at"), F.col("name").alias("beside"), F.when(F.octet_length("content") <= PROBE, F.col("content")).alias("beside_content"), (F.octet_length("content") > PROBE).alias("too_long"))
    logs = named.withColumn("dialect", dialect(F.col("path"), F.col("content"))).where("dialect IS NOT NULL")
    at = F.when(F.col("dialect") == "chat", up(F.col("folder"))).when(F.col("dialect") == "event", F.col("folder"))
    wanted = F.when(F.col("dialect") == "chat", "workspace.json").when(F.col("dialect") == "event", "workspace.yaml")
    joined = logs.withColumns({"at": at, "beside": wanted}).join(beside, ["at", "beside"], "left")
    with_events = joined.where("dialect = 'event'").select("folder").distinct()
    joined = joined.where("dialect != 'event_metadata'").unionByName(joined.where("dialect = 'event_metadata'").join(with_events, "folder", "left_anti").select(joined.columns))
    context = F.when(F.col("beside_content").isNotNull(), F.concat_ws(":", "beside", F.sha2("beside_content", 256)))
    return joined.select(
        *files.columns, "dialect", F.when(F.col("beside_content").isNotNull(), F.col("beside")).alias("beside"), "beside_content", F.when(F.col("too_long"), "sidecar_too_large").alias("problem"),
        F.sha2(F.concat_ws("|", F.sha2("content", 256), context).cast("binary"), 256).alias("fingerprint"),
    )


def complete(content: Column) -> Column:
    """How many bytes of a log are whole lines."""
    text = F.decode(content, "ISO-8859-1")
    return (F.octet_length(content) - F.coalesce(F.nullif(F.instr(F.reverse(text), "\n"), F.lit(0)) - 1, F.octet_length(content))).cast("long")


def prefixes(files: DataFrame) -> DataFrame:
    """locator, complete_bytes, prefix: what is kept of a generation, so that the next one can be told from it without its contents."""
    n = complete(F.col("content"))
    return files.select(F.col("path").alias("locator"), n.alias("complete_bytes"), F.sha2(F.substring(F.col("content"), F.lit(1), n.cast("int")), 256).alias("prefix"))


def grown(files: DataFrame, kept: DataFrame) -> DataFrame:
    """locator, extends of (path, content) against ``prefixes`` of the generation before: true if its whole lines still begin the file, false if it was replaced, null if there was none."""
    now = files.select(F.col("path").alias("locator"), "content").join(kept, "locator", "left")
    same = (F.octet_length("content") >= F.col("complete_bytes")) & (F.sha2(F.substring(F.col("content"), F.lit(1), F.col("complete_bytes").cast("int")), 256) == F.col("prefix"))
    return now.select("locator", same.alias("extends"))
