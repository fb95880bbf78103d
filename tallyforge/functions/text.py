"""Scalar functions on identifiers, titles, times and decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
DECIMAL = r"^(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def excerpt(text: Column, limit: int = 160) -> Column:
    """White space collapsed; longer texts end in an ellipsis within the limit; null where nothing is left."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", None).when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def is_uuid(text: Column, four: bool = False) -> Column:
    return text.rlike(UUID4 if four else UUID)


def instant(text: Column) -> Column:
    """Microseconds of an ISO-8601 time that names its offset; null for a local or broken one."""
    return F.when(text.rlike(OFFSET_TIME), F.unix_micros(F.try_to_timestamp(text)))


def semver(text: Column) -> Column:
    """A strict version as three numbers, or null."""
    part = lambda i: F.regexp_extract(text, r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$", i)
    return F.when(part(1) != "", F.array(*(part(i).cast("int") for i in (1, 2, 3))))


def normal_decimal(text: Column) -> Column:
    """A decimal text without trailing zeros, for comparing identities."""
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)


def mtok(tokens: Column) -> Column:
    """Tokens as millions with two decimals, exact and ties to even; 0 and less than a hundredth are told apart, negative counts are null."""
    millions = F.bround(tokens.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"), 2).cast("decimal(20,2)")
    return F.when(tokens == 0, "0").when((tokens > 0) & (tokens < 10_000), "<0.01").when(tokens > 0, millions.cast("string"))


def project_label(project: Column) -> Column:
    """The last folder of a project's path, a repository's own folder for its .git; Unassigned where there is none."""
    path = F.regexp_replace(F.regexp_replace(project, r"^[^:]*:", ""), r"/+(\.git/*)?$", "")
    return F.when(project.isNull() | (project == "unassigned"), "Unassigned").otherwise(F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("")), F.regexp_replace(project, r"^[^:]*:", "")))


def content_id(*parts: Column) -> Column:
    """A content-addressed id: equal parts give equal ids."""
    return F.sha2(F.concat_ws(":", *parts), 256)
