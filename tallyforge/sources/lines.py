"""JSON lines of log files as rows, told apart as good, malformed, or the unfinished tail of a growing file."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = "locator string, line long, record string, status string"


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key stands twice")
    return out


def parse_line(raw: bytes) -> dict:
    """An object without repeated keys; whole numbers stay whole and others exact."""
    found = json.loads(raw.decode("utf-8"), object_pairs_hook=_unique, parse_float=Decimal)
    if not isinstance(found, dict):
        raise ValueError("a line is an object")
    return found


def split_lines(content: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """Line number from 1, bytes, and whether it ended with a line feed."""
    parts = content.split(b"\n")
    for i, part in enumerate(parts[:-1], 1):
        yield i, part, True
    if parts[-1]:
        yield len(parts), parts[-1], False


def read_lines(files: DataFrame) -> DataFrame:
    """LINES of (path, content): status ok, malformed, or pending for a broken last line without a line feed.

    A null record is a line that can't be read; blank lines are left out. Files are read whole, one row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for number, raw, ended in split_lines(content or b""):
                    if not raw.strip():
                        continue
                    try:
                        parse_line(raw)
                        rows.append((path, number, raw.decode("utf-8"), "ok"))
                    except (ValueError, RecursionError):
                        rows.append((path, number, None, "malformed" if ended else "pending"))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["locator", "line", "record", "status"])

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, LINES)


def given(usage: Column, name: str) -> Column:
    """Whether a variant object has the field, whatever it holds."""
    return F.coalesce(F.try_variant_get(usage, f"$.{name}", "variant").isNotNull(), F.lit(False))


def whole(usage: Column, name: str) -> Column:
    """A token count of a variant object: a whole number from 0 below 2**63, else null. Numbers in quotes or with a point aren't counts."""
    kind = F.schema_of_variant(F.try_variant_get(usage, f"$.{name}", "variant"))
    number = F.try_variant_get(usage, f"$.{name}", "bigint")
    return F.when((kind == "BIGINT") & (number >= 0), number)


def an_object(value: Column) -> Column:
    """The variant if it is an object, else null; what lies in it isn't looked at."""
    return F.when(F.try_variant_get(value, "$", "struct<>").isNotNull(), value)


def count(record: Column, *path: str) -> Column:
    """``whole`` by the path in a JSON text."""
    return whole(F.try_parse_json(record), ".".join(path))
