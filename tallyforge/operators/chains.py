"""Chains of events: files whose events name their parents, checked in one ordered pass.

A file's events lie in one partition in order, and a task passes over them with what it has to know of one file: where each id stood. Records stay with Spark; what passes here are
the few fields of an envelope, and what comes back is a verdict on each line and one on the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A null line is the verdict on the file: its code is null if its chain is sound.
VERDICTS = "locator string, line long, code string, accepted boolean"


class _Chain:
    """One file: its starts, where ids stood first, and which of them were turned down."""

    def __init__(self, locator: str):
        self.locator = locator
        self.starts: list[tuple[int, bool]] = []
        self.before_start = self.early = False
        self.place: dict[str, int] = {}
        self.refused: set[str] = set()
        self.events: list[tuple[int, str, str | None]] = []
        self.rows: list[tuple] = []

    def take(self, line: int, is_start: bool, valid: bool, event: str | None, parent: str | None) -> None:
        if is_start:
            self.starts.append((line, valid))
        elif valid and not self.starts:
            self.before_start = True
        if not valid:
            self.rows.append((self.locator, line, None, False))
        elif event in self.place:
            self.rows.append((self.locator, line, "duplicate_event_id", False))
        else:
            self.place[event] = line
            self.events.append((line, event, parent))

    def verdicts(self) -> Iterator[tuple]:
        """What each line is, once all ids of the file are known."""
        code, at = None, None
        if len(self.starts) != 1:
            code = "invalid_session_start"
        elif not self.starts[0][1] or self.before_start:
            code, at = "invalid_session_start", self.starts[0][0]
        yield self.locator, at if code else None, code, code is None
        if code:
            return
        yield from self.rows
        for line, event, parent in self.events:
            known = None if parent is None else self.place.get(parent)
            # A parent comes before its event, and what a refused event leads to is refused, too.
            if parent is not None and (known is not None and known >= line or parent in self.refused):
                self.refused.add(event)
                yield self.locator, line, "invalid_event_chain", False
            else:
                yield self.locator, line, "event_chain_gap" if parent is not None and known is None else None, True


def qualify(events: DataFrame, parts: int | None = None) -> DataFrame:
    """VERDICTS of (locator, line, is_start, valid, event_id, parent_id): valid says whether the envelope can be read.

    A file has one start, valid and before all other valid events; ids stand once (the first counts), parents before what they lead to. A gap, where a parent isn't there, is told but accepted. The verdict on a file
    comes as a row whose code is null, or says why the file is refused (its line is the start's, where there is one) and is the file's only one. ``parts``: into how many files are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
        names = [f.split()[0] for f in VERDICTS.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def ended(chain: _Chain) -> Iterator[pa.RecordBatch]:
            rows = []
            for row in chain.verdicts():
                rows.append(row)
                if len(rows) >= 10_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

        chain: _Chain | None = None
        for batch in batches:
            for locator, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain is None or chain.locator != locator:
                    if chain is not None:
                        yield from ended(chain)
                    chain = _Chain(locator)
                chain.take(*event)
        if chain is not None:
            yield from ended(chain)

    dealt = events.select("locator", "line", "is_start", "valid", "event_id", "parent_id").repartition(*([parts] if parts else []), "locator").sortWithinPartitions("locator", "line")
    return dealt.mapInArrow(run, VERDICTS)
