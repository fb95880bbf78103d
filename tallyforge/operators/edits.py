"""Documents that are kept as logs of edits: replayed in order, one document at a time, however many there are.

A log's lines lie in one partition in order (documents are dealt by key, lines sorted by Spark), and a task folds them with the state of one
document in memory. Every value knows the line that wrote it last, as it is kept beside the value: what an edit drops, its lines go with.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an edit's ``kind`` means.
START, SET, PUSH, DELETE = 0, 1, 2, 3
ITEMS = "locator string, code string, last_line long, pending boolean, head string, ordinal int, item string, lines map<string,long>"


class EditError(ValueError):
    """Why a log can't be replayed; its text is the code."""


class Number(str):
    """A number as it was written."""


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key stands twice")
    return out


def parse(text: str) -> object:
    """A JSON value without repeated keys, whose numbers stay as written."""
    return json.loads(text, object_pairs_hook=_unique, parse_float=Number, parse_int=Number, parse_constant=Number)


def is_whole(value: object) -> bool:
    return isinstance(value, Number) and value.lstrip("-").isdigit()


class Cell:
    """A value and the line that wrote it. ``value`` is a dict or list of cells, or a plain value."""

    __slots__ = ("line", "value")

    def __init__(self, value: object, line: int):
        self.line = line
        self.value = {k: Cell(v, line) for k, v in value.items()} if isinstance(value, dict) else [Cell(v, line) for v in value] if isinstance(value, list) else value

    def text(self) -> str:
        if isinstance(self.value, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{c.text()}" for k, c in self.value.items()) + "}"
        if isinstance(self.value, list):
            return "[" + ",".join(c.text() for c in self.value) + "]"
        return str(self.value) if isinstance(self.value, Number) else json.dumps(self.value, ensure_ascii=False)

    def lines(self, at: str = "$") -> Iterator[tuple[str, int]]:
        """The path and line of this value and of all below it."""
        yield at, self.line
        below = self.value.items() if isinstance(self.value, dict) else enumerate(self.value) if isinstance(self.value, list) else ()
        for key, cell in below:
            yield from cell.lines(f"{at}[{key}]" if isinstance(key, int) else f"{at}.{key}")


def _step(cell: Cell, key: object) -> Cell:
    if is_whole(key) and isinstance(cell.value, list) and 0 <= int(key) < len(cell.value):
        return cell.value[int(key)]
    if isinstance(key, str) and not isinstance(key, Number) and isinstance(cell.value, dict) and key in cell.value:
        return cell.value[key]
    raise EditError("invalid_operation_path")


def edit(document: Cell | None, entry: object, line: int) -> Cell:
    """The document after one edit of its log."""
    if not isinstance(entry, dict):
        raise EditError("invalid_operation")
    kind = int(entry["kind"]) if is_whole(entry.get("kind")) else None
    if kind is None:
        raise EditError("unsupported_operation")
    if kind == START:
        if document is not None:
            raise EditError("duplicate_initial_state")
        if "v" not in entry:
            raise EditError("missing_initial_state")
        return Cell(entry["v"], line)
    if document is None:
        raise EditError("missing_initial_state")
    path = entry.get("k")
    keyed = isinstance(path, list) and all(is_whole(k) or isinstance(k, str) and not isinstance(k, Number) for k in path)
    if not keyed or (not path and kind in (SET, DELETE)):
        raise EditError("invalid_operation_path")
    if kind not in (SET, PUSH, DELETE):
        raise EditError("unsupported_operation")
    target = document
    for key in path if kind == PUSH else path[:-1]:
        target = _step(target, key)
    if kind == PUSH:
        if not isinstance(target.value, list):
            raise EditError("invalid_push_target")
        if "i" in entry:
            if not is_whole(entry["i"]) or not 0 <= int(entry["i"]) <= len(target.value):
                raise EditError("invalid_push_index")
            del target.value[int(entry["i"]) :]
        added = entry.get("v", [])
        if not isinstance(added, list):
            raise EditError("invalid_push_value")
        target.value.extend(Cell(v, line) for v in added)
        target.line = line
        return document
    key = path[-1]
    if isinstance(key, Number) or not isinstance(target.value, dict):
        raise EditError("invalid_delete_path" if kind == DELETE else "invalid_operation_path")
    if kind == SET:
        if "v" not in entry:
            raise EditError("missing_set_value")
        # A value that is set anew stands where it stood.
        target.value[key] = Cell(entry["v"], line)
    elif target.value.pop(key, None) is None:
        raise EditError("invalid_operation_path")
    return document


class _Replay:
    """The fold of one log."""

    def __init__(self, locator: str, flat: bool):
        self.locator, self.flat = locator, flat
        self.document: Cell | None = None
        self.code: str | None = None
        self.last, self.pending = 0, False

    def take(self, line: int, record: str | None, status: str) -> None:
        if self.code:
            return
        if status == "pending":
            self.pending = True
            return
        try:
            if record is None or status != "ok":
                raise EditError("malformed_operation")
            try:
                value = parse(record)
            except (ValueError, RecursionError) as error:
                raise EditError("malformed_operation") from error
            self.document = Cell(value, line) if self.flat else edit(self.document, value, line)
            self.last = line
        except EditError as error:
            self.code = f"{error}"

    def rows(self, items: str) -> Iterator[tuple]:
        """One row per item of the list ``items``, or one without item; the head is the document without that list."""
        if self.code is None and (self.document is None or not isinstance(self.document.value, dict)):
            self.code = "invalid_state" if self.flat else "missing_initial_state"
        if self.code:
            yield self.locator, self.code, self.last, self.pending, None, None, None, None
            return
        held = self.document.value.get(items)
        is_list = held is not None and isinstance(held.value, list)
        if is_list:
            self.document.value[items] = Cell([], held.line)
        yield self.locator, None, self.last, self.pending, self.document.text(), None, None, None
        for i, cell in enumerate(held.value if is_list else ()):
            yield self.locator, None, self.last, self.pending, None, i, cell.text(), list(cell.lines())


def replay(lines: DataFrame, items: str) -> DataFrame:
    """ITEMS of (locator, line, record, status): for each log a row with its head, and one for each item of the list named ``items``.

    A locator that doesn't end in .jsonl holds the document itself, in one line. A log whose edits don't apply has one row with a code. The last line may be
    pending: cut off while it was written. Blank lines are malformed here, so they have to be among the rows. ``lines`` names the line that wrote each value of an item, by its
    path below the item ($). Items are handed on one by one, so what a task holds is one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.int64()))
        names = [f.split()[0] for f in ITEMS.split(", ")]
        waiting: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting, strict=True), kinds, strict=True)], names)
            waiting.clear()
            return made

        def ended(log: _Replay) -> Iterator[pa.RecordBatch]:
            for row in log.rows(items):
                waiting.append(row)
                if len(waiting) >= 1000:
                    yield out()

        log: _Replay | None = None
        for batch in batches:
            for locator, line, record, status in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if log is None or log.locator != locator:
                    if log is not None:
                        yield from ended(log)
                    log = _Replay(locator, not locator.endswith(".jsonl"))
                log.take(line, record, status)
        if log is not None:
            yield from ended(log)
        if waiting:
            yield out()

    dealt = lines.select("locator", F.col("line").cast("long"), "record", "status").where("locator IS NOT NULL").repartition("locator").sortWithinPartitions("locator", "line")
    return dealt.mapInArrow(run, ITEMS)
