"""Chat formatting.

A turn's content is a list of typed parts (text, image, audio, document). A visitor, one branch per type, turns each
part into text: a text part is escaped, any other becomes a numbered placeholder, and its reference and the number of
tokens it expands to are recorded in order. A template marks the turn by its role. Every mark begins with "<" or "[",
and a backslash stands before each "<", "[" and backslash of a text or role, so marks inside texts can't be taken for
the template's, and unescaping gives back the text exactly. Within a placeholder all but letters, digits, "_" and "-" of a type are escaped, so none looks like a mark.

Formatting is done turn by turn with Spark's functions, so a conversation of any length is spread over tasks; a
conversation's formatted text is its pieces in the order of turn (ties: role, text). What has to see a whole
conversation in order (digests) joins its sorted pieces to one stream and parses that, holding one turn at a time: turns end where their marks say, not where rows do.

Defined cases: null text or parts count as empty; a null role is an empty role; rows of a null conversation id form one
conversation with that id; repeated rows are all kept, side by side; no rows give no rows; a turn without a number comes first; other columns are dropped, also where they are
named as outputs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing mark by role; others are written [ROLE=...].
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: Part type: what one unit of its size expands to. Images count tiles of 14 x 14 pixels, audio 25 tokens a second, documents 800 a page.
TILE, PER_SECOND, PER_PAGE = 14, 25, 800
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
            none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
        )
    )


def _expanded(part: Column) -> Column:
    """Tokens that a part other than text stands for."""
    tiles = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / TILE)
    return (
        F.when(part["type"] == "image", tiles(part["width"]) * tiles(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def format_turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, text (of text parts), piece, loss_start, loss_chars, attachments.

    parts: a column of type PARTS, or None for plain texts. loss_start and loss_chars bound, in code points of the
    piece, what an assistant says, still escaped; loss_chars is null for other roles.
    """
    content = F.col(parts).cast(PARTS) if parts else text_part(F.col(text))
    source = rows.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.filter(F.coalesce(content, F.array().cast(PARTS)), lambda p: p.isNotNull()).alias("parts"),
    )
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(False))
    source = source.withColumn("media", F.filter("parts", lambda p: ~is_text(p)))
    number = lambda i: F.size(F.filter(F.slice("parts", 1, i), lambda p: ~is_text(p)))  # noqa: E731  placeholders before it
    plain = F.transform("parts", lambda p: F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(""))
    flat = F.transform(
        "parts",
        lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), F.coalesce(F.regexp_replace(p["type"], r"([^\p{L}\p{N}_-])", r"\\$1"), F.lit("unknown")), F.lit(":"), number(i).cast("string"), F.lit(">"))),
    )
    opening = closing = None
    for name, (a, b) in MARKS.items():
        opening = (F.when if opening is None else opening.when)(F.col("role") == name, F.lit(a))
        closing = (F.when if closing is None else closing.when)(F.col("role") == name, F.lit(b))
    opening = opening.otherwise(F.concat(F.lit("[ROLE="), F.regexp_replace(escape(F.col("role")), r"\]", r"\\]"), F.lit("]")))
    closing = closing.otherwise("[/ROLE]")
    attachments = F.transform("media", lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    spoken = F.array_join(flat, "")
    return (
        source.select("conv_id", "turn", "role", F.array_join(plain, "").alias("text"), spoken.alias("__flat"), opening.alias("__open"), closing.alias("__close"), attachments.alias("attachments"))
        .select(
            "conv_id", "turn", "role", "text", F.concat("__open", "__flat", "__close").alias("piece"), F.length("__open").cast("long").alias("loss_start"),
            F.when(F.col("role") == "assistant", F.length("__flat").cast("long")).alias("loss_chars"), "attachments",
        )
    )


_OPEN = re.compile(r"<<SYS>>|\[INST\]|<s>|\[ROLE=((?:[^\\\]]|\\.)*)\]", re.DOTALL)
_ROLE = {a: (name, b) for name, (a, b) in MARKS.items()}
#: What is escaped, and what may begin a closing mark: a placeholder has a letter, a digit or a backslash after its "<".
_STOP = re.compile(r"\\.|<[</]|\[", re.DOTALL)


class Parser:
    """Reads the turns of a conversation back from its formatted text, which comes in parts of any size."""

    def __init__(self):
        self.rest, self.role, self.close, self.at = "", None, "", 0

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        """Role and text of the turns that are now whole; placeholders stay as they are written."""
        self.rest += part
        while True:
            if self.role is None:
                m = _OPEN.match(self.rest)
                if m is None:
                    return
                self.role, self.close = _ROLE.get(m[0]) or (unescape(m[1]), "[/ROLE]")
                self.rest, self.at = self.rest[m.end() :], 0
            end = -1
            for m in _STOP.finditer(self.rest, self.at):
                if m[0][0] != "\\":
                    end = m.start()
                    break
                self.at = m.end()
            if end < 0 or len(self.rest) < end + len(self.close):
                return
            if not self.rest.startswith(self.close, end):
                raise ValueError(f"a turn of {self.role!r} holds another one's mark")
            turn = self.role, unescape(self.rest[:end])
            self.rest, self.role = self.rest[end + len(self.close) :], None
            yield turn

    def end(self) -> None:
        if self.rest or self.role is not None:
            raise ValueError("a conversation ends within a turn")


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.parser, self.said, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, length: int | None) -> None:
        """The next piece of the stream, and the stretch of it that is under the loss mask."""
        for role, text in self.parser.feed(piece):
            self.said.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            self.turns += 1
        self.chars += len(piece)
        if length is not None:
            masked = unescape(piece[start : start + length])
            self.loss.update(masked.encode("utf-8", "replace"))
            self.loss_chars += len(masked)

    def row(self) -> tuple:
        self.parser.end()
        return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: parsed from each conversation's formatted text and its mask.

    A SHA-256 has to take a conversation's text in order; the sorted pieces are streamed through it, never gathered.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, piece, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(piece, start, length)
            yield _batch(done)
        if now is not None:
            yield _batch([now.row()])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "piece", "loss_start", "loss_chars")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
