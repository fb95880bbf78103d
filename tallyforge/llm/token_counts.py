"""Token counts.

Which strings of the vocabulary encode alone as one token is proved once, on the driver, by merging each of them (a
vocabulary is a bounded table; the proof is sent with the task). A pre-token among them counts one without any merge;
only the rest is merged. Counts of words and of pieces are kept per task, as they repeat.

Defined cases: a null text has no bytes and no tokens; repeated rows are counted each; a special token spelled inside
a text counts as one. An empty table gives an empty one; a text of any length is counted whole; ties of ranks are merged from the left. ``keep`` names the columns that are carried;
others are ignored, whatever their names, but none that is carried may be called n_bytes, n_tokens or over_limit.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, WORDS, Bpe, Kept, load


def proved(bpe: Bpe) -> set[str]:
    """Pre-tokens, as text, that the merges turn into exactly one token."""
    byte_of = {c: b for b, c in enumerate(bpe.letters)}
    out = set()
    for token, i in bpe.vocab.items():
        try:
            text = bytes(byte_of[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):  # part of a letter: it can't be a pre-token
            continue
        if bpe.pretokens(text) == [text] and bpe.word(text) == [i]:
            out.add(text)
    return out


@functools.lru_cache(maxsize=4)
def _proved(path: str) -> frozenset[str]:
    return frozenset(proved(load(path)))


class Counter:
    def __init__(self, bpe: Bpe, whole: frozenset[str]):
        self.bpe = bpe
        word = Kept(lambda w: len(bpe.word(w)), WORDS).__getitem__
        self.piece = Kept(lambda p: sum(1 if w in whole else word(w) for w in bpe.pretokens(p)), PIECES).__getitem__

    def count(self, text: str) -> int:
        bpe, n = self.bpe, 0
        for section, special in bpe.sections(text):
            n += sum(map(self.piece, bpe.pieces(section))) + (special >= 0)
        return n


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """The columns in ``keep``, then n_bytes, n_tokens and over_limit, for every row of ``docs``."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    whole = source.sparkSession.sparkContext.broadcast(_proved(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(path), whole.value)
        for batch in batches:
            texts = batch.column(len(keep))
            counts = pa.array([counter.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            rest = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, sizes, counts, pc.greater(counts, limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"{fields}, n_bytes long, n_tokens long, over_limit boolean")
