"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch  # noqa: F401  used by the operators

#: Rows of a batch are handed on once their texts reach this many characters.
BATCH_CHARS = 8_000_000


def slices(texts: list, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose texts stay near the limit, so that long documents don't pile up in memory."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text) if text else 0
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def list_array(parts: list[bytes], kind: pa.DataType, width: int) -> pa.ListArray:
    """An Arrow list column from the raw values of each row."""
    import numpy as np

    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // width for p in parts], out=ends[1:])
    values = pa.Array.from_buffers(kind, int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, most_bytes: int, seed: int, key: str = "doc_id", text: str = "text") -> list:
    """At most ``rows`` rows (k, t, y) chosen by a hash of the id: a bounded sample to fit a model on.

    The ids are chosen among the labels first, so that texts are only read for the sample, which is small enough to be
    sent to all tasks. Rows with longer texts than ``most_bytes`` are left out of the fit; of an id that stands with several
    texts the smallest is taken, so that what comes to the driver is bounded by ``rows`` times ``most_bytes``.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key).cast("long"), F.lit(seed)).alias("h"))
        .distinct()
        .orderBy("h", "k", "y")
        .limit(rows)
    )
    texts = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= most_bytes)
    return sorted(texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "t", "y").collect())
