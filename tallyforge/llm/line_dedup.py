"""Line dedup by winnowing.

Repeated passages of these documents begin and end inside lines, so the lines that are hashed are rolling ones: LINE words
in a row, whatever white space is between them (a run of whole lines with RUN words or more is such a run too). Of each
WINDOW hashes in a row the smallest is a fingerprint, so any two runs of RUN = LINE + WINDOW - 1 equal words share one. What
is deleted is every RUN words in a row (a window) that stood earlier, in a document with a smaller id or before in the text.

A fingerprint is extended both ways, over all words that a window around it can hold, and the extended matches are classes:

* a fingerprint that stands in one place only repeats nothing;
* in all places of a class but those of its first document, every window around the fingerprint stood earlier: these
  places go as a whole;
* the places of a class's first document need to be compared with other classes of the fingerprint, if there are any: only for
  them each window is hashed, and those that stood in an earlier document go.

So copies of long passages cost one row a fingerprint, not one a window, and a window is found whichever document held it
first: none is missed, and nothing else is deleted, save for equal 64-bit hashes of different words. Smallest ids are taken map-side first.
What is joined is written before, so that Spark broadcasts it where its size allows that, and else splits a hot
fingerprint, class or window over tasks. What is known of each document grows with the documents and has no bound, so it is never broadcast: texts are shuffled by
id twice, at every size.

Defined cases: null and empty texts, texts under RUN words, and rows without an id stay as they are; rows that repeat an
id and text are one place and all treated alike; different texts of one id are ordered by a hash of the text; order is by id, so of equal
documents the smallest id keeps its text; a text of which all is deleted becomes empty; where a text repeats a short period,
all that repeats goes. Words are what stands between the ASCII white space. White space around a deleted run closes up to its longer side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .words import WordHasher, mix, rolling

LINE, RUN = 16, 50
WINDOW = RUN - LINE + 1
#: Characters of text that are hashed together.
SLAB = 1_000_000
_GAPS = " \t\n\x0b\x0c\r"
_WORD = re.compile(f"[^{_GAPS}]+")


def extreme(h: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``window`` values in a row, by doubling."""
    size = 1
    while size < window:
        step = min(size, window - size)
        h = pick(h[:-step], h[step:])
        size += step
    return h


def winnow(h: np.ndarray, whole: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the minima of the windows that are ``whole``; of a stretch of equal minima side by side the ends and each window-th."""
    least = np.where(whole, extreme(h, window, np.minimum), np.uint64(0))
    around = np.zeros(window - 1, dtype=np.uint64)
    at = np.flatnonzero((extreme(np.concatenate([around, least, around]), window, np.maximum) == h) & (h > 0))
    if not len(at):
        return at
    value = h[at]
    new = np.concatenate([[True], (np.diff(at) > 1) | (value[1:] != value[:-1])])
    first = at[np.flatnonzero(new)][np.cumsum(new) - 1]
    return at[new | np.concatenate([new[1:], [True]]) | ((at - first) % window == 0)]


def extended(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words of all windows around each place, from the lines that cover them, in a text of the lines low to high."""
    reach = WINDOW - 1
    out = np.minimum(at - low, reach).astype(np.uint64) * np.uint64(WINDOW) + np.minimum(high - at, reach).astype(np.uint64)
    for step in sorted({*range(-reach, reach, LINE), 0, reach}):
        out = mix(out * np.uint64(31) + h[np.clip(at + step, low, high)])
    return out


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, v (a hash that tells the texts of an id apart), text of all rows that have both."""
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.hash(F.col(text)).alias("v"), F.col(text).alias("text"))


def marks(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, ...]:
    """Fingerprint, class, text, place and whether the class stood before in the text, of all fingerprints of these texts."""
    h, start = hasher.located(b" ".join(texts))
    if len(h) < RUN:
        return tuple(np.zeros(0, dtype=k) for k in (np.uint64, np.uint64, np.int64, np.int64, bool))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    begins = np.searchsorted(start, begins)  # from bytes to words
    ends = np.repeat(begins[1:], np.diff(begins))
    lines = rolling(h, LINE)
    at = winnow(lines, ends[: len(h) - RUN + 1] - np.arange(len(h) - RUN + 1) >= RUN)
    of = np.searchsorted(begins, at, "right") - 1
    classes = extended(lines, at, begins[of], begins[of + 1] - LINE)
    again = np.ones(len(at), dtype=bool)
    again[np.unique(classes ^ mix(of.astype(np.uint64)), return_index=True)[1]] = False
    return lines[at], classes, of, at - begins[of], again


def fingerprints(texts: DataFrame) -> DataFrame:
    """h, c, doc, v, at, again: the winnowed fingerprints of every text and their classes, places counted in words; again: the class stood before in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=False)
        for batch in batches:
            ids, versions, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in slices(texts, SLAB):
                h, c, of, at, again = marks([t.encode("utf-8", "replace") for t in texts[a:b]], hasher)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (h.view(np.int64), c.view(np.int64), ids[of + a], versions[of + a], at.astype(np.int32), again))), ["h", "c", "doc", "v", "at", "again"])

    return texts.mapInArrow(run, "h long, c long, doc long, v int, at int, again boolean")


def matched(prints: DataFrame, order: Column, scratch: Scratch) -> DataFrame:
    """doc, v, gone, open: of each text the places that go as a whole, and those whose windows are to be compared."""
    new = prints.where("NOT again").withColumn("o", order)
    live = new.groupBy("h").agg((F.min("c") < F.max("c")).alias("varied"), (F.min("o") < F.max("o")).alias("more"))
    live = scratch.table(live.where("varied OR more").select("h", "varied"))
    places = scratch.table(new.join(live, "h").select("c", "o", "doc", "v", "at", "varied"))
    first = scratch.table(places.groupBy("c").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first < last").select("c", "first"))
    later = F.coalesce(F.col("o") > F.col("first"), F.lit(False))
    found = places.join(first, "c", "left").select("doc", "v", "at", later.alias("later"), "varied").where("later OR varied")
    found = found.unionByName(prints.where("again").select("doc", "v", "at", F.lit(True).alias("later"), F.lit(False).alias("varied")))
    return found.groupBy("doc", "v").agg(F.collect_list(F.when(F.col("later"), F.col("at"))).alias("gone"), F.collect_list(F.when(~F.col("later"), F.col("at"))).alias("open"))


def around(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each RUN words in a row that hold one of these places and whose smallest line hash is that of one."""
    lines = rolling(h, LINE)
    least = extreme(lines, WINDOW, np.minimum)
    edge = np.zeros(len(lines) + 1, dtype=np.int32)
    np.add.at(edge, np.maximum(places - WINDOW + 1, 0), 1)
    np.add.at(edge, places + 1, -1)
    at = np.flatnonzero((edge.cumsum()[: len(least)] > 0) & np.isin(least, lines[places]))
    return rolling(h, RUN)[at], at


def windows(texts: DataFrame, places: DataFrame) -> DataFrame:
    """w, doc, v, at, again: the windows around these places; again: it stands before in the same text."""
    joined = texts.join(places.where(F.size("open") > 0).hint("merge"), ["doc", "v"]).select("doc", "v", "text", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=False)
        for batch in batches:
            ids, versions, texts, each = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3)
            for lo, hi in slices(texts, SLAB):
                ws, ds, vs, ps, again = [], [], [], [], []
                for i in range(lo, hi):
                    w, at = around(hasher(texts[i].encode("utf-8", "replace")), np.unique(each[i].values.to_numpy()))
                    first = np.zeros(len(w), dtype=bool)
                    first[np.unique(w, return_index=True)[1]] = True
                    ws.append(w.view(np.int64))
                    ds.append(np.full(len(w), ids[i]))
                    vs.append(np.full(len(w), versions[i]))
                    ps.append(at.astype(np.int32))
                    again.append(~first)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ws, ds, vs, ps, again)], ["w", "doc", "v", "at", "again"])

    return joined.mapInArrow(run, "w long, doc long, v int, at int, again boolean")


def earlier(found: DataFrame, order: Column, scratch: Scratch) -> DataFrame:
    """doc, v, starts: of each text the windows that stood earlier."""
    new = found.where("NOT again").withColumn("o", order)
    first = scratch.table(new.groupBy("w").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first < last").select("w", "first"))
    old = new.join(first, "w").where("o != first").select("doc", "v", "at").unionByName(found.where("again").select("doc", "v", "at"))
    return old.groupBy("doc", "v").agg(F.collect_list("at").alias("starts"))


def covered(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the word ranges of all windows around these places and of those that start here, joined where they meet; the last may end beyond the text."""
    a = np.concatenate([np.maximum(places - WINDOW + 1, 0), starts])
    b = np.concatenate([places + RUN, starts + RUN])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([new[1:], [True]])]


def ranges(gone: DataFrame) -> DataFrame:
    """doc, v, lows, highs of (doc, v, gone, starts): what goes of each text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [covered(*(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in pair)) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x for x, _ in both], kind), pa.array([y for _, y in both], kind)], ["doc", "v", "lows", "highs"])

    return gone.mapInArrow(run, "doc long, v int, lows array<int>, highs array<int>")


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these word ranges."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at, gap = [], 0, ""
    for a, b in ranges:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    out.append(text[at:])
    kept = out[0]
    for part in out[1:]:
        left, right = kept.rstrip(_GAPS), part.lstrip(_GAPS)
        gap = max(kept[len(left) :], part[: len(part) - len(right)], key=lambda g: ("\n" in g, len(g)))
        kept = left + (gap if left and right else "") + right
    return kept


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without runs that stood earlier, then n_words, n_removed and runs (first word, end); columns of these names are replaced."""
    docs = docs.drop("n_words", "n_removed", "runs")
    scratch = Scratch(docs.sparkSession, "lines")
    texts = _texts(docs, key, text)
    prints = scratch.table(fingerprints(texts))
    # Where an id has several texts, these are ordered too; a lone number is cheaper to take the smallest of.
    several = prints.groupBy("doc").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a != b").limit(1).count()
    order = F.struct("doc", "v") if several else F.col("doc")
    places = scratch.table(matched(prints, order, scratch))
    scratch.drop(prints)
    found = scratch.table(windows(texts, places))
    old = scratch.table(earlier(found, order, scratch))
    scratch.drop(found)
    gone = scratch.table(ranges(places.where(F.size("gone") > 0).join(old, ["doc", "v"], "full_outer").select("doc", "v", "gone", "starts")))
    gone = gone.select(F.col("doc").alias("__id"), F.col("v").alias("__v"), F.col("lows").alias("__lows"), F.col("highs").alias("__highs"))
    rest = [c for c in docs.columns]
    joined = docs.withColumn("__id", F.col(key).cast("long")).withColumn("__v", F.hash(F.col(text))).join(gone.hint("merge"), ["__id", "__v"], "left").select(*[F.col(f"`{c}`") for c in rest], "__lows", "__highs")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    where = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            for lo, hi in slices(texts, SLAB):
                part = batch.slice(lo, hi - lo)
                new, n, gone, runs = [], [], [], []
                for t, a, b in zip(texts[lo:hi], part.column(len(rest)).to_pylist(), part.column(len(rest) + 1).to_pylist(), strict=True):
                    words = len(t.encode("utf-8", "replace").split()) if t else 0
                    pairs = [(x, min(y, words)) for x, y in zip(a, b, strict=True)] if a else []
                    new.append(without(t, pairs) if pairs else t)
                    n.append(words)
                    gone.append(sum(y - x for x, y in pairs))
                    runs.append([{"start": x, "end": y} for x, y in pairs])
                columns = [part.column(c) for c in range(len(rest))]
                columns[where] = pa.array(new, pa.string())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(gone, pa.int32()), pa.array(runs, kind)], [*rest, "n_words", "n_removed", "runs"])

    return joined.mapInArrow(run, f"{kinds}, n_words int, n_removed int, runs array<struct<start:int,end:int>>")
