"""Benchmark decontamination.

A document leaks an item if some stretch of its words is within MOST_EDITS of the item's length in edit distance, counted in
words (lower case, without punctuation). Windows as long as an item are slid over the whole text. A window can only match
if it holds enough of the items' word triples (an edit spoils three) and few words that no item has (each is an edit),
which rolling counts tell without loss. What is left is embedded by random walks (CGK): at each of 3n steps the current word is written down, and a random bit chosen by
step and word says whether to move on; texts within few edits get embeddings of small Hamming distance. SAMPLED places of
the embedding make a bucket, in each of TABLES independent walks; a window that meets an item in any bucket is verified
by the exact edit distance (bit-parallel, over the whole region). Exact copies always meet; for copies with edits the
number of tables is chosen for a recall of 0.95 and more (measured in the tests).

Items are sent to all tasks in chunks of at most CHUNK items; each further chunk is a job of its own over what the one before wrote, and the items sent for that are
dropped, so what is held at a time is bounded however many items there are. Documents are never shuffled.

Defined cases: null and empty texts leak nothing; items without words, or null, match nothing; rows that repeat are
flagged alike; an item that occurs several times in a text is reported once, at its closest and then first place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Kept
from .common import Scratch, slices
from .words import mix, rolling

MOST_EDITS = 0.2
#: Words whose hashes are kept per task, twice.
WORDS = 80_000
TABLES, SAMPLED, SEED = 32, 6, 5
CHUNK = 20_000
#: Item lengths whose windows are counted together differ by this factor at most.
STEP = 1.25
#: Bits of a filter for each entry.
ROOM = 64
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
LEAKS = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def _word(piece: str) -> int:
    word = _EDGE.sub("", piece)
    return xxhash.xxh3_64_intdigest(word) | 1 if word else 0


class Hasher:
    """The hashes of a text's words: lower case, without punctuation around them; what is only punctuation is no word."""

    def __init__(self):
        self.of = Kept(_word, WORDS).__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        pieces = text.lower().split() if text else []
        h = np.fromiter(map(self.of, pieces), dtype=np.uint64, count=len(pieces))
        return h[h != 0]


def buckets(rows: np.ndarray) -> np.ndarray:
    """TABLES x rows: the sampled places of the CGK embeddings of sequences of word hashes, as one hash each."""
    n, length = rows.shape
    padded = np.concatenate([rows, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    taken = [np.random.default_rng([SEED, length, t]).choice(3 * length, min(SAMPLED, 3 * length), replace=False) for t in range(TABLES)]
    wanted: dict[int, list[tuple[int, int]]] = {}
    for t, places in enumerate(taken):
        for k, step in enumerate(places.tolist()):
            wanted.setdefault(step, []).append((t, k))
    out = np.zeros((TABLES, n, min(SAMPLED, 3 * length)), dtype=np.uint64)
    at, every = np.zeros((TABLES, n), dtype=np.int64), np.arange(n)[None, :]
    for step in range(max(wanted) + 1):
        now = padded[every, at]
        for t, k in wanted.get(step, ()):
            out[t, :, k] = now[t]
        seeds = np.array([(t * 1_000_003 + step) * 0x9E3779B97F4A7C15 % (1 << 64) for t in range(TABLES)], dtype=np.uint64)[:, None]
        at = np.minimum(at + (mix(now ^ seeds) >> np.uint64(63)).astype(np.int64), length)
    h = np.zeros((TABLES, n), dtype=np.uint64)
    for k in range(out.shape[2]):
        h = mix(h * np.uint64(31) + out[:, :, k] + np.uint64(k + 1))
    return mix(h + np.arange(TABLES, dtype=np.uint64)[:, None])


def edit_search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of the text, and where the first such stretch ends (Myers)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, p in enumerate(pattern):
        masks[p] = masks.get(p, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, t in enumerate(text):
        eq = masks.get(t, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(horizontal | plus) & full), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (~(vertical | up) & full), up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Class:
    """Items of similar length, found by windows of the shortest one's: the buckets of their beginnings, in order."""

    low: int
    high: int
    need: int
    vocabulary: np.ndarray
    triples: np.ndarray
    keys: np.ndarray
    items: np.ndarray


@dataclass
class Items:
    ids: list[int]
    words: list[list[int]]
    own: list[frozenset[int]]
    triples: np.ndarray
    classes: list[Class]


def allowed(length: int) -> int:
    return int(length * MOST_EDITS)


def _filter(hashes: np.ndarray) -> np.ndarray:
    """A table that has a one for each of these hashes, and few others; its size is a power of two."""
    bits = max(10, (ROOM * max(1, len(hashes)) - 1).bit_length())
    out = np.zeros(1 << bits, dtype=np.uint8)
    out[hashes >> np.uint64(64 - bits)] = 1
    return out


def _in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[hashes >> np.uint64(65 - len(table).bit_length())]


def _triples(h: np.ndarray) -> frozenset[int]:
    return frozenset(rolling(h, 3).tolist()) if len(h) > 2 else frozenset()


def prepare(rows: list[tuple[int, str]]) -> Items:
    hashed = Hasher()
    known = sorted(((i, h) for i, t in sorted(rows) if len(h := hashed(t))), key=lambda x: len(x[1]))
    classes: list[Class] = []
    a = 0
    while a < len(known):
        low = len(known[a][1])
        b = a
        while b < len(known) and len(known[b][1]) <= STEP * low:
            b += 1
        lengths = [len(h) for _, h in known[a:b]]
        words = np.concatenate([h for _, h in known[a:b]])
        met = buckets(np.stack([h[:low] for _, h in known[a:b]]))
        keys, items = met.reshape(-1), np.tile(np.arange(a, b), TABLES)
        order = np.argsort(keys, kind="stable")
        classes.append(Class(low, lengths[-1], max(0, min(n - 2 - 3 * allowed(n) for n in lengths)), _filter(mix(words)), _filter(np.concatenate([rolling(h, 3) for _, h in known[a:b] if len(h) > 2] or [words[:0]])), keys[order], items[order]))
        a = b
    return Items([i for i, _ in known], [h.tolist() for _, h in known], [_triples(h) for _, h in known], _filter(np.concatenate([np.zeros(0, np.uint64), *(rolling(h, 3) for _, h in known if len(h) > 2)])), classes)


def candidates(texts: list[np.ndarray], items: Items) -> set[tuple[int, int, int]]:
    """(text, item, window start) of the windows that meet an item in a bucket."""
    windows: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in items.classes]
    for d, h in enumerate(texts):
        n = len(h)
        if n == 0:
            continue
        three = rolling(h, 3) if n > 2 else h[:0]
        some = three[_in(items.triples, three) > 0]
        for c, found in zip(items.classes, windows, strict=True):
            if n < c.low - allowed(c.low) or len(some) < c.need or int(_in(c.triples, some).sum()) < c.need:
                continue
            total = np.concatenate([[0], np.cumsum(_in(c.triples, three), dtype=np.int64)])
            foreign = np.concatenate([[0], np.cumsum(_in(c.vocabulary, mix(h)) == 0, dtype=np.int64)])
            starts, most = np.arange(n), allowed(c.high)
            near = np.minimum(starts + c.low - allowed(c.low), n)
            far = np.minimum(starts + c.high + most - 2, len(three))
            starts = starts[(foreign[near] - foreign[:-1] <= most) & (total[np.maximum(far, 0)] - total[np.minimum(starts, len(three))] >= c.need)]
            if len(starts):
                padded = np.concatenate([h, np.zeros(c.low, dtype=np.uint64)])
                found.append((np.full(len(starts), d), starts, padded[starts[:, None] + np.arange(c.low)]))
    met: set[tuple[int, int, int]] = set()
    for c, found in zip(items.classes, windows, strict=True):
        if not found:
            continue
        of, starts, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        for a in range(0, len(rows), 8192):
            keys = buckets(rows[a : a + 8192])
            low, high = np.searchsorted(c.keys, keys, "left"), np.searchsorted(c.keys, keys, "right")
            for t, i in zip(*np.nonzero(high > low), strict=True):
                for k in c.items[low[t, i] : high[t, i]].tolist():
                    met.add((int(of[a + i]), k, int(starts[a + i])))
    return met


def leaks(texts: list[np.ndarray], items: Items) -> list[list[dict]]:
    """For each sequence of word hashes the items that it leaks, each at its closest place."""
    by_item: dict[tuple[int, int], list[int]] = {}
    for d, k, s in candidates(texts, items):
        by_item.setdefault((d, k), []).append(s)
    found: list[list[dict]] = [[] for _ in texts]
    for (d, k), starts in by_item.items():
        pattern = items.words[k]
        slack = allowed(len(pattern))
        best, until = (slack + 1, 0), -1
        for s in sorted(starts):
            if s <= until:
                continue
            until = s + slack  # windows up to here lie in the region that is searched now
            low = max(0, s - slack)
            region = texts[d][low : until + len(pattern) + slack]
            if len(items.own[k] & _triples(region)) < len(items.own[k]) - 3 * slack:  # each edit spoils three at most
                continue
            edits, end = edit_search(pattern, region.tolist())
            best = min(best, (edits, low + end))
        if best[0] <= slack:
            found[d].append({"item_id": items.ids[k], "distance": best[0], "start": max(0, best[1] - len(pattern)), "end": best[1]})
    return [sorted(x, key=lambda y: (y["start"], y["item_id"])) for x in found]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs``, then leaks: item, distance in words, and where in the document's words (a column of this name is replaced)."""
    spark, docs = docs.sparkSession, docs.drop("leaks")
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    chunks = max(1, -(-items.count() // CHUNK))
    columns = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = columns.index(text)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    out, scratch = docs.withColumn("leaks", F.array().cast(LEAKS)), Scratch(spark, "leaks")
    for chunk in range(chunks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == chunk) if chunks > 1 else items
        sent = spark.sparkContext.broadcast(prepare([tuple(r) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashed = Hasher()
            for batch in batches:
                for a, b in slices(batch.column(at).to_pylist()):
                    rows = batch.slice(a, b - a)
                    new = leaks([hashed(t) for t in rows.column(at).to_pylist()], sent.value)
                    found = [x + y for x, y in zip(rows.column(len(columns)).to_pylist(), new, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(found, kind)], [*columns, "leaks"])

        before, out = out, out.mapInArrow(run, f"{kinds}, leaks {LEAKS}")
        if chunk < chunks - 1:
            out = scratch.table(out)
            sent.destroy()
            if chunk:
                scratch.drop(before)
    return out
