"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often the corpus links them.

The tokens of a batch of documents stand in one array for each tokenizer, their ends as byte offsets in the concatenation of all texts. Ends are counted
once per tokenizer by byte; where both have one, a cut ends a group. Links are read off the merged ends: of the tokens at a byte, one of each covers it,
so each byte where some token ends ends one link. Sums by document are differences of running sums at the documents' bounds, and so are the digests' texts,
which are slices of one buffer.

What a link's pair counts is known only when all documents are encoded. Each task adds up its pairs, Spark adds these, and the encoded documents
wait in the shared folder. Pairs with at least one in ``SHARE`` of all links are at most ``SHARE`` many, by arithmetic, and are sent to the tasks;
documents meet the rest in a join that no pair can dominate.

Texts are cut before a space that follows ordinary text, where neither vocabulary has tokens across, and what a piece encodes to is kept in
bounded tables per task, since most pieces repeat. The vocabularies' content is sent with the tasks, which open no path.

Defined cases: a text that is null or empty, or that one vocabulary can't give back byte by byte, has no tokens: zeros and an empty digest; rows are counted each, whatever their
ids; a pair that ties with its B token's highest is a best one too; an empty table gives an empty one. Special strings inside texts are plain text. A text of any length is encoded whole.
``keep`` names the columns that are carried; others are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, Kept, byte_letters
from .common import Scratch, list_array, slices

#: Pairs with one in so many of all links are sent to the tasks.
SHARE = 200_000
#: Characters that are aligned at a time; distinct pairs that a task holds before it hands them on.
SLICE, HELD = 2_000_000, 1 << 20
#: Bits of the second id in a pair's key.
LOW = 20
#: How the first vocabulary's library splits texts before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUNS = regex.compile(r"[\s\x1c-\x1f]{2}|^[\s\x1c-\x1f]|[\s\x1c-\x1f]$")


class Tokenizers:
    """A: byte-level BPE from a ``tokenizers`` file; B: a ``sentencepiece`` file that marks spaces and spells the rest by bytes."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(a_json)
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
        special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        # The encoder merges by id, so ids have to follow the order of the merges.
        merged = [spec["model"]["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if merged != sorted(merged):
            raise ValueError("the ids of the vocabulary don't follow its merges")
        ranks = {t: i for t, i in vocab.items() if t not in special or special[t] != i}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *special.items()]:
            self.a_bytes[i] = token
        self.b_bytes = [self._b_bytes(i) for i in range(self.b.get_piece_size())]
        self.mark = self.b.piece_to_id("▁")
        # Cuts inside texts are safe as long as no piece holds a mark after another letter.
        self.cuts = not any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.a_piece = Kept(lambda p: np.array(self.a.encode_ordinary(p), dtype="<i4").tobytes(), 2 * PIECES).__getitem__
        self.b_piece = Kept(lambda p: np.array(self.b.encode(p[1:]) if p != " " else [self.mark], dtype="<i4").tobytes(), 2 * PIECES).__getitem__

    def _b_bytes(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def pieces(self, text: str) -> list[str]:
        """The text after a space, in pieces that begin with one."""
        if not self.cuts or _RUNS.search(text):
            return [" " + text]
        return [" " + x for x in text.split(" ")]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of both as raw 32-bit integers."""
        pieces = self.pieces(text)
        return b"".join(map(self.a_piece, pieces)), b"".join(map(self.b_piece, pieces))


@functools.lru_cache(maxsize=2)
def _tokenizers(a_json: str, b_model: bytes) -> Tokenizers:
    return Tokenizers(a_json, b_model)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


class Aligner:
    """Aligns the tokens of many documents at once."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = [_strings(a_bytes), _strings(b_bytes)]
        self.sizes = [np.array([len(t) for t in x], dtype=np.int64) for x in (a_bytes, b_bytes)]
        # An id followed by each of the three marks.
        self.decimal = _strings([f"{i}{mark}".encode() for i in range(max(map(len, (a_bytes, b_bytes)))) for mark in ",|;"])

    def joined(self, which: int, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of each document's tokens."""
        return _slices(self.bytes[which].take(pa.array(ids)), bounds)

    def __call__(self, a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """n_groups, n_links and digest of each document; then the key of each link, and the bounds of documents in these."""
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b), strict=True)]
        total = int(ends[0][-1]) if len(a) else 0
        at = [np.bincount(e, minlength=total + 1) for e in ends]  # zero or one by byte
        cut, any_end = at[0] & at[1], at[0] | at[1]
        # Documents end where all their tokens end.
        doc_end = np.concatenate([[0], ends[0]])[a_bounds]
        running = [np.cumsum(x) for x in (*at, cut, any_end)]
        groups, links = (np.diff(r[doc_end]) for r in running[2:])
        # The link that ends at a byte is of the tokens that are open just before it.
        last = np.flatnonzero(any_end)
        open_a, open_b = (r[last - 1] for r in running[:2])
        keys = a[open_a].astype(np.int64) << LOW | b[open_b]
        # Tokens in the order of their group, A before B: each has as many before it as its own side has, and those of the other in earlier groups (or in its own).
        of = [running[2][e - 1] for e in ends]  # the group of each token
        upto = [np.searchsorted(o, np.arange(int(running[2][-1]) + 1)) for o in of]  # tokens in earlier groups
        n = [np.arange(len(x)) for x in (a, b)]
        place_a, place_b = n[0] + upto[1][of[0]], n[1] + upto[0][of[1] + 1] if len(b) else n[1]
        closes = [np.append(o[1:] != o[:-1], True) if len(o) else np.zeros(0, bool) for o in of]
        text = np.empty(len(a) + len(b), dtype=np.int64)
        text[place_a], text[place_b] = a * 3 + closes[0], b * 3 + 2 * closes[1].astype(np.int64)
        parts = _slices(self.decimal.take(pa.array(text)), a_bounds + b_bounds)
        digests = [hashlib.sha256(p[:-1]).hexdigest() if len(p) else "" for p in parts]
        return groups, links, digests, keys, np.concatenate([[0], np.cumsum(links)])


def _slices(strings: pa.Array, bounds: np.ndarray) -> list[memoryview]:
    """The values of each range of a binary array, joined."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32, count=len(strings) + 1) if len(strings) else np.zeros(1, dtype=np.int32)
    data = memoryview(strings.buffers()[2]).cast("B") if len(strings) else memoryview(b"")  # unsigned, as bytes are
    at = offsets[bounds].tolist()
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


def _by_document(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each document and how often they stand in it; new bounds."""
    found, counts, sizes = [], [], [0]
    for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        k, n = np.unique(keys[i:j], return_counts=True)
        found.append(k)
        counts.append(n)
        sizes.append(len(k))
    return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, np.int64), *counts]), np.cumsum(sizes)


class Totals:
    """Counts by key, added up in sorted arrays."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether it is time to hand them on."""
        self.waiting.append((keys, counts))
        self.rows += len(keys)
        if self.rows > 4 * HELD:
            self.merge()
        return len(self.keys) > HELD

    def merge(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        self.keys, self.counts = keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
        self.waiting, self.rows = [], 0


def _as_lists(*columns: np.ndarray, bounds: np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(c.astype(np.int32))) for c in columns]


def encode_pairs(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...], text: str) -> DataFrame:
    """A row per document (row is set), with its tokens, groups and pairs, and rows of pairs added up by each task (row is null)."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    source = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(*shared.value)
        aligner, totals, row = Aligner(tokenizers.a_bytes, tokenizers.b_bytes), Totals(), TaskContext.get().partitionId() << 36
        names = [*(f"k{i}" for i in range(width)), "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"]
        types: list[pa.DataType] = []

        def added() -> Iterator[pa.RecordBatch]:
            totals.merge()
            if len(totals.keys):
                lists = _as_lists(totals.keys >> LOW, totals.keys & (1 << LOW) - 1, totals.counts, bounds=np.array([0, len(totals.keys)]))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), *lists], names)
            totals.__init__()

        for batch in batches:
            types[:] = [c.type for c in batch.columns[:width]]
            texts = batch.column(width).to_pylist()
            for i, j in slices(texts, SLICE):
                raw = [tokenizers.encode(t) if t else (b"", b"") for t in texts[i:j]]
                arrays = [list_array([r[k] for r in raw], pa.int32(), 4) for k in (0, 1)]
                views = [aligner.joined(k, x.values.to_numpy(), x.offsets.to_numpy()) for k, x in enumerate(arrays)]
                plain = [b" " + t.encode() if t else b"" for t in texts[i:j]]
                if not all(whole := [x == p and y == p for x, y, p in zip(*views, plain, strict=True)]):
                    arrays = [list_array([r[k] if w else b"" for r, w in zip(raw, whole, strict=True)], pa.int32(), 4) for k in (0, 1)]
                (a, a_bounds), (b, b_bounds) = ((x.values.to_numpy(), x.offsets.to_numpy().astype(np.int64)) for x in arrays)
                groups, links, digests, keys, bounds = aligner(a, b, a_bounds, b_bounds)
                keys, counts, bounds = _by_document(keys, bounds)
                full = totals.add(keys, counts)
                numbers = [np.arange(row, row + j - i), np.diff(a_bounds), np.diff(b_bounds), groups, links]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(width)), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(digests, pa.string()), *_as_lists(keys >> LOW, keys & (1 << LOW) - 1, counts, bounds=bounds)], names)
                row += j - i
                if full:
                    yield from added()
        yield from added()

    return source.mapInArrow(run, f"{fields}row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>")


def pair_counts(encoded: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, count of all documents' links, and whether no other pair of this b counts more."""
    added = encoded.where("row IS NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("count"))
    counts = scratch.table(added)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # at most one row per id
    return scratch.table(counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best")))


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "align")
    encoded = scratch.table(encode_pairs(docs, a_path, b_path, keep, text))
    counts = pair_counts(encoded, scratch)
    total = counts.agg(F.sum("count")).first()[0] or 0
    common = F.col("count") * SHARE >= F.lit(total)
    rows = sorted((a << LOW | b, n, best) for a, b, n, best in counts.where(common).collect())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else None)
    names = [*(f"k{i}" for i in range(len(keep))), "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = encoded.where("row IS NOT NULL")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value or (np.full(1, -1),) * 3
        for batch in batches:
            a, b, n = (batch.column(len(names) + i) for i in range(3))
            bounds = a.offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            (a, b, n) = (x.flatten().to_numpy().astype(np.int64) for x in (a, b, n))
            keys = a << LOW | b
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            met = known[at] == keys
            sums = [np.concatenate([[0], np.cumsum(np.where(met, n * x[at], 0))]) for x in (count, best)]
            other = np.concatenate([[0], np.cumsum(~met)])[bounds]
            lists = _as_lists(a[~met], b[~met], n[~met], bounds=other)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(np.diff(s[bounds])) for s in sums), *lists], [*names, "count_sum", "n_best", "a", "b", "n"])

    partly = scratch.table(found.select(*names, "a", "b", "n").mapInArrow(run, f"{fields}, count_sum long, n_best long, a array<int>, b array<int>, n array<int>"))
    pairs = partly.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("row", "x.*").join(counts.where(~common), ["a", "b"])
    more = pairs.groupBy("row").agg(F.sum(F.col("n") * F.col("count")).alias("more_count"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).cast("long").alias(c)
    return partly.drop("a", "b", "n").join(more, "row", "left").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_count"), "groups_sha256")
