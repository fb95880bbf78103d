"""LM scoring by a subword lattice.

The pieces of an existing vocabulary span a lattice over each word, and a training word is one more arc over the whole of itself. Every way through is a segmentation, weighted by the
probabilities of its arcs, and the forward recursion in log space sums over all of them. So a text has the marginal probability of its words, each after a word mark, and of one end.
Characters that are no piece are spelled by byte pieces.

The arc of a word has (c - ``DISCOUNT``) / N; what this leaves, ``DISCOUNT`` for each distinct word, goes to words that are spelled, so that all texts together have one.
The vocabulary is taken as it is. Its scores are ranks, not probabilities, in files of the merging kind; they give the first weights (by Zipf's law), from
which ``ROUNDS`` passes of expected counts over all distinct training words give the probabilities of pieces in words that are spelled. The vocabulary bounds
what comes to the driver in a pass.

Words are counted map-side, then by Spark. A word's lattice is walked once for the whole corpus, in batches of distinct words whose arcs end at the same place. Words that make up at least one in
``SHARE`` of all tokens are at most ``SHARE`` many, by arithmetic, and are sent to the tasks (if of ``MOST_BYTES`` or less); documents hold the counts of
their other words, which meet the table in a join that no word can dominate.

Defined cases: a null text is empty and has only its end; rows are scored each, whatever their ids; white space is what separates words and isn't scored; without training rows
every count is zero, words are spelled by the first weights, and go on with one half; an empty table gives an empty one. A word of any length is scored whole. ``keep`` names the columns that are
carried; others are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Passes of expected counts, what each piece counts besides, and what is taken from each word's count.
ROUNDS, PRIOR, DISCOUNT = 2, 0.1, 0.75
#: Words with one in so many of all tokens are sent to the tasks, if they are no longer than that.
SHARE, MOST_BYTES = 300_000, 64
#: Distinct words held by a task before they are handed on; characters of words whose lattices are walked together.
HELD, WALKED = 300_000, 1 << 18
#: What the base adds to each count.
ADDED = 0.1
MARK = "▁"


def vocabulary(path: str) -> tuple[list[str], np.ndarray, list[int]]:
    """Pieces, scores and the ids of the 256 byte pieces of a sentencepiece file. Controls and the unknown piece are the empty string."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = ["" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else model.id_to_piece(i) for i in ids]
    return pieces, np.array([model.get_score(i) for i in ids]), [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def first_weights(pieces: list[str], scores: np.ndarray, byte_ids: list[int]) -> np.ndarray:
    """Natural logarithms from existing scores, which are ranks if all are whole numbers; bytes as the rarest piece. The last one ends a word."""
    real = np.array([p != "" for p in pieces])
    if np.all(scores == np.round(scores)):
        weight = np.zeros(len(scores))
        weight[real] = 1 / (2.7 + np.argsort(np.argsort(-scores[real], kind="stable"), kind="stable"))
    else:
        weight = np.where(real, np.exp(scores), 0)
    weight[byte_ids] = weight[real].min() if real.any() else 1.0
    with np.errstate(divide="ignore"):
        return np.log(np.append(weight, weight.max()) / (weight.sum() + weight.max()))


class Lattice:
    """Arcs of words, found in a trie of the pieces whose edges are one sorted array of (node, letter)."""

    def __init__(self, pieces: list[str], byte_ids: list[int], weight: np.ndarray):
        self.byte_ids, self.weight = np.array(byte_ids), weight
        self.letters = np.unique(np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32))
        self.width = len(self.letters) + 1
        number = {chr(c): i for i, c in enumerate(self.letters)}
        edges, ends = {}, [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                key = node * self.width + number[c]
                if (after := edges.get(key)) is None:
                    after = edges[key] = len(ends)
                    ends.append(-1)
                node = after
            if piece:
                ends[node] = i
        self.edges = np.array(sorted(edges), dtype=np.int64)
        self.after = np.array([edges[k] for k in self.edges.tolist()], dtype=np.int64)
        self.ends = np.array(ends)

    def arcs(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, piece of all arcs over letters of which each knows where its word ends; -1 for a letter that is no piece."""
        at = np.searchsorted(self.letters, codes)
        at[at == len(self.letters)] = 0
        letter = np.where(self.letters[at] == codes, at, self.width - 1)
        place = start = np.arange(len(codes))
        node = np.zeros(len(codes), dtype=np.int64)
        found, alone = [], np.ones(len(codes), dtype=bool)
        while len(start):
            key = node * self.width + letter[place]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[edge] == key
            start, place, node = start[on], place[on] + 1, self.after[edge[on]]
            piece = self.ends[node]
            is_piece = piece >= 0
            if not found:
                alone[start[is_piece]] = False
            found.append((start[is_piece], place[is_piece], piece[is_piece]))
            on = place < end[start]
            start, place, node = start[on], place[on], node[on]
        spelled = np.flatnonzero(alone)
        found.append((spelled, spelled + 1, np.full(len(spelled), -1)))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def walk(self, words: list[str], expected: bool = False) -> np.ndarray:
        """Natural logarithm of each word's marginal probability, or the expected counts of all pieces in these words."""
        size = np.array([len(w) + 1 for w in words])
        codes = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        start, end, piece = self.arcs(codes, (first + size)[word])
        spelled = np.flatnonzero(piece < 0)
        spellings = [self.byte_ids[list(chr(c).encode())] for c in codes[start[spelled]]]
        weight = self.weight[piece]
        weight[spelled] = [self.weight[s].sum() for s in spellings]
        of = word[start]
        # Each word has one node more than letters; nodes of a word follow each other.
        node_from, node_to = start + of, end + of
        alpha = self._sums(len(codes) + len(words), first + np.arange(len(words)), node_from, node_to, weight, end - first[of])
        total = alpha[first + size + np.arange(len(words))]
        if not expected:
            return total + self.weight[-1]
        beta = self._sums(len(codes) + len(words), first + size + np.arange(len(words)), node_to, node_from, weight, (first + size)[of] - start)
        share = np.exp(alpha[node_from] + weight + beta[node_to] - total[of])
        out = np.bincount(piece[piece >= 0], share[piece >= 0], len(self.weight))
        for s, x in zip(spellings, share[spelled], strict=True):
            np.add.at(out, s, x)
        out[-1] = len(words)
        return out

    @staticmethod
    def _sums(nodes: int, origins: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The forward recursion: logarithms of the sums over all ways from the origins, target by target in order of distance, all words at once."""
        reached = np.full(nodes, -np.inf)
        reached[origins] = 0
        order = np.lexsort((target, distance))
        source, target, weight, distance = source[order], target[order], weight[order], distance[order]
        edge = np.flatnonzero(np.append(True, distance[1:] != distance[:-1])) if len(order) else []
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            value, to = reached[source[a:b]] + weight[a:b], target[a:b]
            begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            most = np.maximum.reduceat(value, begin)
            most = np.where(np.isfinite(most), most, 0)
            with np.errstate(divide="ignore"):
                reached[to[begin]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, np.diff(np.append(begin, b - a)))), begin))
        return reached


def _words(text: bytes | None) -> list[bytes]:
    """Lower case of A-Z only, cut at the six white-space bytes, which is what these methods do for bytes."""
    return text.lower().split() if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, other = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = [*known, *other]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*known.values(), *[0] * len(other)], pa.int64()), pa.array([*known.values(), *other.values()], pa.int64())], ["word", "c", "n"])

    for batch in batches:
        for train, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counter = known if train else other
            counter.update(_words(text.as_py()))
            counter[b""] += 1  # the end
            if len(known) + len(other) >= HELD:
                yield out()
                known.clear()
                other.clear()
    yield out()


@dataclass
class Model:
    """What is learned: ``table`` holds word, c (in training), n (in all rows) and the natural logarithm of the word's probability; N, V and n of all tokens; c and logarithm of the end."""

    table: DataFrame
    tokens: int
    distinct: int
    all_tokens: int
    ends: int
    end_log_p: float

    @property
    def below(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)


def fit(docs: DataFrame, path: str, scratch: Scratch) -> Model:
    """Learns from the rows of (train boolean, text) where train holds; the words of the others get their probabilities as well."""
    send = docs.sparkSession.sparkContext.broadcast
    counted = docs.select(F.coalesce(F.col("train"), F.lit(False)).alias("train"), F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "word binary, c long, n long")
    counts = scratch.table(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    is_word = F.octet_length("word") > 0
    totals = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("n"), F.sum(F.when(~is_word, F.col("c")))).first()
    tokens, distinct, all_tokens, ends = (x or 0 for x in totals)
    words = counts.where(is_word).select(F.col("word").cast("string").alias("word"), "c", "n")
    pieces, scores, byte_ids = vocabulary(path)
    weight = first_weights(pieces, scores, byte_ids)
    real = np.isfinite(weight)
    for _ in range(ROUNDS if tokens else 0):
        expected = np.where(real, _expected(words.where("c > 0"), send((pieces, byte_ids, weight)), len(weight)) + PRIOR, 0)
        with np.errstate(divide="ignore"):
            weight = np.log(expected / expected.sum())
    spelled = DISCOUNT * (distinct - (ends > 0)) / tokens if tokens else 0.5
    table = scratch.table(_probable(words, send((pieces, byte_ids, weight)), tokens, spelled))
    return Model(table, tokens, distinct, all_tokens, ends, float(np.log(ends / tokens if tokens else 0.5)))


def _expected(words: DataFrame, shared, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(*shared.value), np.zeros(size)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, WALKED):
                total += lattice.walk(texts[a:b], expected=True)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["piece", "x"])

    out = np.zeros(size)
    for piece, x in words.select("word").mapInArrow(run, "piece int, x double").groupBy("piece").agg(F.sum("x")).collect():  # at most one row per piece
        out[piece] = x
    return out


def _probable(words: DataFrame, shared, tokens: int, spelled: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        with np.errstate(divide="ignore"):
            for batch in batches:
                texts, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                ways = np.concatenate([np.zeros(0), *(lattice.walk(texts[a:b]) for a, b in slices(texts, WALKED))]) + np.log(spelled)
                whole = np.log(np.maximum(c - DISCOUNT, 0) / max(tokens, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.logaddexp(ways, whole))], ["word", "c", "n", "log_p"])

    return words.mapInArrow(run, "word string, c long, n long, log_p double")


def _common(model: Model) -> tuple[DataFrame, dict[bytes, tuple[float, float, bool]]]:
    """The other words, and the common ones: at most ``SHARE``, each of at most ``MOST_BYTES``."""
    common = (F.col("n") * SHARE >= F.lit(model.all_tokens)) & (F.octet_length("word") <= MOST_BYTES)
    rows = model.table.where(common).select("word", "c", "log_p").collect()
    return model.table.where(~common), {w.encode(): (math.log10((c + ADDED) / model.below), p / math.log(10), c > 0) for w, c, p in rows}


def score_documents(docs: DataFrame, model: Model, scratch: Scratch, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in ``keep``, then n_tokens, n_known, train_tokens, base_score and score, for every row of ``docs``."""
    rest, common = _common(model)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    ends = (math.log10((model.ends + ADDED) / model.below), model.end_log_p / math.log(10), model.ends > 0)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).cast("binary").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = shared.value.get, TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(width).to_pylist()
            for a, b in slices(texts):
                sums, offsets, others, often = [], [0], [], []
                for t in texts[a:b]:
                    words = _words(t)
                    known, base, score = (int(ends[2]), ends[0], ends[1])
                    for w, n in Counter(words).items():
                        if (x := get(w)) is None:
                            others.append(w)
                            often.append(n)
                        else:
                            base += n * x[0]
                            score += n * x[1]
                            known += n * x[2]
                    sums.append((len(words) + 1, known, base, score))
                    offsets.append(len(others))
                found = [pa.array(x) for x in zip(*sums, strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (pa.array(others, pa.binary()).cast(pa.string()), pa.array(often, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(width)), pa.array(range(row, row + b - a), pa.int64()), *found, *lists], [*names, "row", "tokens", "known", "base", "score", "others", "often"])
                row += b - a

    found = scratch.table(source.mapInArrow(run, f"{fields}{', ' if fields else ''}row long, tokens long, known long, base double, score double, others array<string>, often array<int>"))
    words = found.select("row", F.explode(F.arrays_zip("others", "often")).alias("x")).select("row", F.col("x.others").alias("word"), F.col("x.often").alias("often"))
    base = F.log10((F.col("c") + ADDED) / F.lit(model.below))
    met = words.join(rest.select("word", "c", "log_p"), "word")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("more_known"), F.sum(F.col("often") * base).alias("more_base"), F.sum(F.col("often") * F.col("log_p") / F.lit(math.log(10))).alias("more_score"))
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))
    return found.drop("others", "often").join(more, "row", "left").select(
        *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("tokens").alias("n_tokens"), plus("known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("score").alias("score"),
    )

