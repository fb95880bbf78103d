"""Toxicity by nearest labelled examples.

Examples and documents are TF-IDF vectors over all terms that the examples hold: words and the beginnings of words. A term's weight
is its count times the square of its inverse document frequency (once for each side of the cosine); document frequencies are counted over all documents, by Spark. The
index keeps postings by term. A term in few examples is summed at once; one that stands in more examples than there are blocks
has, for each block of BLOCK examples, its largest weight there. Both together bound the cosine in a block; blocks are read from the highest bound down until the
bound falls under the cosine of the last of the wanted neighbours (a share NEAREST of the examples), so the neighbours are exact. Their votes, weighted by the cosine and smoothed by the examples'
base rate, are calibrated by a logistic line fitted on LINE_ROWS examples, each scored by all others; the closest EVIDENCE neighbours are given beside the score.

The examples are at most FIT_ROWS labelled rows of at most FIT_BYTES bytes, chosen by a hash of their id (documented bounds), so the index is
bounded (some tens of MB) and sent to all tasks; documents are scored by a map over whole texts, without a shuffle.

Defined cases: null and empty texts, and texts without a term of the index, have no neighbours and get the calibrated
base rate; words end at ASCII characters other than letters, digits and the underscore; ties between neighbours go to the smaller id; equal texts score alike and repeated rows are scored each; without labelled rows the score is
one half; of an id that stands with several texts the smallest is an example. Columns that aren't in ``keep`` are dropped, also where they are named as outputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, slices
from .words import WordHasher, mix, pieces

FIT_ROWS, FIT_BYTES, SEED = 4000, 40_000, 11
BLOCK, STEP, PRIOR, EVIDENCE = 64, 12, 0.01, 5
#: Powers of the inverse document frequency in a weight, of which the examples choose one.
POWERS = (1.0, 1.5, 2.0)
#: Neighbours that vote: this share of the examples, and so many at least.
NEAREST, LEAST_NEAREST = 0.05, 15
#: Examples that the logistic line is fitted on.
LINE_ROWS = 1000
#: Terms in a larger share of the examples are kept as a matrix; documents that are multiplied with it at a time.
DENSE, TOGETHER = 0.05, 128
#: Bytes of the beginnings of words that are terms beside the words.
BEGINNINGS = (4, 5, 6, 7)
#: Characters of text whose terms are counted at a time.
SLAB = 500_000
#: Words are runs of letters, digits and "_" of ASCII, and of whatever isn't ASCII.
_GAP = np.array([b < 128 and not (chr(b).isalnum() or chr(b) == "_") for b in range(256)])
NONE = np.zeros(0, dtype=np.int32)
#: What an index makes of its postings, when first asked for.
TABLES = ("dense", "matrix", "common", "begin", "block_max")


def terms_of(data: bytes, hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms of a lower-case text as hashes, and the byte that the word of each begins at: words, and the beginnings of longer ones."""
    for at, piece in pieces(data):
        sums, start, end = hasher.spans(piece)
        yield hasher.of(sums, start, end), start + at
        for k in BEGINNINGS:
            longer = end - start > k
            start, end = start[longer], end[longer]
            yield mix(hasher.of(sums, start, start + k) + np.uint64(k)), start + at


class Vocabulary:
    """The terms of the examples as sorted hashes; a term's number is its place. Tables by some bits of a hash find it, the first one nearly all."""

    def __init__(self, names: np.ndarray):
        self.names, self.tables = names, []
        left = np.arange(len(names), dtype=np.int32)
        while len(left):
            bits = max(8, (8 * len(left)).bit_length())
            slot = self._slot(names[left], len(self.tables), bits)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot] = left
            self.tables.append((bits, table))
            left = left[table[slot] != left]

    @staticmethod
    def _slot(h: np.ndarray, turn: int, bits: int) -> np.ndarray:
        return (mix(h + np.uint64(turn)) if turn else h) >> np.uint64(64 - bits)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each of these hashes, or -1."""
        out = np.full(len(h), -1, dtype=np.int32)
        for turn, (bits, table) in enumerate(self.tables):
            at = table[self._slot(h, turn, bits)]
            known = (at >= 0) & (self.names[at] == h)
            out[known] = at[known]
        return out


class Counts:
    """The known terms of texts, in order, and how often each stands in them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.hasher = vocabulary, WordHasher(fold=False, gap=_GAP)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's terms begin among all (and the end), terms, counts."""
        raw = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
        begins, size, keys = np.cumsum([0, *(len(t) + 1 for t in raw)]), len(self.vocabulary.names), []
        for h, start in terms_of(b" ".join(raw), self.hasher):
            number = self.vocabulary.numbers(h)
            known = number >= 0
            keys.append((np.searchsorted(begins, start[known], "right") - 1) * size + number[known])
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        return np.searchsorted(keys, np.arange(len(texts) + 1) * size), (keys % max(1, size)).astype(np.int32), counts.astype(np.float64)

    def each(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and counts of each text."""
        bounds, terms, counts = self(texts)
        return [(terms[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each term stands: sums of each task's counts, one number a term to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, found = Counts(Vocabulary(sent.value)), np.zeros(len(sent.value) + 1, dtype=np.int64)
        for batch in batches:
            found[-1] += len(batch)  # all documents
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, SLAB):
                found += np.bincount(counts(texts[a:b])[1], minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["term", "n"])

    rows = docs.select(text).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary.names) + 1, dtype=np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return int(out[-1]), out[:-1]


def segments(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each begin up to its end."""
    n = end - begin
    ends = np.cumsum(n)
    out = np.repeat(begin + n - ends, n)
    out += np.arange(len(out))
    return out


def weighed(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A vector of length one."""
    w = counts * idf[terms]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm > 0 else w


@dataclass
class Index:
    """Examples as TF-IDF vectors of length one, in blocks. Only the postings are sent to tasks; ``tables`` are made of them there, and on the driver only while a line is fitted."""

    names: np.ndarray
    idf: np.ndarray
    ids: np.ndarray  # by place
    labels: np.ndarray
    start: np.ndarray  # by term: its postings
    place: np.ndarray
    weight: np.ndarray
    base: float
    wanted: int  # neighbours
    block: int
    dense_from: int  # terms in more examples are dense
    slope: float = 1.0
    offset: float = 0.0
    loss: float = 0.0

    def __getstate__(self) -> dict:
        state = {k: v for k, v in self.__dict__.items() if k not in TABLES}
        return state | {"place": self.place.astype(np.int32, copy=False), "weight": self.weight.astype(np.float32, copy=False)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.tables()

    def __getattr__(self, name: str):
        if name not in TABLES:
            raise AttributeError(name)
        return getattr(self.tables(), name)

    def bare(self) -> Index:
        """The same without tables, as it is sent."""
        return Index(**self.__getstate__())

    def tables(self) -> Index:
        """dense: by term its row in ``matrix`` (terms x places, whole blocks); common: by term its row in ``begin`` (its postings of each block) and ``block_max``; else -1."""
        self.place, self.weight = self.place.astype(np.int64), self.weight.astype(np.float64)
        blocks, held = -(-len(self.ids) // self.block), np.diff(self.start)
        most, often = np.flatnonzero(held > self.dense_from), np.flatnonzero((held > blocks) & (held <= self.dense_from))
        self.dense, self.common = (np.full(len(held), -1, dtype=np.int32) for _ in range(2))
        self.dense[most], self.common[often] = np.arange(len(most)), np.arange(len(often))
        self.matrix = np.zeros((len(most), blocks * self.block))
        at = segments(self.start[most], self.start[most + 1])
        self.matrix[np.repeat(np.arange(len(most)), held[most]), self.place[at]] = self.weight[at]
        at = segments(self.start[often], self.start[often + 1])
        cell = np.repeat(np.arange(len(often)), held[often]) * blocks + self.place[at] // self.block
        self.block_max = np.zeros(len(often) * blocks)
        np.maximum.at(self.block_max, cell, self.weight[at])
        self.block_max = self.block_max.reshape(len(often), blocks)
        counts = np.bincount(cell, minlength=len(often) * blocks).reshape(len(often), blocks)
        self.begin = self.start[often][:, None] + np.concatenate([np.zeros((len(often), 1), dtype=np.int64), counts.cumsum(1)], axis=1)
        return self

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighed(terms, counts, self.idf)

    def products(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the dense terms of these (terms, weights) add to the cosines with all places."""
        out = np.zeros((len(rows), len(self.matrix)))
        for i, (terms, weights) in enumerate(rows):
            at = self.dense[terms]
            out[i, at[at >= 0]] = weights[at >= 0]
        return out @ self.matrix

    def score(self, places: np.ndarray, cosines: np.ndarray) -> float:
        share = (PRIOR * self.base + (cosines * self.labels[places]).sum()) / (PRIOR + cosines.sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(share) + self.offset, -30, 30))))


def _logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def vocabulary_of(examples: list[tuple[int, str, int]]) -> Vocabulary:
    hasher = WordHasher(fold=False, gap=_GAP)
    found = [np.unique(np.concatenate([h for h, _ in terms_of(text.lower().encode("utf-8", "replace"), hasher)])) for _, text, _ in examples]
    return Vocabulary(np.unique(np.concatenate([np.zeros(0, np.uint64), *found])))


def build(examples: list[tuple[int, str, int]], vocabulary: Vocabulary, total: int, found: np.ndarray) -> Index:
    """The index over (id, text, label) rows; found: in how many of ``total`` documents each term stands.

    Examples that have the same most frequent term stand together, so that a block's maxima are those of one kind of text.
    """
    counts, idf = Counts(vocabulary), np.log(1 + max(1, total) / np.maximum(found, 1))
    rows = [(i, y, terms, n.astype(np.float32)) for i, t, y in sorted(examples) for terms, n in counts.each([t])]
    rows.sort(key=lambda r: (int(r[2][r[3].argmax()]) if len(r[2]) else -1, r[1], r[0]))
    best = None
    for power in POWERS:  # the tables of one at a time are held
        index = calibrated(inverted(rows, vocabulary, idf**power), [(p, r[2], r[3]) for p, r in enumerate(rows)])
        index = index.bare()
        best = index if best is None or index.loss < best.loss else best
    return best


def inverted(rows: list[tuple[int, int, np.ndarray, np.ndarray]], vocabulary: Vocabulary, idf: np.ndarray) -> Index:
    """The postings, matrix and blocks of (id, label, terms, counts) rows in this order."""
    n, labels = len(rows), np.array([r[1] for r in rows], dtype=np.float64)
    term = np.concatenate([NONE, *(r[2] for r in rows)])
    place = np.repeat(np.arange(n, dtype=np.int32), [len(r[2]) for r in rows])
    weight = np.concatenate([np.zeros(0, np.float32), *(weighed(r[2], r[3], idf).astype(np.float32) for r in rows)])
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(idf) + 1))
    return Index(vocabulary.names, idf, np.array([r[0] for r in rows], dtype=np.int64), labels, start, place[order], weight[order], float((labels.sum() + 1) / (n + 2)), max(LEAST_NEAREST, int(NEAREST * n)), BLOCK, int(DENSE * n))


def calibrated(index: Index, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Index:
    """Fits the logistic line on the votes of each example's neighbours but itself, by Newton's steps."""
    if len(rows) < 2 or index.labels.min() == index.labels.max():
        return index
    rows = rows if len(rows) <= LINE_ROWS else [rows[p] for p in np.random.default_rng(SEED).choice(len(rows), LINE_ROWS, replace=False).tolist()]
    x = np.empty(len(rows))
    for i, (p, terms, counts) in enumerate(rows):
        weights = index.weights(terms, counts)
        places, cosines = nearest(index, terms, weights, index.products([(terms, weights)])[0], index.wanted + 1)
        other = np.flatnonzero(places != p)[: index.wanted]
        x[i] = _logit((PRIOR * index.base + (cosines[other] * index.labels[places[other]]).sum()) / (PRIOR + cosines[other].sum()))
    line, y, design = np.array([1.0, 0.0]), index.labels[[p for p, *_ in rows]], np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), design.T @ (p - y) + 0.1 * (line - [1.0, 0.0]))
        line = line - np.clip(step, -2, 2)
    index.slope, index.offset = map(float, line)
    p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
    index.loss = float(-np.log(np.where(y == 1, p, 1 - p)).mean())
    return index


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the ``most`` examples of largest positive cosine, best first; dense: this document's row of ``products``."""
    n, size, common = len(index.ids), index.matrix.shape[1], index.common[terms]
    block = index.block
    places, cosines, floor = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    rare = (common < 0) & (index.dense[terms] < 0)
    begin, end = index.start[terms[rare]], index.start[terms[rare] + 1]
    at = segments(begin, end)
    sums = (dense + np.bincount(index.place[at], weights=index.weight[at] * np.repeat(weights[rare], end - begin), minlength=size)).reshape(-1, block)
    row, weights = common[common >= 0], weights[common >= 0]
    begins, across = index.begin.ravel(), index.begin.shape[1]
    bound = sums.max(1, initial=0.0) + weights @ index.block_max[row]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    for a in range(0, len(order), STEP):
        part = order[a : a + STEP]
        part = part[bound[part] >= floor - 1e-6]
        if not len(part):
            break
        cell = (row[:, None] * across + part).ravel()
        begin, end = begins.take(cell), begins.take(cell + 1)
        at = segments(begin, end)
        more = np.bincount(index.place[at], weights=index.weight[at] * np.repeat(np.repeat(weights, len(part)), end - begin), minlength=size)
        found = np.round((sums[part] + more.reshape(-1, block)[part]).ravel(), 12)
        where = (part[:, None] * block + np.arange(block)).ravel()
        hit = np.flatnonzero((found >= max(floor, 1e-12)) & (where < n))
        places, cosines = np.concatenate([places, where[hit]]), np.concatenate([cosines, found[hit]])
        if len(places) > most:
            floor = np.partition(cosines, -most)[-most]
            places, cosines = places[cosines >= floor], cosines[cosines >= floor]
    best = np.lexsort((index.ids[places], -cosines))[:most]
    return places[best], cosines[best]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Index:
    """The index over a hash sample of at most ``rows`` of these labels, with document frequencies over all of ``docs``."""
    examples = [tuple(r) for r in labelled_sample(docs, labels, label, rows=rows, most_bytes=FIT_BYTES, seed=SEED, key=key, text=text)]
    vocabulary = vocabulary_of(examples)
    return build(examples, vocabulary, *document_frequencies(docs, vocabulary, text))


def score_documents(docs: DataFrame, index: Index, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then score and evidence (closest neighbours with cosine and label), for every row of ``docs``."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    sent = source.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        counts = Counts(Vocabulary(ix.names))
        for batch in batches:
            scores, evidence, texts = [], [], batch.column(len(keep))
            for a in range(0, len(texts), TOGETHER):
                some = texts.slice(a, TOGETHER).to_pylist()
                rows = [(terms, ix.weights(terms, n)) for b, c in slices(some, SLAB) for terms, n in counts.each(some[b:c])]
                for (terms, weights), dense in zip(rows, ix.products(rows), strict=True):
                    places, cosines = nearest(ix, terms, weights, dense, ix.wanted) if len(terms) else (NONE, np.zeros(0))
                    scores.append(ix.score(places, cosines))
                    evidence.append([{"id": i, "cosine": c, "label": int(y)} for i, c, y in zip(ix.ids[places[:EVIDENCE]].tolist(), cosines[:EVIDENCE].tolist(), ix.labels[places[:EVIDENCE]].tolist(), strict=True)])
            rest = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64()), pa.array(evidence, kind)], [*keep, "score", "evidence"])

    return source.mapInArrow(run, f"{fields}, score double, evidence array<struct<id:long,cosine:double,label:int>>")
