"""Quality classifier: a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes slide over the whole text. Their responses are max-pooled over chunks of CHUNK
bytes that overlap by half; a document's chunks are combined by their mean and their maximum, and a logistic unit gives
the probability that the document is of good quality. As a filter reads bytes one-hot, its response is a sum of table
look-ups; tables over pairs of bytes halve them.

The network is trained on the driver by Adam on at most FIT_ROWS labelled rows of at most FIT_BYTES bytes each, chosen by
a hash of their id (documented bounds; labels are given row by row, so more rows don't change what is learned much).
Scoring is a map over all documents and whole texts, without a shuffle.

Defined cases: a null text counts as empty; an empty text is one chunk of padding and gets the score the network gives
that; equal texts get equal scores to the last bit, whatever they are scored with; columns that aren't in ``keep`` are dropped, also where they are named as outputs; with no labelled rows, or one class only, every score is the smoothed share of
class 1. Labels are only read from the rows handed to ``fit``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, slices

FIT_ROWS, FIT_BYTES = 2400, 40_000
WIDTH, FILTERS, CHUNK = 4, 12, 256
HALF = CHUNK // 2
EPOCHS, BATCH, RATE, DECAY, SEED = 11, 48, 0.02, 1e-4, 7
SLAB = 1 << 18
#: A text scored below this is called bad.
LEAST = 0.7


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.filters
        first = (w[0][:, None, :] + w[1][None, :, :] + self.bias).reshape(65536, -1)
        second = (w[2][:, None, :] + w[3][None, :, :]).reshape(65536, -1)
        return first.astype(np.float32), second.astype(np.float32)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text between WIDTH - 1 zeros at least and in whole half-chunks; the first half-chunk of each.

    The zeros before a text keep the last windows of the one before from reading it.
    """
    edge = WIDTH - 1
    halves = np.array([(len(t) + 2 * edge + HALF - 1) // HALF for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(halves)])
    flat = np.zeros(int(starts[-1]) * HALF + WIDTH, dtype=np.uint8)
    for t, s in zip(texts, starts, strict=False):
        flat[s * HALF + edge : s * HALF + edge + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return flat, starts


def pooled(flat: np.ndarray, tables: tuple[np.ndarray, np.ndarray], places: bool = False):
    """The largest response of each filter in each half-chunk (and where it stands)."""
    pairs = flat[:-1].astype(np.int32) * 256 + flat[1:]
    n = len(flat) - WIDTH
    best, at = [], []
    for a in range(0, n, SLAB):
        b = min(a + SLAB, n)
        r = (tables[0][pairs[a:b]] + tables[1][pairs[a + 2 : b + 2]]).reshape(-1, HALF, tables[0].shape[1])
        if places:
            i = r.argmax(1)
            at.append(i + (a + np.arange(len(r)) * HALF)[:, None])
            best.append(np.take_along_axis(r, i[:, None, :], 1)[:, 0])
        else:
            best.append(r.max(1))
    return (np.concatenate(best), np.concatenate(at)) if places else np.concatenate(best)


def chunks(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk its two half-chunks, and the first chunk of each text; a text of one half-chunk is one chunk."""
    halves = np.diff(starts)
    count = np.maximum(halves - 1, 1)
    first = np.concatenate([[0], np.cumsum(count)])
    left = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(starts[:-1], count)
    right = left + np.repeat((halves > 1).astype(np.int64), count)
    return left, right, first


def score(net: Network, texts: list[bytes], tables=None) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    flat, starts = layout(texts)
    h = np.maximum(pooled(flat, tables or net.tables()), 0).astype(np.float64)
    left, right, first = chunks(starts)
    c = np.maximum(h[left], h[right])
    mean = np.add.reduceat(c, first[:-1], axis=0) / np.diff(first)[:, None]
    most = np.maximum.reduceat(c, first[:-1], axis=0)
    # Row by row, as a matrix product may round a row otherwise in another batch.
    z = (mean * net.mean_weight).sum(1) + (most * net.max_weight).sum(1) + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray) -> Network:
    """Back-propagation by hand; through the maxima only their places get gradients."""
    rng = np.random.default_rng(SEED)
    net = Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), rng.normal(0, 0.1, FILTERS), 0.0)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net.offset = float(np.log(share / (1 - share)))
    if len(labels) == 0 or labels.min() == labels.max():
        net.mean_weight[:] = net.max_weight[:] = 0
        return net
    values = [net.filters, net.bias, net.mean_weight, net.max_weight, np.array([net.offset])]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            flat, starts = layout([texts[i] for i in pick])
            net.filters, net.bias, net.mean_weight, net.max_weight, net.offset = *values[:4], float(values[4][0])
            h, at = pooled(flat, net.tables(), places=True)
            left, right, first = chunks(starts)
            wins = h[right] > h[left]
            c = np.where(wins, h[right], h[left]).astype(np.float64)
            place = np.where(wins, at[right], at[left])
            relu = np.maximum(c, 0)
            n = np.diff(first)
            mean = np.add.reduceat(relu, first[:-1], axis=0) / n[:, None]
            most = np.maximum.reduceat(relu, first[:-1], axis=0)
            p = 1 / (1 + np.exp(-np.clip(mean @ values[2] + most @ values[3] + values[4][0], -30, 30)))
            g = (p - labels[pick]) / len(pick)
            back = np.repeat(g[:, None] * values[2] / n[:, None], n, axis=0) + np.where(relu == np.repeat(most, n, axis=0), np.repeat(g[:, None] * values[3], n, axis=0), 0)
            back = np.where(c > 0, back, 0)
            grads = [np.zeros_like(net.filters), back.sum(0), mean.T @ g, most.T @ g, np.array([g.sum()])]
            for k in range(WIDTH):
                for f in range(FILTERS):
                    grads[0][k, :, f] = np.bincount(flat[place[:, f] + k], weights=back[:, f], minlength=256)
            step += 1
            for v, gr, (m1, m2) in zip(values, grads, moments, strict=True):
                gr = gr + DECAY * v
                m1 *= 0.9
                m1 += 0.1 * gr
                m2 *= 0.999
                m2 += 0.001 * gr * gr
                v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    net.filters, net.bias, net.mean_weight, net.max_weight, net.offset = *values[:4], float(values[4][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Network:
    """The network trained on a hash sample of at most ``rows`` of these labels."""
    sample = labelled_sample(docs, labels, label, rows=rows, most_bytes=FIT_BYTES, seed=SEED, key=key, text=text)
    return train([r.t.encode() for r in sample], np.array([r.y for r in sample], dtype=np.float64))


def score_documents(docs: DataFrame, net: Network, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then score, for every row of ``docs``."""
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    sent = source.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            scores = [score(sent.value, texts[a:b], tables) for a, b in slices(texts, 2_000_000)]
            rest = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(scores or [np.zeros(0)]))], [*keep, "score"])

    return source.mapInArrow(run, f"{fields}, score double")
