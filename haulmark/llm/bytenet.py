"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become vectors, filters slide over them, and a filter keeps its largest answer in each
chunk. Chunks overlap by the filter width, so every byte of the whole text is seen by all offsets of
every filter. The verdict joins the largest and the mean of the chunk answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from haulmark.llm.common import labelled_sample, over_text
from haulmark.llm.words import joined

WIDTH = 5
FILTERS = 16
DIM = 8
CHUNK = 256
#: Chunks that are convolved at a time, to stay in the processor's cache.
GROUP = 128
#: Bounds of the training sample: labelled rows, and the longest text that it takes in.
SAMPLE_ROWS = 2400
SAMPLE_CHARS = 32_768
EPOCHS = 6
BATCH = 32
RATE = 0.02


@dataclass
class Net:
    bytes_: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH x DIM x FILTERS
    offset: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    bias: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.5 / np.sqrt(WIDTH), (WIDTH, DIM, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1),
        )

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.offset, self.out, self.bias]

    def tables(self) -> np.ndarray:
        """Answer of each filter to each byte at each offset: the convolution becomes lookups."""
        return np.einsum("bd,wdf->wbf", self.bytes_, self.filters).astype(np.float32)


@dataclass
class Chunks:
    data: np.ndarray
    begin: np.ndarray  # of each chunk, and the end of the last
    text: np.ndarray  # of each chunk
    gaps: np.ndarray  # places whose filter would reach into the next text

    @property
    def per_text(self) -> np.ndarray:
        return np.bincount(self.text)


def chunks_of(texts: pa.Array) -> Chunks:
    """Every text has one chunk at least; zero bytes fill up after its end."""
    data, starts = joined(texts, b"\0" * WIDTH)
    sizes = np.diff(starts) - WIDTH
    many = np.maximum(-(-sizes // CHUNK), 1)
    text = np.repeat(np.arange(len(many)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    gaps = (starts[1:, None] - np.arange(1, WIDTH)[None, :]).ravel()
    return Chunks(data, np.append(starts[text] + place * CHUNK, starts[-1]), text, np.sort(gaps))


def convolve(chunks: Chunks, tables: np.ndarray, want_place: bool = False):
    """Largest answer of each filter in each chunk, and where it was."""
    n = len(chunks.text)
    best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if want_place else None
    data = np.concatenate([chunks.data, np.zeros(WIDTH, np.uint8)])
    for a in range(0, n, GROUP):
        b = min(a + GROUP, n)
        lo, hi = chunks.begin[a], chunks.begin[b]
        answer = tables[0].take(data[lo:hi], axis=0)
        for k in range(1, WIDTH):
            answer += tables[k].take(data[lo + k : hi + k], axis=0)
        gaps = chunks.gaps[np.searchsorted(chunks.gaps, lo) : np.searchsorted(chunks.gaps, hi)]
        answer[gaps - lo] = -1e9
        cuts = chunks.begin[a:b] - lo
        best[a:b] = np.maximum.reduceat(answer, cuts, axis=0)
        if want_place:
            for i, (x, y) in enumerate(zip(cuts, [*cuts[1:], hi - lo], strict=True)):
                where[a + i] = lo + x + answer[x:y].argmax(axis=0)
    return best, where


def features(chunks: Chunks, best: np.ndarray, offset: np.ndarray):
    active = np.maximum(best + offset, 0)
    first = np.flatnonzero(np.diff(chunks.text, prepend=-1))
    top = np.maximum.reduceat(active, first, axis=0)
    mean = np.add.reduceat(active, first, axis=0) / chunks.per_text[:, None]
    return active, np.concatenate([top, mean], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(net: Net, chunks: Chunks, best: np.ndarray, where: np.ndarray, y: np.ndarray, weight: np.ndarray):
    active, x = features(chunks, best, net.offset)
    wrong = (sigmoid(x @ net.out + net.bias) - y) * weight / weight.sum()
    to_top, to_mean = np.outer(wrong, net.out[:FILTERS]), np.outer(wrong, net.out[FILTERS:])
    is_top = active == x[chunks.text, :FILTERS]
    first = np.flatnonzero(np.diff(chunks.text, prepend=-1))
    ties = np.add.reduceat(is_top.astype(float), first, axis=0)
    into = is_top * (to_top / ties)[chunks.text] + (to_mean / chunks.per_text[:, None])[chunks.text]
    into = np.where(active > 0, into, 0.0)
    by_table = np.zeros((WIDTH, 256, FILTERS))
    for k in range(WIDTH):
        cell = chunks.data[np.minimum(where + k, len(chunks.data) - 1)].astype(np.int64) * FILTERS + np.arange(FILTERS)
        by_table[k] = np.bincount(cell.ravel(), into.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
    return [
        np.einsum("wbf,wdf->bd", by_table, net.filters), np.einsum("wbf,bd->wdf", by_table, net.bytes_),
        into.sum(axis=0), x.T @ wrong, np.array([wrong.sum()]),
    ]


def train(texts: list[str], labels: list[int]) -> Net:
    """Adam over batches of whole texts; both labels weigh the same."""
    net = Net.fresh()
    if len(set(labels)) < 2:
        net.out[:], net.bias[:] = 0, (-8.0 if labels and not labels[0] else 8.0)
        return net
    y, rng = np.array(labels, float), np.random.default_rng(17)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    order = rng.permutation(len(texts))
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    ready = [chunks_of(pa.array([texts[i] for i in p], pa.string())) for p in parts]
    first, second, step = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts], 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(ready)):
            best, where = convolve(ready[k], net.tables(), True)
            step += 1
            for p, g, m, v in zip(net.parts, gradients(net, ready[k], best, where, y[parts[k]], weight[parts[k]]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, allowed: Column, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``score`` (0 to 1) and ``predicted`` of each whole text.

    Learns from ``labels.quality`` of rows where ``allowed`` holds, at most ``SAMPLE_ROWS`` of
    them. Null and empty texts are scored as one chunk of no bytes. Without labels every text
    passes (score near 1), and with labels of one value only every text gets that verdict. Null
    labels are not used; repeated rows are scored alike; an empty table gives no rows.
    """
    net = train(*labelled_sample(docs, labels, "quality", allowed, SAMPLE_ROWS, SAMPLE_CHARS))
    model = docs.sparkSession.sparkContext.broadcast((net.tables(), net.offset.astype(np.float32), net.out, net.bias))

    def score(texts: pa.Array) -> dict[str, pa.Array]:
        tables, offset, out, bias = model.value
        chunks = chunks_of(texts)
        p = sigmoid(features(chunks, convolve(chunks, tables)[0], offset)[1] @ out + bias)
        return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    return over_text(docs, score, "score double, predicted int", keep)
